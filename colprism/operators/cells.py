"""Cells of all columns in one long table, and their counts per value.

One scan serves every column: columns are unpivoted in their own types (one
slot each for whole numbers, reals, timestamps and texts) and counted by
``(column, value)``.  The count is combined on the map side, so a value that
fills a third of the table crosses the shuffle once per task, and only
distinct values are turned into text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.detect import DATETIME, INTEGER, REAL, TEXT
from ..functions.text import is_blank
from ..functions.rendering import render_double, render_timestamp


class UnsupportedColumnType(TypeError):
    """The column has a type the profile does not know (array, map, struct, binary …)."""


_PROFILE_TYPES = [
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), INTEGER),
    ((T.FloatType, T.DoubleType, T.DecimalType), REAL),
    ((T.DateType, T.TimestampType, T.TimestampNTZType), DATETIME),
    ((T.BooleanType, T.StringType), TEXT),
]


def profile_type(field: T.StructField) -> str:
    for kinds, name in _PROFILE_TYPES:
        if isinstance(field.dataType, kinds):
            return name
    raise UnsupportedColumnType(f"column {field.name}: {field.dataType.simpleString()}")


SLOTS = {"whole": "bigint", "real": "double", "moment": "timestamp_ntz", "text": "string"}


def _quoted(field: T.StructField) -> str:
    return "`" + field.name.replace("`", "``") + "`"


def _slots(field: T.StructField) -> dict[str, str]:
    """SQL of the slots one column fills; null cells and empty texts fill none."""
    value, kind = _quoted(field), field.dataType
    tag = profile_type(field)
    if tag == INTEGER:
        return {"whole": f"CAST({value} AS bigint)"}
    if isinstance(kind, T.DecimalType):
        return {"real": f"CAST({value} AS double)", "text": f"CAST({value} AS string)"}
    if tag == REAL:
        # Grouping merges the two zeros, their texts differ.
        negative_zero = f"CASE WHEN {value} = 0 AND CAST({value} AS string) = '-0.0' THEN '-0.0' END"
        return {"real": f"CAST({value} AS double)", "text": negative_zero}
    if isinstance(kind, T.DateType):
        return {"moment": f"CAST({value} AS timestamp_ntz)", "text": f"CAST({value} AS string)"}
    if tag == DATETIME:
        return {"moment": f"CAST({value} AS timestamp_ntz)"}
    if isinstance(kind, T.BooleanType):
        return {"text": f"initcap(CAST({value} AS string))"}
    return {"text": f"nullif({value}, '')"}


def _slot_rows(df: DataFrame, places: Sequence[int] | None = None) -> DataFrame:
    """A row per cell, by one ``stack`` over all columns, or those at ``places``: column_pos and the slots."""
    entries, fields = [], df.schema.fields
    places = range(len(fields)) if places is None else places
    for position in places:
        field = fields[position]
        filled = _slots(field)
        entries.append(str(position))
        entries += [filled.get(slot, f"CAST(NULL AS {kind})") for slot, kind in SLOTS.items()]
    return df.selectExpr(f"stack({len(places)}, {', '.join(entries)}) AS (column_pos, {', '.join(SLOTS)})")


def value_text() -> Column:
    """The text of a cell from its slots."""
    return F.expr(f"coalesce(text, CAST(whole AS string), {render_double('real')}, {render_timestamp('moment')}, '')")


def blank_cell() -> Column:
    """Whether a cell is blank; only texts are searched for a character that is not white space."""
    return F.expr("whole IS NULL AND real IS NULL AND moment IS NULL") & F.coalesce(is_blank(F.col("text")), F.lit(True))


def _lookup(entries: list[str]) -> Column:
    quoted = ", ".join("'" + e.replace("\\", "\\\\").replace("'", "\\'") + "'" for e in entries)
    return F.expr(f"coalesce(element_at(array({quoted}), column_pos + 1), '')")


def _named(rows: DataFrame, source: DataFrame, *more: str) -> DataFrame:
    fields = source.schema.fields
    # Keys are never null: else Spark would add null filters to every join and push them under the count.
    return rows.select(
        F.expr("coalesce(column_pos, -1)").alias("column_pos"),
        _lookup([f.name for f in fields]).alias("column_name"),
        _lookup([profile_type(f) for f in fields]).alias("schema_type"),
        value_text().alias("value"),
        blank_cell().alias("is_blank"),
        *SLOTS, *more,
    )


def _with_dataset(rows: DataFrame, dataset_name: str | None) -> DataFrame:
    return rows if dataset_name is None else rows.select(F.lit(dataset_name).alias("dataset_name"), "*")


def cells(df: DataFrame, dataset_name: str | None = None) -> DataFrame:
    """One row per cell: column_pos, column_name, schema_type, value, is_blank and the typed slots.

    With ``dataset_name`` the cells of several datasets can be united and
    described in one job.
    """
    return _with_dataset(_named(_slot_rows(df), df), dataset_name)


def _examples(df: DataFrame, places: Sequence[int]) -> DataFrame:
    """Two rows with the columns of ``df``: a value of each column at ``places`` if it has one, and a null if it has one."""
    fields = df.schema.fields
    cell = lambda i: F.col(_quoted(fields[i]))
    one = df.agg(F.count(F.lit(1)).alias("n"), *[f(cell(i)).alias(f"{name}{i}") for i in places for name, f in (("n", F.count), ("c", F.max))])
    two = one.where("n > 0").select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("second"))
    shown = lambda i: F.when(F.col("second") & (F.col(f"n{i}") < F.col("n")), F.lit(None)).otherwise(F.col(f"c{i}"))
    chosen = set(places)
    return two.select(*[(shown(i) if i in chosen else F.lit(None)).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def type_cells(df: DataFrame, dataset_name: str | None = None) -> DataFrame:
    """Cells that hold every type of every column: all cells of texts, and at most two of a column that the schema types.

    There a type follows from whether a cell is null, which one aggregation tells; only texts become rows.
    """
    kinds = [profile_type(field) for field in df.schema.fields]
    texts, known = ([i for i, kind in enumerate(kinds) if (kind == TEXT) == is_text] for is_text in (True, False))
    parts = [(df, texts), (_examples(df, known), known)]
    rows = [_named(_slot_rows(source, places), df) for source, places in parts if places]
    return _with_dataset(reduce(DataFrame.unionByName, rows), dataset_name)


def value_counts(df: DataFrame, dataset_name: str | None = None) -> DataFrame:
    """One row per column and distinct value, whole whatever its length, with the number of cells ``cnt``."""
    rows = _slot_rows(df)
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("cnt"))
    return _with_dataset(_named(counted, df, "cnt"), dataset_name)
