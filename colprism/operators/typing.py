"""Detected types of cells and their statistics.

Input is ``cells`` (a row per cell) or ``value_counts`` (a row per distinct
value with weight ``cnt``); each operator takes both.

No operator filters value counts by the detected type alone: Spark would push
that filter, with the whole detection in it, below the count of the values, and
the branches of a profile could no longer share one exchange.  Conditions sit
inside the aggregates, or in ``_only``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import detect as D

UNTYPED = ""


def keys(df: DataFrame, *more: str) -> list[str]:
    """Grouping columns of a cell table, which may hold the cells of several datasets."""
    return [c for c in ("dataset_name", "column_pos", "column_name") if c in df.columns] + list(more)


def _weight(df: DataFrame) -> Column:
    return F.col("cnt") if "cnt" in df.columns else F.lit(1).cast("bigint")


def typed(cells: DataFrame, empty_as_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Add ``type`` and the comparables ``number``, ``moment`` and ``length``; columns in ``keep`` stay as they are.

    Blank cells are TEXT of length 0 unless ``empty_as_text`` is off, which
    leaves them without a type.
    """
    value, text, from_schema = F.col("value"), F.col("text"), F.col("schema_type")
    # Each step is its own projection, so that no expression is computed twice.
    # Detection reads the text slot: columns typed by the schema render no value for it.
    open_text = ~F.col("is_blank") & (from_schema == D.TEXT)
    rows = cells.withColumn("_number_tag", F.when(open_text, D.number_tag(text)))
    rows = rows.withColumn("_open", open_text & F.col("_number_tag").isNull())
    rows = rows.withColumn("_parsed", F.when(F.col("_open"), D.shaped_timestamp(text)))
    tag = (
        F.when(F.col("is_blank"), D.TEXT if empty_as_text else UNTYPED)
        .when(from_schema != D.TEXT, from_schema)
        .otherwise(
            F.coalesce(F.col("_number_tag"), F.when(F.col("_parsed").isNotNull(), D.DATETIME), F.lit(D.TEXT))
        )
    )
    digits = D.without_commas(text)
    number = F.coalesce(
        F.col("whole").cast("double"),
        F.col("real"),
        F.when(F.col("_number_tag").isNotNull(), digits.try_cast("double")),
    )
    return rows.select(
        *keys(cells), tag.alias("type"), "value",
        F.coalesce("whole", F.when(F.col("_number_tag") == D.INTEGER, digits.try_cast("bigint"))).alias("whole"),
        number.alias("number"),
        F.coalesce("moment", "_parsed").alias("moment"),
        F.when(F.col("is_blank"), 0).otherwise(F.length(value)).alias("length"),
        *[c for c in ["cnt", *keep] if c in cells.columns],
    )


def type_counts(typed_cells: DataFrame) -> DataFrame:
    """Cells of every detected type, per column."""
    typed_weight = F.when(F.col("type") != UNTYPED, _weight(typed_cells))
    counted = typed_cells.groupBy(*keys(typed_cells, "type")).agg(F.sum(typed_weight).alias("count"))
    return counted.filter(F.col("count").isNotNull())


def types_per_column(typed_cells: DataFrame) -> DataFrame:
    """The set of detected types of every column, possibly empty; at most four are collected."""
    kind = F.when(F.col("type") != UNTYPED, F.col("type"))
    found = typed_cells.groupBy(*keys(typed_cells, "type")).agg(F.count(F.lit(1)).alias("_cells"))
    return found.groupBy(*keys(found)).agg(F.array_sort(F.collect_set(kind)).alias("types"))


def _digits() -> Column:
    return F.regexp_replace(F.col("value"), r"[^0-9]", "")


def _huge_size() -> Column:
    """Number of digits of a whole number that no 64-bit number holds, with its sign; 0 for all others."""
    size = F.length(_digits())
    huge = (F.col("type") == D.INTEGER) & F.col("whole").isNull()
    return F.when(huge, F.when(F.col("value").startswith("-"), -size).otherwise(size)).otherwise(0)


def _order_key() -> Column:
    """Comparable of a number or date; exact for whole numbers of any length."""
    digits = F.when(F.col("value").startswith("-"), F.translate(_digits(), "0123456789", "9876543210")).otherwise(_digits())
    return F.struct(
        F.col("moment"),
        F.col("size"),
        F.when(F.col("size") != 0, digits).alias("digits"),
        F.col("whole"),
        F.col("number"),
    )


def _is_text() -> Column:
    return F.col("type") == D.TEXT


def _number() -> Column:
    return F.when(F.col("type").isin(D.INTEGER, D.REAL), F.col("number"))


def _only(df: DataFrame, test: Column) -> DataFrame:
    """Rows that pass ``test``, filtered in place.

    Over value counts the condition includes the count, which keeps it above
    the aggregation: all branches of a profile go on sharing its exchange.
    """
    return df.filter(F.when(test, F.col("cnt")) > 0) if "cnt" in df.columns else df.filter(test)


#: What the extremes of a type are told by, each a number that a hash aggregation holds.
_PARTS = ["moment", "size", "whole", "number"]


def _base(number: Column) -> Column:
    """A number cut to its first nine bits; 0 for those that have none so near."""
    size = F.abs(number)
    unit = F.pow(F.lit(2.0), F.floor(F.log2(size)) - 8)
    return F.when((size > 1e-290) & (size < 1e300), F.signum(number) * F.floor(size / unit) * unit).otherwise(0.0)


def _merged(a: Column, b: Column) -> Column:
    """The state (n, base, mean, m2) of two disjoint sets of numbers, means counted from their bases; n is never 0."""
    n, off = a["n"] + b["n"], (b["base"] - a["base"]) + (b["mean"] - a["mean"])
    return F.struct(n.alias("n"), a["base"].alias("base"), (a["mean"] + off * (b["n"] / n)).alias("mean"),
                    (a["m2"] + b["m2"] + off * off * (a["n"] * (b["n"] / n))).alias("m2"))


def summaries(typed_cells: DataFrame) -> DataFrame:
    """A row per column and type, in one pass: cells, mean, deviation, average length, and the parts of both extremes.

    A value that occurs cnt times counts with each power of two in cnt, and a number counts from its first nine bits on.
    So the values of one power weigh the same and the built-in moments apply to them, without cancelling where large
    values lie close together; the states (n, base, mean, second moment) of a column and type, at most 512 for each power
    of two among its numbers and each among its counts, are then merged pairwise.
    """
    by, number = keys(typed_cells, "type"), _number()
    rows = typed_cells.select(
        *by, number.alias("number"), F.when(~F.col("type").isin(D.TEXT, UNTYPED), F.col("moment")).alias("moment"),
        _huge_size().alias("size"), "whole", F.when(_is_text(), F.col("length")).alias("length"), _weight(typed_cells).alias("cnt"))
    power = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b)
    some = F.filter(F.sequence(F.lit(0), F.floor(F.log2("cnt")).cast("int") + 1), lambda b: F.col("cnt").bitwiseAND(power(b)) != 0)
    rows = rows.select("*", _base(F.col("number")).alias("base"), F.explode(F.when(F.col("cnt") == 1, F.array(F.lit(0))).otherwise(some)).alias("bit"))
    rows = rows.select(*by, *_PARTS, "length", "bit", "base", (F.col("number") - F.col("base")).alias("off"))
    ends = [f(c).alias(f"{name}_{c}") for name, f in (("high", F.max), ("low", F.min)) for c in _PARTS]
    powers = rows.groupBy(*by, "bit", "base").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("length").alias("length"), F.count("off").alias("n"), F.avg("off").alias("mean"),
        F.var_pop("off").alias("variance"), *ends)
    heavy = (F.col("n") * power(F.col("bit"))).cast("double")
    state = F.when(F.col("n") > 0, F.struct(heavy.alias("n"), F.col("base"), F.col("mean"), (F.col("variance") * heavy).alias("m2")))
    again = [f(f"{name}_{c}").alias(f"{name}_{c}") for name, f in (("high", F.max), ("low", F.min)) for c in _PARTS]
    one = powers.groupBy(*by).agg(
        F.sum(F.col("rows") * power(F.col("bit"))).alias("count"), F.sum(F.col("length") * power(F.col("bit"))).alias("length"),
        F.array_sort(F.collect_list(state)).alias("states"), *again)
    whole = F.aggregate(F.slice("states", F.lit(2), F.size("states")), F.get("states", F.lit(0)), _merged)
    one = one.withColumn("state", F.when(F.size("states") > 0, whole))
    return one.select(
        *by, "count", (F.col("state.base") + F.col("state.mean")).alias("mean"), F.sqrt(F.col("state.m2") / F.col("state.n")).alias("stddev"),
        (F.col("length") / F.col("count")).alias("average_length"), *[f"{name}_{c}" for name in ("high", "low") for c in _PARTS])


STATS = ["count", "mean", "stddev", "average_length"]


def full_stats(typed_cells: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Cells, mean, population standard deviation and average length, a row per column and type; from ``known`` summaries if there are."""
    return (summaries(typed_cells) if known is None else known).select(*keys(typed_cells, "type"), *STATS)


def type_stats(typed_cells: DataFrame) -> DataFrame:
    return full_stats(typed_cells).drop("stddev")


def deviations(typed_cells: DataFrame) -> DataFrame:
    return full_stats(typed_cells).select(*keys(typed_cells, "type"), "stddev")


def extremes(typed_cells: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Text of the largest and the smallest number or date with ``full_stats``, a row per column and type of numbers or dates.

    Among equal ones the maximum takes the lexically largest text, the minimum the smallest.  ``summaries`` finds the
    parts of the extremes, unless they are ``known``; a second read compares texts of those cells only that hold one.  Both are hash aggregations.
    """
    by = keys(typed_cells, "type")
    rows = _only(typed_cells, ~F.col("type").isin(D.TEXT, UNTYPED))
    rows = rows.select(*by, "value", "moment", _huge_size().alias("size"), "whole", "number")
    rows = rows.join(F.broadcast(summaries(typed_cells) if known is None else known), by)  # at most five rows per column of the table

    def at(name: str) -> Column:
        is_end = lambda c: F.col(c).eqNullSafe(F.col(f"{name}_{c}"))
        return is_end("moment") & is_end("size") & ((F.col("size") != 0) | F.when(F.col("type") == D.INTEGER, is_end("whole")).otherwise(is_end("number")))

    ends = rows.filter(at("high") | at("low")).select(*by, *STATS, F.struct(_order_key().alias("key"), "value").alias("_pair"))
    # A list (of nothing) makes Spark keep structs in a hash table; by themselves they would be sorted.
    nothing = F.size(F.collect_list(F.lit(None).cast("int"))).alias("_nothing")
    found = ends.groupBy(*by).agg(F.max("_pair").alias("high"), F.min("_pair").alias("low"), nothing, *[F.max(c).alias(c) for c in STATS])
    return found.filter("_nothing = 0").select(*by, *STATS, F.col("high.value").alias("max_value"), F.col("low.value").alias("min_value"))


def numeric_stats(typed_cells: DataFrame) -> DataFrame:
    """Count, extremes, mean and deviation of INTEGER(LONG) and REAL cells."""
    return extremes(typed_cells).filter(F.col("mean").isNotNull()).select(*keys(typed_cells, "type"), "count", "max_value", "min_value", "mean", "stddev")


def datetime_stats(typed_cells: DataFrame) -> DataFrame:
    """Count and extremes of DATE/TIME cells."""
    return extremes(typed_cells).filter(F.col("type") == D.DATETIME).select(*keys(typed_cells, "type"), "count", "max_value", "min_value")


def text_stats(typed_cells: DataFrame) -> DataFrame:
    """Cells and average length of TEXT, blank cells counting as length 0."""
    weight = _weight(typed_cells)
    return typed_cells.groupBy(*keys(typed_cells, "type")).agg(
        F.sum(weight).alias("count"),
        (F.sum(F.when(_is_text(), F.col("length") * weight)) / F.sum(weight)).alias("average_length"),
    ).filter(F.col("average_length").isNotNull())


def _column(df: DataFrame) -> list[str]:
    return [c for c in keys(df) if c != "column_name"]


def text_by_length(typed_cells: DataFrame, longest: bool, k: int = 5) -> DataFrame:
    """The k longest or shortest TEXT cells of every column; ties by value.

    These are cells, not distinct values: a value that occurs often may fill
    all places.  On value counts the k first distinct values are found first
    and only those are repeated.
    """
    length = F.desc("length") if longest else F.asc("length")
    order = Window.partitionBy(*_column(typed_cells)).orderBy(length, "value")
    weighted = "cnt" in typed_cells.columns
    shown = [*keys(typed_cells), "value", "length"]
    rows = _only(typed_cells, _is_text()).select(*shown, *(["cnt"] if weighted else []))
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if not weighted:
        return rows
    copies = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("cnt", F.lit(k)))))
    again = Window.partitionBy(*_column(rows)).orderBy("rank", "_copy")
    return (
        copies.withColumn("_place", F.row_number().over(again)).filter(F.col("_place") <= k)
        .select(*shown, F.col("_place").alias("rank"))
    )
