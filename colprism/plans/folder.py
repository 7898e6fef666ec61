"""Profiles of a folder of many small datasets in one job.

A plan per dataset costs more than the work where there are thousands of small
ones.  Here all cells of all files stand in one table keyed by dataset and
column position; records, types and profiles are columns of it, so planning
does not grow with the number of datasets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.detect import DATETIME, INTEGER, REAL, TEXT
from ..operators import typing as Y
from ..operators.cells import SLOTS, blank_cell, value_text
from ..sources import results
from ..sources.listing import list_datasets
from ..sources.records import split_records
from .profile import TOP, assembled, nested

#: Bytes of a file that is read as one row; larger ones are split at their lines, with the same records.
LARGEST = 16 << 20
#: Records of a text: fields between tabs, where a field in quotes may hold tabs and line ends up to a quote without a backslash, or to the end.
_FIELD = r'(?:"(?:[^"\\]++|\\.)*+(?:"[^\t\r\n]*+|\\?\z)|[^\t\r\n]*+)'
_RECORD = rf"(?s)({_FIELD}(?:\t{_FIELD})*+)(?:\r\n|\r|\n|$)"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_records(spark: SparkSession, path: str, dataset_of: Callable[[Column], Column] = file_name, largest: int = LARGEST) -> DataFrame:
    """(dataset_name, path, place, record) of all files; a file that cannot be read gives no row.

    Records may run over line ends inside quotes.  Blank ones are left out; the first of a file, its header, has place 0.
    Files up to ``largest`` bytes are a row each and cut by one pattern; larger ones go by ``split_records``.
    """
    whole = _whole_files(spark, path, dataset_of, largest)
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
    if sizes.where(F.col("length") > largest).isEmpty():
        return whole
    return whole.unionByName(split_records(spark, path, dataset_of, largest))


def _whole_files(spark: SparkSession, path: str, dataset_of: Callable[[Column], Column], largest: int) -> DataFrame:
    files = spark.read.option("ignoreCorruptFiles", True).text(path, wholetext=True, recursiveFileLookup=True)
    files = files.where(F.col("_metadata.file_size") <= largest).select(F.col("_metadata.file_path").alias("path"), "value")
    found = F.filter(F.regexp_extract_all("value", F.lit(_RECORD), 1), lambda r: r != "")
    return files.select(dataset_of(F.col("path")).alias("dataset_name"), "path", F.posexplode(found).alias("place", "record"))


def _headers(records: DataFrame) -> DataFrame:
    """(dataset_name, column_pos, column_name): header cells by the reader's rules for missing and repeated names."""
    first = records.where("place = 0").groupBy("dataset_name").agg(F.min(F.struct("path", "record"))["record"].alias("record"))
    return first.select("dataset_name", "record", F.size(F.regexp_extract_all("record", F.lit(rf"(?s)(?:^|\t){_FIELD}"), 0)).alias("width"))


def _parsed(records: DataFrame, width: int) -> DataFrame:
    """``records`` with ``cells``, an array of ``width`` texts; null where the reader has null."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    row = F.from_csv("record", F.lit(schema), {"sep": "\t", "multiLine": "true", "maxColumns": str(max(20480, width + 1))})
    return records.withColumn("_row", row).withColumn("cells", F.array(*[F.col(f"_row.c{i}") for i in range(width)])).drop("_row")


def _names(headers: DataFrame, width: int) -> DataFrame:
    known = _parsed(headers, width).select("dataset_name", F.slice("cells", F.lit(1), F.col("width")).alias("names"))
    alike = lambda name: F.size(F.filter("names", lambda n: F.lower(n) == F.lower(name)))
    safe = F.transform("names", lambda name, i: F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("_c"), i.cast("string")))
                       .when(alike(name) > 1, F.concat(name, i.cast("string"))).otherwise(name))
    return known.select("dataset_name", F.posexplode(safe).alias("column_pos", "column_name"))


def _raw_counts(records: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """(dataset_name, column_pos, raw, cnt): every distinct cell as it stands in the files, null where it is empty."""
    widths = names.groupBy("dataset_name").agg(F.count(F.lit(1)).cast("int").alias("width"))
    rows = _parsed(records.where("place > 0"), width).select("dataset_name", "cells").join(widths, "dataset_name")
    cells = rows.select("dataset_name", F.posexplode(F.slice("cells", F.lit(1), F.col("width"))).alias("column_pos", "raw"))
    return cells.groupBy("dataset_name", "column_pos", "raw").agg(F.count(F.lit(1)).alias("cnt"))


_WHOLE, _REAL, _MOMENT, _FLAG, _TEXT = range(5)


def _tests(raw: Column) -> dict[str, Column]:
    """Whether a cell reads as each of the types; null for an empty one."""
    whole = raw.rlike(r"^[+-]?[0-9]+$")
    return {
        "is_whole": whole & raw.try_cast("bigint").isNotNull(),
        "is_real": raw.try_cast("double").isNotNull(),
        "is_moment": raw.try_cast("timestamp").isNotNull(),
        "is_flag": F.lower(raw).isin("true", "false"),
        "is_digits": whole & (F.length(raw) <= 38),
    }


def _inferred(counts: DataFrame) -> DataFrame:
    """The type of each column by all its cells, in the order of the reader: whole numbers, reals, moments, flags, else text.

    A type holds if each cell that is not empty reads as it.  Whole numbers that no long holds make a column REAL.
    """
    tests = {n: F.when(F.col("raw").isNotNull(), t) for n, t in _tests(F.col("raw")).items()}
    flags = counts.where("raw IS NOT NULL").groupBy("dataset_name", "column_pos").agg(*[F.min(t.cast("int")).alias(n) for n, t in tests.items()])
    kind = F.when(F.col("is_whole") == 1, _WHOLE).when(F.col("is_real") == 1, _REAL).when(F.col("is_moment") == 1, _MOMENT).when(F.col("is_flag") == 1, _FLAG).otherwise(_TEXT)
    return flags.select("dataset_name", "column_pos", kind.alias("kind"), (F.col("is_digits") == 1).alias("digits"))


def _slot_counts(counts: DataFrame, kinds: DataFrame) -> DataFrame:
    """Distinct typed values: cells that read alike (``7``, ``007``) are counted together."""
    by, kind, raw = ["dataset_name", "column_pos"], F.col("kind"), F.col("raw")
    rows = counts.join(kinds, by, "left").withColumn("kind", F.coalesce("kind", F.lit(_TEXT)))
    whole = F.when(kind == _WHOLE, raw.try_cast("bigint"))
    real = F.when(kind == _REAL, raw.try_cast("double"))
    moment = F.when(kind == _MOMENT, raw.try_cast("timestamp").cast("timestamp_ntz"))
    # Grouping merges the two zeros, their texts differ.
    zero = F.when((real == 0) & (real.cast("string") == "-0.0"), "-0.0")
    text = (F.when(kind == _REAL, F.when(F.col("digits"), raw.try_cast("decimal(38,0)").cast("string")).otherwise(zero))
            .when(kind == _FLAG, F.initcap(F.lower(raw))).when(kind == _TEXT, F.nullif(raw, F.lit(""))))
    typed = {"whole": whole, "real": real, "moment": moment, "text": text}
    schema = F.when(kind == _WHOLE, INTEGER).when(kind == _REAL, REAL).when(kind == _MOMENT, DATETIME).otherwise(TEXT)
    rows = rows.select(*by, schema.alias("schema_type"), *[typed[s].alias(s) for s in SLOTS], "cnt")
    rows = rows.groupBy(*by, "schema_type", *SLOTS).agg(F.sum("cnt").alias("cnt"))
    return rows.select(*by, "schema_type", value_text().alias("value"), blank_cell().alias("is_blank"), *SLOTS, "cnt")


def profile_files(spark: SparkSession, path: str, dataset_of: Callable[[Column], Column] = file_name, largest: int = LARGEST,
                  empty_as_text: bool = True, k: int = TOP) -> DataFrame:
    """The profiles of all datasets of a folder, each as ``profile_dataset`` gives it, from one job.

    A dataset is the files of one ``dataset_of`` (path); each begins with the header.  Files without a record are left out.
    Types are inferred from all cells.
    """
    records = results.stored(read_records(spark, path, dataset_of, largest), "records")
    headers = results.stored(_headers(records), "headers")
    width = headers.agg(F.max("width")).first()[0]
    if not width:
        return spark.createDataFrame([], results.PROFILE_SCHEMA).drop("dataset_id")
    names = results.stored(_names(headers, width), "names")
    counts = results.stored(_raw_counts(records, names, width), "raw-counts")
    slots = _slot_counts(counts, _inferred(counts))
    typed = results.stored(Y.typed(slots, empty_as_text, keep=("is_blank",)), "typed")
    return nested(assembled(typed, names, k, known=results.stored(Y.summaries(typed), "summaries")))


def profile_folder(spark: SparkSession, path: str, out: str, **options) -> DataFrame:
    """Profile every dataset file below ``path`` in one job and write one document each below ``out``; returns name, status and error.

    A file that cannot be read, or holds no record, fails alone: its status says so and the others are finished.  Files of
    no bytes are not listed.
    """
    listed = list_datasets(spark, path).select("dataset_name")
    profiles = results.stored(profile_files(spark, path, **options), "profiles")
    results.write_profiles(profiles, out)
    status = listed.join(profiles.select("dataset_name", F.lit("finished").alias("status")), "dataset_name", "left")
    return status.select("dataset_name", F.coalesce("status", F.lit("failed")).alias("status"),
                         F.when(F.col("status").isNull(), "NoRecords: the file holds no record or cannot be read").alias("error"))


def read_tsv_records(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """What ``read_tsv`` gives for files whose records run over line ends, but split over all tasks.

    Whole numbers read as bigint; those that no bigint holds make a column decimal(38,0).
    """
    records = results.stored(split_records(spark, path, lambda path: F.lit("all")), "records")
    headers = _headers(records)
    width = headers.agg(F.max("width")).first()[0]
    if not width:
        return spark.createDataFrame([], "_c0 string").drop("_c0")
    names = [r["column_name"] for r in _names(headers, width).orderBy("column_pos").collect()]
    cells = _parsed(records.where("place > 0"), width).select(*[F.col("cells")[i].alias(n) for i, n in enumerate(names)])
    if raw:
        return cells
    quoted = [F.col("`" + n.replace("`", "``") + "`") for n in names]
    found = cells.select(*[F.min(F.when(c.isNotNull(), t).cast("int")).alias(f"{kind}{i}") for i, c in enumerate(quoted) for kind, t in _tests(c).items()]).first()
    kinds = {"is_whole": "bigint", "is_digits": "decimal(38,0)", "is_real": "double", "is_moment": "timestamp", "is_flag": "boolean"}
    typed = [next((t for kind, t in kinds.items() if found[f"{kind}{i}"] == 1), "string") for i in range(len(names))]
    return cells.select(*[c.try_cast(t).alias(n) for c, t, n in zip(quoted, typed, names)])
