"""Profile of a whole dataset as one nested row, and of many datasets.

Distinct values are counted in one ``(column, value)`` exchange, typed once and
stored; all parts of a profile read that store, each only the columns it needs,
and meet again in one group per column.  What is collected into arrays is
bounded: k values, at most four types per column, the columns of a schema.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import counts as C, typing as Y, wide as W
from ..operators.cells import value_counts
from ..sources import results

TOP = 5
LISTS = ["frequent_values", "shortest_values", "longest_values"]


def _by(df: DataFrame) -> list[str]:
    """The key of a column: its place, and its dataset where a table holds the columns of several."""
    return [c for c in ("dataset_name", "column_pos") if c in df.columns]


def _shown_values(typed: DataFrame, k: int, source: DataFrame | None) -> DataFrame:
    """The values a profile shows, at most 3 k per column: list, rank, value; from the ``source`` where ``typed`` holds stand-ins.

    Spark 4.1 takes a union of frames dealt alike for one dealt alike, and then merges the partitions of each at run
    time in another way; so the column's number is an expression, by which the frames are not dealt.
    """
    if source is None:
        frames = [C.top_frequent(typed, k), Y.text_by_length(typed, longest=False, k=k), Y.text_by_length(typed, longest=True, k=k)]
    else:
        frames = [W.top_frequent(typed, source, k), *[W.text_by_length(typed, source, longest, k) for longest in (False, True)]]
    by = [c for c in _by(typed) if c != "column_pos"]
    return reduce(DataFrame.unionByName, [
        frame.select(F.lit(name).alias("list"), *by, F.expr("column_pos | 0").alias("column_pos"), "rank", "value")
        for name, frame in zip(LISTS, frames)
    ])


def _lists(shown: DataFrame) -> DataFrame:
    """One row per column with the shown values as arrays in order of rank."""
    member = lambda name: F.when(F.col("list") == name, F.struct("rank", "value"))
    return shown.groupBy(*_by(shown)).agg(
        *[F.transform(F.array_sort(F.collect_list(member(name))), lambda r: r["value"]).alias(name) for name in LISTS]
    )


def assembled(typed: DataFrame, names: DataFrame, k: int = TOP, source: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """One row per column of ``names`` (key, column_name) with counts, most frequent values and an array of type entries.

    ``typed`` holds the typed distinct values of one dataset or, with ``dataset_name``, of many; with ``source``, those of
    ``operators.wide`` of that one dataset.  With ``known`` summaries of the types they are not computed, twice, from ``typed``.
    """
    by = _by(typed)
    ends = Y.extremes(typed, known).select(*by, "type", "max_value", "min_value")
    types = Y.full_stats(typed, known).join(ends, [*by, "type"], "left")
    lists = _lists(_shown_values(typed, k, source))
    types = types.join(lists.drop("frequent_values"), by, "left")
    is_text = F.col("type") == Y.D.TEXT
    entry = F.struct(
        F.col("type"),
        F.col("count"),
        F.col("max_value"),
        F.col("min_value"),
        F.col("mean"),
        F.col("stddev"),
        F.when(is_text, F.col("shortest_values")).alias("shortest_values"),
        F.when(is_text, F.col("longest_values")).alias("longest_values"),
        F.col("average_length"),
    )
    entries = types.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("data_types"))
    entries = entries.withColumn("data_types", F.filter("data_types", lambda e: e["type"] != Y.UNTYPED))
    counted = names.join(C.column_counts(typed).drop("column_name"), by, "left").fillna(0, C.NUMBERS)
    return (
        counted.join(lists.select(*by, "frequent_values"), by, "left")
        .join(entries, by, "left")
        .select(
            *by, "column_name", *C.NUMBERS,
            F.coalesce("frequent_values", F.array().cast("array<string>")).alias("frequent_values"),
            F.coalesce("data_types", F.array().cast(entries.schema["data_types"].dataType)).alias("data_types"),
        )
    )


def column_profiles(
    df: DataFrame,
    empty_as_text: bool = True,
    k: int = TOP,
    store: bool = True,
    wide: bool = False,
) -> DataFrame:
    """One row per column with counts, most frequent values and an array of type entries.

    Values are compared whole, whatever their length; ties are broken by value.  The typed values are written to the
    shared folder at once; without ``store`` nothing runs yet, and every part of the profile will type them anew.
    With ``wide`` long texts stay in the source, which is read again for those that are shown; the profile is the same.
    """
    typed = W.typed(W.value_counts(df), empty_as_text) if wide else Y.typed(value_counts(df), empty_as_text, keep=("is_blank",))
    # Starts from the schema, so that a table without rows still lists its columns.
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "column_pos int, column_name string")
    if not store:
        return assembled(typed, names, k, df if wide else None)
    typed = results.stored(typed, "typed")
    return assembled(typed, names, k, df if wide else None, results.stored(Y.summaries(typed), "summaries"))


def nested(columns: DataFrame) -> DataFrame:
    """Column profiles -> one row per dataset: columns[], key_column_candidates[]."""
    record = F.struct(
        F.col("column_pos"),
        F.struct(
            "column_name",
            F.col("n_non_empty").alias("number_non_empty_cells"),
            F.col("n_empty").alias("number_empty_cells"),
            F.col("n_distinct").alias("number_distinct_values"),
            "frequent_values",
            "data_types",
        ).alias("column"),
        (F.col("n_rows") == F.col("n_distinct")).alias("is_key"),
    )
    by = [c for c in _by(columns) if c != "column_pos"]
    gathered = columns.groupBy(*by).agg(F.array_sort(F.collect_list(record)).alias("records"))
    keys: Column = F.transform(F.filter("records", lambda r: r["is_key"]), lambda r: r["column"]["column_name"])
    return gathered.select(
        *by,
        F.transform("records", lambda r: r["column"]).alias("columns"),
        keys.alias("key_column_candidates"),
    )


def profile_dataset(df: DataFrame, dataset_name: str, **options) -> DataFrame:
    """The whole profile as one row: dataset_name, columns[], key_column_candidates[]."""
    return nested(column_profiles(df, **options)).select(F.lit(dataset_name).alias("dataset_name"), "*")


def profile_datasets(
    spark: SparkSession,
    readers: Mapping[str, Callable[[], DataFrame]],
    out: str | None = None,
    parallel: int = 4,
    **options,
) -> DataFrame:
    """Profile many datasets; one failing does not stop the others.

    ``readers`` maps a dataset name to a function that opens it.  Each profile
    is written below ``out`` under its dataset's name; with no ``out`` it is only
    planned, and its status says so.  ``parallel`` jobs are in flight at a time, so small datasets
    share the cluster.  Returns one row per dataset: name, status, error.
    """

    def one(item):
        name, open_dataset = item
        try:
            profile = profile_dataset(open_dataset(), name, **{"store": out is not None, **options})
            if out is None:
                return name, "planned", None
            results.write_profile(profile, name, out)
            return name, "finished", None
        except Exception as problem:  # a dataset that cannot be read or typed is reported, not raised
            return name, "failed", f"{type(problem).__name__}: {problem}"

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        rows = list(pool.map(one, readers.items()))
    return spark.createDataFrame(rows, "dataset_name string, status string, error string")
