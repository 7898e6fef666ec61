"""Counts, key candidates and most frequent values over value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .typing import keys


NUMBERS = ["n_rows", "n_non_empty", "n_empty", "n_distinct"]


def column_counts(counts: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Rows, non-empty and empty cells and distinct values of every column.

    With the ``source`` of the counts its columns are listed even if it has no rows.
    """
    if source is not None:
        names = source.sparkSession.createDataFrame(list(enumerate(source.columns)), "column_pos int, column_name string")
        found = column_counts(counts).drop("column_name")
        return names.join(found, "column_pos", "left").fillna(0, NUMBERS)
    blank = F.col("is_blank")
    return counts.groupBy(*keys(counts)).agg(
        F.sum("cnt").alias("n_rows"),
        F.sum(F.when(blank, 0).otherwise(F.col("cnt"))).alias("n_non_empty"),
        F.sum(F.when(blank, F.col("cnt")).otherwise(0)).alias("n_empty"),
        F.count(F.lit(1)).alias("n_distinct"),
    )


def key_candidates(per_column: DataFrame) -> DataFrame:
    """Columns whose values are all different; takes ``column_counts``."""
    return per_column.filter(F.col("n_rows") == F.col("n_distinct"))


def top_frequent(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of every column; ties by value.

    ``row_number() <= k`` lets Spark cut every map partition to k rows per
    column before the shuffle.
    """
    column = [c for c in keys(counts) if c != "column_name"]
    order = Window.partitionBy(*column).orderBy(F.desc("cnt"), "value")
    return (
        counts.select(*keys(counts), "value", "cnt")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )
