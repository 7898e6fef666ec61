"""Report series over the profiles and labels of many datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.detect import DATETIME, INTEGER, REAL, TEXT

SERIES = {INTEGER: "n_integer", REAL: "n_real", DATETIME: "n_datetime", TEXT: "n_text"}
LETTERS = {INTEGER: "I", REAL: "R", DATETIME: "D", TEXT: "T"}


def column_types(profiles: DataFrame) -> DataFrame:
    """Nested profiles -> dataset_name, column_name, types (array, possibly empty).

    ``typing.types_per_column`` gives the same form straight from typed cells.
    """
    column = F.explode("columns")
    return profiles.select("dataset_name", column.alias("c")).select(
        "dataset_name", F.col("c.column_name").alias("column_name"), F.col("c.data_types.type").alias("types")
    )


def _contains(kind: str) -> Column:
    if kind == TEXT:  # an unknown type counts as text
        known = [F.lit(k) for k in (INTEGER, REAL, DATETIME)]
        return F.size(F.array_except("types", F.array(*known))) > 0
    return F.array_contains("types", kind)


def type_counts_by_dataset(columns: DataFrame) -> DataFrame:
    """Per dataset the number of columns that contain each type."""
    return columns.groupBy("dataset_name").agg(
        *[F.count_if(_contains(kind)).alias(name) for kind, name in SERIES.items()]
    )


def type_totals(by_dataset: DataFrame) -> DataFrame:
    return by_dataset.agg(*[F.sum(name).alias(name) for name in SERIES.values()])


def untyped_columns(columns: DataFrame) -> DataFrame:
    return columns.filter(F.size("types") == 0).select("dataset_name", "column_name")


def type_set_code(types: Column) -> Column:
    """Letters of the types in the order I, R, D, T; ``Empty`` for none."""
    letters = F.concat(*[F.when(F.array_contains(types, k), letter).otherwise("") for k, letter in LETTERS.items()])
    unknown = F.size(F.array_except(types, F.array(*[F.lit(k) for k in LETTERS]))) > 0
    return F.when((letters == "") | unknown, "Empty").otherwise(letters)


def type_set_frequency(columns: DataFrame) -> DataFrame:
    """Columns per type set, shortest codes first."""
    coded = columns.groupBy(type_set_code(F.col("types")).alias("code")).agg(F.count(F.lit(1)).alias("n_columns"))
    return coded.orderBy(F.length("code"), "code")


def histogram_equal_width(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``bins`` equal bins from minimum to maximum, the last one closed; empty bins are listed.

    If all values are equal the range is widened by 0.5 on both sides. NaN and
    infinite values lie in no bin and are left out, as nulls are.
    """
    x = df.select(F.col(column).cast("double").alias("x")).filter(F.abs("x") < float("inf"))
    span = x.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    same = F.col("low") == F.col("high")
    span = span.select(
        F.when(same, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(same, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    )
    low, high = span.select("low").scalar(), span.select("high").scalar()
    width = (high - low) / bins
    edge = lambda i: low + i * width
    guess = F.least(F.floor((F.col("x") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    # The division may round over an edge: compare with the edges themselves.
    placed = x.withColumn("guess", guess).withColumn(
        "bin",
        F.when(F.col("x") < edge(F.col("guess")), F.col("guess") - 1)
        .when((F.col("guess") < bins - 1) & (F.col("x") >= edge(F.col("guess") + 1)), F.col("guess") + 1)
        .otherwise(F.col("guess")),
    )
    counted = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n")
    )


DEFAULT_EDGES = list(range(0, 101, 5))


def histogram_fixed_edges(df: DataFrame, column: str, edges: Sequence[float] = DEFAULT_EDGES) -> DataFrame:
    """Bins between given edges, the last one closed; values outside are left out."""
    edges = [float(e) for e in edges]
    if len(edges) < 2 or edges != sorted(set(edges)):
        raise ValueError("edges must rise")
    last = len(edges) - 2
    x = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").between(edges[0], edges[-1]))
    inner = F.array(*[F.lit(e) for e in edges])
    # width_bucket on an array of edges is not at hand: count the inner edges at or below x.
    place = F.least(F.size(F.filter(inner, lambda e: e <= F.col("x"))) - 1, F.lit(last))
    counted = x.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", F.element_at(inner, F.col("bin") + 1).alias("low"), F.element_at(inner, F.col("bin") + 2).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def labels_per_column(label_counts: DataFrame) -> DataFrame:
    """Number of semantic types of every column; takes a row per column and type."""
    return label_counts.groupBy("column_name").agg(F.countDistinct("semantic_type").alias("n_types"))


def heterogeneity(per_column: DataFrame) -> DataFrame:
    """Columns per number of semantic types."""
    return per_column.groupBy("n_types").agg(F.count(F.lit(1)).alias("n_columns")).orderBy("n_types")
