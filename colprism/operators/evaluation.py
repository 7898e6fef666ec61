"""Predicted labels against manual labels, by column and presence of a type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.routing import SEMANTIC_TYPES

PAIR = ["column_name", "semantic_type"]


def label_matches(predicted: DataFrame, manual: DataFrame) -> DataFrame:
    """Predicted (column, type) pairs confirmed by a manual label."""
    return predicted.select(*PAIR).distinct().join(manual.select(*PAIR), PAIR, "left_semi")


def unlabelled_columns(predicted: DataFrame, manual: DataFrame) -> DataFrame:
    """Predicted columns without any manual label; they take no part in the evaluation."""
    return predicted.select("column_name").distinct().join(manual.select("column_name"), "column_name", "left_anti")


def type_table(spark, types: Sequence[str] = SEMANTIC_TYPES) -> DataFrame:
    return spark.createDataFrame(list(enumerate(types)), "type_pos int, semantic_type string")


def precision_recall(predicted: DataFrame, manual: DataFrame, types: Sequence[str] = SEMANTIC_TYPES) -> DataFrame:
    """Per type: matched, predicted and manual columns, precision and recall.

    One pass: both sides are marked and grouped by (column, type), then by
    type.  A type without a match has precision and recall 0.
    """
    labelled = manual.select("column_name").distinct()
    marked = (
        predicted.select(*PAIR).join(labelled, "column_name", "left_semi")
        .select(*PAIR, F.lit(1).alias("p"), F.lit(0).alias("m"))
        .unionByName(manual.select(*PAIR, F.lit(0).alias("p"), F.lit(1).alias("m")))
    )
    pairs = marked.groupBy(*PAIR).agg(F.max("p").alias("p"), F.max("m").alias("m"))
    per_type = pairs.groupBy("semantic_type").agg(
        F.sum(F.col("p") * F.col("m")).alias("match"), F.sum("p").alias("pred"), F.sum("m").alias("manual")
    )
    listed = type_table(predicted.sparkSession, types).join(per_type, "semantic_type", "left")
    return with_rates(listed.select(
        "type_pos", "semantic_type",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("match", "pred", "manual")],
    ))


def with_rates(counts: DataFrame) -> DataFrame:
    """Add precision and recall to columns match, pred and manual."""
    rate = lambda whole: F.coalesce(F.try_divide(F.col("match"), F.col(whole)), F.lit(0.0))
    return counts.withColumn("precision", rate("pred")).withColumn("recall", rate("manual"))


def macro_average(rates: DataFrame) -> DataFrame:
    return rates.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def macro_average_delta(first: DataFrame, second: DataFrame) -> DataFrame:
    """Macro averages of two runs and their difference (second - first), per measure."""
    both = run_comparison(first, second)
    return both.groupBy("measure").agg(
        F.avg("first").alias("first"), F.avg("second").alias("second"), F.avg(F.col("second") - F.col("first")).alias("change")
    )


def run_comparison(first: DataFrame, second: DataFrame) -> DataFrame:
    """Precision and recall per type of two runs, a row per type and measure."""
    rates = lambda df, run: df.select("type_pos", "semantic_type", "precision", "recall").unpivot(
        ["type_pos", "semantic_type"], ["precision", "recall"], "measure", run
    )
    return rates(first, "first").join(rates(second, "second"), ["type_pos", "semantic_type", "measure"])
