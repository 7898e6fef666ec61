"""Semantic labels of column values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import Predicate, build
from ..functions.routing import OTHER, ROUTES, Route, route_key
from ..functions.text import is_junk, normalize_value


def _within(route: Route, value: Column, predicates: Mapping[str, Predicate]) -> Column:
    return reduce(
        lambda rest, kind: F.when(predicates[kind](value), F.lit(kind)).otherwise(rest),
        reversed(route.types),
        F.lit(OTHER),
    )


def label_of(
    key: Column, value: Column, routes: Sequence[Route] = ROUTES, predicates: Mapping[str, Predicate] | None = None
) -> Column:
    """Semantic type of a normalised value under a route key."""
    predicates = predicates or build()
    routed = reduce(
        lambda rest, route: F.when(route.accepts(key), _within(route, value, predicates)).otherwise(rest),
        reversed(routes),
        F.lit(OTHER),
    )
    return F.when(value.isNull() | is_junk(value), F.lit(OTHER)).otherwise(routed)


def label_values(df: DataFrame, routes: Sequence[Route] = ROUTES, predicates: Mapping[str, Predicate] | None = None) -> DataFrame:
    """Add ``semantic_type`` to rows with ``column_name`` and ``value``."""
    prepared = df.withColumn("_key", route_key(F.col("column_name"))).withColumn("_value", normalize_value(F.col("value")))
    label = label_of(F.col("_key"), F.col("_value"), routes, predicates)
    return prepared.withColumn("semantic_type", label).drop("_key", "_value")


def label_counts(labelled: DataFrame) -> DataFrame:
    """Weight of every label per column; only labels, not values, are shuffled."""
    weight = F.col("freq") if "freq" in labelled.columns else F.lit(1).cast("bigint")
    return labelled.groupBy("column_name", "semantic_type").agg(F.sum(weight).alias("count"))


def nest_labels(counts: DataFrame) -> DataFrame:
    """One row per column with its label counts; an array holds at most one entry per semantic type."""
    return counts.groupBy("column_name").agg(
        F.array_sort(F.collect_list(F.struct("semantic_type", "count"))).alias("semantic_types")
    )
