"""Listing of the datasets in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .results import ID_LENGTH

CATALOG_FILE = "datasets.tsv"


def list_datasets(spark: SparkSession, path: str, pattern: str = "*", skip: str = CATALOG_FILE) -> DataFrame:
    """Name, id and size of every file, smallest first; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return (
        files.select(name.alias("dataset_name"), F.substring(name, 1, ID_LENGTH).alias("dataset_id"), "path", "length")
        .filter(F.col("dataset_name") != skip)
        .orderBy("length", "dataset_name")
    )
