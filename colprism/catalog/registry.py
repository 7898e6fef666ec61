"""Registry of the queries over the test tables, each next to its DuckDB oracle."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..sources import results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_STORED: dict[tuple, str] = {}


def stored_once(spark: SparkSession, sf_dir: str, name: str, tables: Iterable[str], store: Callable[[str], None]) -> str:
    """The folder that ``store`` has filled from ``tables``, filled anew when the files of one of them have changed.

    Files are told apart by path, size and time of change, which the file system lists without reading them.
    """
    state = []
    for t in sorted(tables):
        files = spark.read.format("binaryFile").load(f"{sf_dir.rstrip('/')}/{t}.parquet").select("path", "length", "modificationTime")
        state += sorted(map(tuple, files.collect()))
    key = (spark.sparkContext.applicationId, name, hash(tuple(state)))
    if key not in _STORED:
        folder = os.path.join(results.scratch_folder(spark), f"{name}-{os.urandom(8).hex()}")
        store(folder)
        _STORED[key] = folder
    return _STORED[key]
