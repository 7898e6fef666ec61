"""Sinks and sources of profile and label results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ID_LENGTH = 9


def dataset_id(name: str) -> str:
    return name[:ID_LENGTH]


def scratch_folder(spark: SparkSession) -> str:
    """Folder for data a job writes and reads back: the shared folder that ``spark.checkpoint.dir`` names.

    Without one a cluster raises an error. A session on one machine gets a folder of its own, removed at exit.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="colprism-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: computed once for several readers, gone with the application."""
    spark, path = frame.sparkSession, f"{scratch_folder(frame.sparkSession)}/{name}-{os.urandom(8).hex()}"
    frame.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(frame.schema).parquet(path)


def write_profile(profile: DataFrame, name: str, out: str) -> None:
    """One folder per dataset, named by its whole name with special characters escaped.

    Overwriting the own folder makes a repeated run replace its result only.
    """
    profile.withColumn("dataset_id", F.lit(dataset_id(name))).write.mode("overwrite").json(os.path.join(out, quote(name, safe="")))


def write_profiles(profiles: DataFrame, out: str) -> None:
    """Documents of many datasets in one job, each in a folder of its own, ``dataset=<name>``.

    Only the folders of these datasets are replaced.
    """
    named = profiles.withColumn("dataset_id", F.substring("dataset_name", 1, ID_LENGTH)).withColumn("dataset", F.col("dataset_name"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").json(out)


PROFILE_SCHEMA = """
    dataset_name string, dataset_id string,
    columns array<struct<
        column_name string, number_non_empty_cells bigint, number_empty_cells bigint, number_distinct_values bigint,
        frequent_values array<string>,
        data_types array<struct<
            type string, count bigint, max_value string, min_value string, mean double, stddev double,
            shortest_values array<string>, longest_values array<string>, average_length double>>>>,
    key_column_candidates array<string>
"""
LABELS_SCHEMA = "column_name string, semantic_types array<struct<semantic_type string, count bigint>>"


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The result documents below ``path``, each in a folder of its own."""
    return spark.read.schema(PROFILE_SCHEMA).option("recursiveFileLookup", True).json(path)


def write_labels(nested: DataFrame, out: str) -> None:
    """One folder per column, ``column=<column name>``."""
    (
        nested.withColumn("column", F.col("column_name"))
        .repartition("column")
        .write.mode("overwrite").partitionBy("column").json(out)
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELS_SCHEMA).json(path).select("column_name", "semantic_types")


def combined_document(records: DataFrame, key: str, root: str) -> DataFrame:
    """All records as the lines of one JSON document ``{"<root>": [ … ]}``.

    Rows (section, key, line); in order of (section, key) the lines are the
    document, also where a key repeats.  Nothing is gathered: the first record
    is the only one without a leading comma.
    """
    first = records.agg(F.min(key).alias("first")).scalar()
    item = F.to_json(F.struct(*[F.col(c) for c in records.columns]))
    same = Window.partitionBy("key").orderBy("item")
    body = records.select(F.col(key).alias("key"), item.alias("item")).withColumn("place", F.row_number().over(same)).select(
        F.lit(1).alias("section"),
        "key",
        F.concat(F.when((F.col("key") == first) & (F.col("place") == 1), "").otherwise(","), "item").alias("line"),
    )
    frame = records.sparkSession.range(2).select(
        F.when(F.col("id") == 0, 0).otherwise(2).alias("section"),
        F.lit("").alias("key"),
        F.when(F.col("id") == 0, F.to_json(F.struct(F.array().alias(root))))
        .otherwise("]}").alias("line"),
    )
    frame = frame.withColumn("line", F.regexp_replace("line", r"\[\]\}$", "["))
    return body.unionByName(frame)


def write_combined(records: DataFrame, key: str, root: str, out: str) -> None:
    """Text files that in order of their names make up one JSON document, a record a line.

    Records are sorted by ranges of their key, a file a range; head and tail are written with the first and the last range.
    """
    lines = combined_document(stored(records, "records"), key, root)
    lines.orderBy("section", "key", F.col("line").startswith(","), "line").select("line").write.mode("overwrite").text(out)


def read_combined(spark: SparkSession, path: str, root: str, schema: str = PROFILE_SCHEMA) -> DataFrame:
    """The records of a document that ``write_combined`` has written, line by line: no task reads the whole of it."""
    lines = spark.read.text(path).where(~F.col("value").isin(f'{{"{root}":[', "]}"))
    return lines.select(F.from_json(F.regexp_replace("value", "^,", ""), schema).alias("r")).select("r.*")
