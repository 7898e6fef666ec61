"""Manual labels: nested JSON and its flat form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MANUAL_SCHEMA = (
    "actual_types array<struct<column_name string, manual_labels array<struct<semantic_type string>>>>"
)


def flatten_manual_labels(documents: DataFrame) -> DataFrame:
    """One row per column and label."""
    columns = documents.select(F.explode("actual_types").alias("c"))
    return columns.select(
        F.col("c.column_name").alias("column_name"),
        F.explode("c.manual_labels.semantic_type").alias("semantic_type"),
    )


def read_manual_labels(spark: SparkSession, path: str, root: str = "$.actual_types") -> DataFrame:
    """One row per column and label of all JSON documents at ``path``, each of any number of lines.

    Documents are read as variants, so what they do not hold is no error: columns without labels, labels without a type
    and text that is no JSON give no rows; a label may also be a plain text.  ``root`` is the path of the columns, ``$`` for
    a document that is the list itself.
    """
    documents = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("document"))
    columns = documents.select(F.explode(F.try_variant_get("document", root, "array<variant>")).alias("c"))
    labels = columns.select(
        F.try_variant_get("c", "$.column_name", "string").alias("column_name"),
        F.explode(F.try_variant_get("c", "$.manual_labels", "array<variant>")).alias("l"),
    )
    named = F.coalesce(F.try_variant_get("l", "$.semantic_type", "string"), F.when(F.schema_of_variant("l") == "STRING", F.try_variant_get("l", "$", "string")))
    return labels.select("column_name", named.alias("semantic_type")).where("column_name IS NOT NULL AND semantic_type IS NOT NULL")
