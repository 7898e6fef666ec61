"""Line dedup: drop lines whose normalised form occurs in many documents, except in one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written

STRIPPED = " \t\n\x0b\x0c\r"


def _key(line):
    trimmed = F.trim(line, F.lit(STRIPPED))
    return F.translate(trimmed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def drop_repeated_lines(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                        min_length: int = 20, min_documents: int = 3) -> DataFrame:
    """Texts without the lines that at least ``min_documents`` documents hold; the largest id that holds a line keeps it.

    A line's key is the line without white space at its ends and with A-Z lower-cased; keys under ``min_length``
    code points never count. Rows: id, ``text`` (what is left), ``n_lines`` (before), ``n_dropped``.

    Only native functions. Lines are exploded without their text: (id, position, digest of the key). Documents per
    digest are counted with partial aggregates by (digest, id), then by digest, so a line that a third of the
    documents hold crosses the shuffle once per document and then once per task. Only positions of dropped lines
    return to the documents; an array of kept positions (a hash set difference) puts the text together again.

    Null text: one empty line. Repeated rows: one document, counted once per id; each row gets its result. Rows of
    one id with different texts: the id holds the lines of all of them, and each row is judged by its own lines.
    Null id: no document that counts; its lines go where the other documents alone reach the threshold.
    """
    docs = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("body"))
    docs = docs.withColumn("mark", F.xxhash64("body"))
    lines = docs.select("id", "mark", F.posexplode(F.split("body", "\n", -1)).alias("place", "line"))
    keyed = (
        lines.select("id", "mark", "place", _key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_length)
        .select("id", "mark", "place", F.unhex(F.md5(F.col("key").cast("binary"))).alias("digest"))
    )
    repeated = (
        keyed.groupBy("digest").agg(F.count_distinct("id").alias("documents"), F.max("id").alias("keeper"))
        .where(F.col("documents") >= min_documents).select("digest", "keeper")
    )
    repeated = written(repeated, "repeated-lines")  # a plain side of the join: Spark can then split a digest's rows
    gone = (
        keyed.join(repeated, "digest")
        .where(F.col("id").isNull() | (F.col("id") < F.col("keeper")))
        .select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark"), "place").distinct()
        .groupBy("gone_id", "gone_mark").agg(F.collect_list("place").alias("places"))
    )
    split = F.split("body", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.coalesce("places", F.array().cast("array<int>")))
    joined = docs.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left")
    return joined.select(
        F.col("id").alias(id_column),
        F.when(F.col("places").isNull(), F.col("body"))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")).alias("text"),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )
