"""Tab-separated inputs: datasets with header, and column files of (value, frequency)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.routing import column_of_file
from .results import stored


def has_multiline_fields(spark: SparkSession, path: str) -> bool:
    """Whether some quoted field may run over a line end.

    Quoted fields that begin and end in their line, doubled quotes included, are cut out; a quote that
    is left may open a longer field.  A parallel scan that stops at the first
    such line.
    """
    closed = r'(?<=^|\t)"(?:[^"\\]|"")*+"(?=\t|$)'
    lines = spark.read.text(path).filter(F.col("value").contains('"'))
    return not lines.filter(F.regexp_replace("value", closed, "").contains('"')).isEmpty()


def read_tsv(spark: SparkSession, path: str, raw: bool = False, multi_line: bool | None = None) -> DataFrame:
    """TSV with header and inferred types (``raw``: all columns as text).

    A multi-line read takes each file in one task, so by default it is used
    only where ``has_multiline_fields`` asks for it; otherwise files are split.
    Dates infer as timestamps.
    """
    if multi_line is None:
        multi_line = has_multiline_fields(spark, path)
    reader = spark.read.option("preferDate", False)
    return reader.csv(path, sep="\t", header=True, inferSchema=not raw, multiLine=multi_line)


#: Rows of a value file; columns of more are a folder of such files.
FILE_ROWS = 250_000


def _value_file(metadata: str = "_metadata") -> Column:
    """The name of a column's file: of the file itself, or of its folder where the column is written in parts."""
    path = F.url_decode(F.replace(F.col(f"{metadata}.file_path"), F.lit("+"), F.lit("%2B")))
    folder = F.element_at(F.split(path, "/"), -2)
    return F.when(folder.endswith(".txt.gz"), folder).otherwise(F.col(f"{metadata}.file_name"))


def read_value_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All column files in one read: column_name, value, freq (1 where absent or no number).

    A column is a file ``<name>.txt.gz``, which one task reads, or a folder of that name with files of any names.
    """
    rows = spark.read.schema("value string, freq string").option("recursiveFileLookup", True).csv(paths, sep="\t")
    return rows.select(
        column_of_file(_value_file()).alias("column_name"),
        "value",
        F.coalesce(F.col("freq").try_cast("bigint"), F.lit(1)).alias("freq"),
    )


def name_files(spark: SparkSession, folder: str, names: dict[str, str], out: str) -> None:
    """Move the files of each partition folder (``key=value``) of ``folder`` to ``out`` under a name of its own.

    A lone file takes the name; several stay together in a folder of that name.  One move per name, on the file system that
    holds them; contents are not read.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(out))
    for part, name in names.items():
        written = [f.getPath() for f in files.listStatus(path(f"{folder}/{part}")) if f.getPath().getName().startswith("part-")]
        moved = written[0] if len(written) == 1 else path(f"{folder}/{part}")
        if not written or not files.rename(moved, path(f"{out}/{name}")):
            raise OSError(f"{folder}/{part} does not hold files that can be moved")


def write_value_files(values: DataFrame, out: str, dataset_id: str, without_counts: Sequence[str] = (), file_rows: int = FILE_ROWS) -> None:
    """A gzip file ``<dataset id>.<column>.txt.gz`` per column, as ``read_value_files`` reads them.

    Takes column_name, value and freq; columns of over ``file_rows`` rows are a folder of that name with files of about so
    many, each written by a task of its own.  Columns ``without_counts`` have their values repeated instead.
    """
    spark, work = values.sparkSession, f"{out}-parts"
    values = stored(values.select("column_name", "value", "freq"), "values")
    lone = F.col("column_name").isin(list(without_counts))
    sizes = values.groupBy("column_name").agg(F.sum(F.when(lone, F.col("freq")).otherwise(1)).alias("n"), F.first(lone).alias("lone")).collect()
    copies = F.explode(F.sequence(F.lit(1), F.col("freq").cast("int")))
    counted, repeated = values.select("*", F.lit(0).alias("copy")), values.select("column_name", "value", copies.alias("copy"))
    for rows, name, kind in ((counted.filter(~lone), "counted", False), (repeated.filter(lone), "plain", True)):
        parts = {r["column_name"]: max(1, -(-r["n"] // file_rows)) for r in sizes if r["lone"] == kind}
        if not parts:
            continue
        # Each column takes as many partitions of its own as it has files.
        first, total = {}, 0
        for column, n in parts.items():
            first[column], total = total, total + n
        of = lambda numbers: F.create_map(*[F.lit(x) for c, n in numbers.items() for x in (c, n)])[F.col("column_name")]
        part = of(first) + F.pmod(F.xxhash64("value", "copy"), of(parts)).cast("int")
        (
            rows.repartitionById(total, part.cast("int")).drop("copy").write.partitionBy("column_name").option("compression", "gzip")
            .csv(f"{work}/{name}", sep="\t", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        )
        name_files(spark, f"{work}/{name}", {f"column_name={c}": f"{dataset_id}.{c}.txt.gz" for c in parts}, out)


def parse_column_list(lines: DataFrame) -> DataFrame:
    """``['a.txt.gz', 'b.txt.gz']`` in column ``value`` -> distinct file names."""
    items = lines.select(F.explode(F.split("value", r",\s*")).alias("item"))
    return (
        items.select(F.regexp_replace("item", r"^[\s\['\"]+|[\s\]'\"]+$", "").alias("file_name"))
        .filter(F.col("file_name") != "")
        .distinct()
    )


def read_column_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_column_list(spark.read.text(path))


def date_like_columns(df: DataFrame) -> list[str]:
    """Columns of a date or time type, or with ``date`` or ``time`` in the name."""
    return [
        f.name for f in df.schema.fields
        if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
        or "date" in f.name.lower() or "time" in f.name.lower()
    ]


def date_like_sample(df: DataFrame, k: int = 5) -> DataFrame:
    """The first k distinct values, in their order as text, of every date-like column."""
    from ..operators.cells import value_counts
    from pyspark.sql import Window

    names = date_like_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, rank int, value string")
    counts = value_counts(df.select(*[F.col(f"`{n}`") for n in names]))
    order = Window.partitionBy("column_pos").orderBy("value")
    return (
        counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("column_name", "rank", "value")
    )
