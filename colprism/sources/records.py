"""Records of delimited text that run over line ends, read by all tasks.

Spark reads such files whole, one task each.  Here files are split at any line: each line says what it makes of a quote
that is open before it and of one that is not, and a two-level prefix (lines of a block, then blocks of a file) of those
answers tells for every line whether it begins a record.  Only lines of records that hold several are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import results

# Inside quotes: anything but a quote without a backslash, as the reader has it. A field that is whole within its line, and one that is not.
_INSIDE = r'(?:[^"\\]++|\\.)*+'
_WHOLE = rf'(?:"{_INSIDE}"[^\t]*+|[^\t"][^\t]*+|)'
_OPENS = rf'"{_INSIDE}\\?$'
#: A line that begins outside quotes and ends inside; lines that begin inside and end there.
LEAVES_OPEN = rf"^(?:{_WHOLE}\t)*+{_OPENS}"
STAYS_OPEN = rf'^{_INSIDE}\\?$'
OPENS_AGAIN = rf'^{_INSIDE}"[^\t]*+(?:\t{_WHOLE})*+\t{_OPENS}'


def _after(start: Column, last: Column, swaps: Column) -> Column:
    """Whether a quote is open after lines that, since the ``last`` one to settle it (its answer and the swaps before it), swap so often."""
    settled = last["open"] != ((swaps - last["swaps"]) % 2 == 1)
    return F.when(last.isNull(), start != (swaps % 2 == 1)).otherwise(settled)


def split_records(spark: SparkSession, path, dataset_of: Callable[[Column], Column], least: int = 0) -> DataFrame:
    """(dataset_name, path, place, record) of the files over ``least`` bytes; place is 0 for the first record of a file, else 1.

    A line either settles whether a quote is open after it, or keeps what was, or swaps it.  The state before a line follows
    from the last line that settled it and the number of swaps since; blocks (splits of a file) pass it on the same way.
    Lines of a record are joined by ``\\n``.  Blank records are left out; a quote that never closes takes the rest of its file.
    """
    lines = spark.read.option("ignoreCorruptFiles", True).text(path, recursiveFileLookup=True)
    lines = lines.where(F.col("_metadata.file_size") > least).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    quoted = F.col("value").contains('"')
    opens = quoted & F.col("value").rlike(LEAVES_OPEN)
    stays = ~quoted | F.col("value").rlike(STAYS_OPEN) | F.col("value").rlike(OPENS_AGAIN)
    lines = results.stored(lines.select("*", opens.alias("opens"), stays.alias("stays")), "lines")

    in_block = Window.partitionBy("path", "block").orderBy("id")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("opens") & ~F.col("stays")).cast("long")
    rows = lines.select("*", F.coalesce(F.sum(swap).over(before), F.lit(0)).alias("swaps"))
    settles = F.when(F.col("opens") == F.col("stays"), F.struct(F.col("opens").alias("open"), "swaps"))
    rows = rows.select("*", F.last(settles, ignorenulls=True).over(before).alias("last"), settles.alias("own"), swap.alias("swap"))

    # A row per block: the state that it leaves, by the state that it finds.
    place = F.struct("id")
    ends = rows.groupBy("path", "block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), place)).alias("own"), F.sum("swap").alias("all"))
    blocks = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("path", "block", "own", "all", F.coalesce(F.sum("all").over(blocks), F.lit(0)).alias("sum"))
    shifted = F.when(F.col("own").isNotNull(), F.struct(F.col("own.open").alias("open"), (F.col("own.swaps") + F.col("sum")).alias("swaps")))
    ends = ends.select("path", "block", _after(F.lit(False), F.last(shifted, ignorenulls=True).over(blocks), F.col("sum")).alias("found"))

    rows = rows.join(ends, ["path", "block"]).select("path", "block", "id", "value", (~_after(F.col("found"), F.col("last"), F.col("swaps"))).alias("begins"))
    to_here = in_block.rowsBetween(Window.unboundedPreceding, 0)
    mine = F.last(F.when(F.col("begins"), F.col("id")), ignorenulls=True).over(to_here)
    # The last line of a block may go on in the next one.
    rows = rows.select("*", mine.alias("record"), (F.col("begins") & F.lead("begins").over(in_block)).alias("alone"))
    rows = results.stored(rows.withColumn("alone", F.coalesce("alone", F.lit(False))), "placed-lines")
    heads = rows.groupBy("path", "block").agg(F.max("record").alias("latest"))
    heads = heads.select("path", "block", F.last("latest", ignorenulls=True).over(blocks).alias("carried"))
    several = rows.where("NOT alone").join(heads, ["path", "block"]).withColumn("record", F.coalesce("record", "carried"))
    joined = several.groupBy("path", "record").agg(
        F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("lines"))
    joined = joined.select("path", "block", F.col("record").alias("id"), F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"))
    records = rows.where("alone").select("path", "block", "id", F.col("value").alias("record")).unionByName(joined).where("record <> ''")
    first = records.groupBy("path").agg(F.min(F.struct("block", "id")).alias("first"))
    found = records.join(first, "path").select("path", F.when(F.struct("block", "id") == F.col("first"), 0).otherwise(1).alias("place"), "record")
    return found.select(dataset_of(F.col("path")).alias("dataset_name"), "path", "place", "record")
