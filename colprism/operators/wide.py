"""Value counts of columns with wide texts, which stay where they are stored.

A text over ``WIDE`` code points that is neither a number nor a date crosses the
shuffle as its first code points, a SHA-256 digest, its width and whether it is
blank.  Counts, key candidates and types need no more.  Listed values are chosen
by these stand-ins, ties by further pieces of the texts, and only the chosen
ones are fetched whole, in another read.  Answers equal those of the operators
on whole values, whatever the width; the source must give the same rows each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import detect as D
from ..functions.text import is_blank
from ..sources import results
from . import counts as C, typing as Y
from .cells import SLOTS, _named, _slot_rows

#: Code points of a stand-in and of a piece.  A shorter text is its own stand-in, so both kinds compare rightly.
WIDE = 64
#: Tied values of a column that are fetched whole to be settled; more are told apart by pieces first.
SETTLED = 1000


def _marked(df: DataFrame) -> DataFrame:
    """The cells with ``width``, null for a text that travels whole."""
    text = F.col("text")
    rows = _slot_rows(df).withColumn("_long", F.length(text) > WIDE)
    plain = F.when(F.col("_long"), D.number_tag(text).isNull() & D.shaped_timestamp(text).isNull())
    return rows.withColumn("width", F.when(plain, F.length(text))).drop("_long")


def _digest():
    return F.unhex(F.sha2("text", 256))


def value_counts(df: DataFrame) -> DataFrame:
    """``cells.value_counts`` with stand-ins: ``value`` and ``text`` hold the first code points where ``width`` is not null."""
    wide = F.col("width").isNotNull()
    rows = _marked(df).select(
        "column_pos", *[c for c in SLOTS if c != "text"],
        F.when(wide, F.left("text", F.lit(WIDE))).otherwise(F.col("text")).alias("text"),
        F.when(wide, _digest()).alias("digest"), "width",
        F.when(wide, is_blank(F.col("text"))).alias("_blank"),
    )
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("cnt"))
    named = _named(counted, df, "cnt", "digest", "width", "_blank")
    return named.withColumn("is_blank", F.coalesce("_blank", "is_blank")).drop("_blank")


def typed(counts: DataFrame, empty_as_text: bool = True) -> DataFrame:
    """``typing.typed`` of counts with stand-ins, which are TEXT of their own width; blank ones have length 0."""
    rows = Y.typed(counts, empty_as_text, keep=("is_blank", "digest", "width"))
    open_wide = F.col("width").isNotNull() & ~F.col("is_blank")
    changed = {c: F.when(~open_wide, F.col(c)) for c in ("whole", "number", "moment")}
    return rows.withColumns(changed | {
        "type": F.when(open_wide, D.TEXT).otherwise(F.col("type")),
        "length": F.when(open_wide, F.col("width")).otherwise(F.col("length")),
    })


def _ranked(rows: DataFrame, order: list, k: int) -> DataFrame:
    """Rows that may be among the k first of their column by ``order`` and their value as far as it is known."""
    known = sorted((c for c in rows.columns if c.startswith("_piece")), key=lambda c: int(c[6:]))
    place = F.rank().over(Window.partitionBy("column_pos").orderBy(*order, "value", *known))
    return rows.withColumn("_rank", place).filter(F.col("_rank") <= k)


def _skipped(texts: DataFrame, last: DataFrame) -> DataFrame:
    """Per column of ``last`` (column_pos, offset, mark): how many code points all texts beginning as ``mark`` says share.

    Whole blocks are counted only.  Of all texts just the first and the last matter, one pair a task and column.
    """
    alike = texts.join(F.broadcast(last), "column_pos").filter(F.unhex(F.sha2(F.expr("left(text, offset)"), 256)) == F.col("mark"))
    ends = alike.groupBy("column_pos", "offset").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    same = f"substring(a, i + 1, {WIDE}) = substring(b, i + 1, {WIDE})"
    walk = f"aggregate(sequence(offset, length(a), {WIDE}), offset, (n, i) -> IF(n = i AND {same}, i + {WIDE}, n))"
    return ends.select("column_pos", F.expr(f"IF(length(a) < offset, offset, {walk})").alias("offset"))


def _whole(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The text of each chosen digest, once: at most ``SETTLED`` a column, so they are sent to the tasks."""
    wanted = chosen.filter(F.col("digest").isNotNull()).select("column_pos", "digest").distinct()
    found = texts.join(F.broadcast(wanted), ["column_pos", "digest"])
    return found.groupBy("column_pos", "digest").agg(F.min("text").alias("_text"))


def first_values(rows: DataFrame, df: DataFrame, order: list, k: int) -> DataFrame:
    """Of counts with stand-ins the k first of every column by ``order`` and the whole value, with their values whole.

    A round reads the source twice: what the tied texts share is passed over, then ``WIDE`` code points behind it tell
    them apart.  Only those pieces are shuffled.
    """
    texts = _marked(df).filter(F.col("width").isNotNull()).select("column_pos", _digest().alias("digest"), "text")
    left = results.stored(_ranked(rows, order, k), "wide")
    left = left.withColumns({"_offset": F.lit(WIDE), "_mark": F.unhex(F.sha2("value", 256))})
    number = 0
    while True:
        ties = left.groupBy("column_pos").agg(F.count(F.lit(1)).alias("_n"), F.max("_rank").alias("_rank")).filter(F.col("_n") > max(SETTLED, k))
        # All rows of the last rank begin alike; the longest known beginning is that of a wide text.
        last = left.filter(F.col("digest").isNotNull()).join(F.broadcast(ties), ["column_pos", "_rank"])
        last = results.stored(last.groupBy("column_pos").agg(
            F.max("_offset").alias("offset"), F.max_by("_mark", "_offset").alias("mark")), "wide")
        if last.isEmpty():
            break
        number += 1
        pieces = texts.join(F.broadcast(_skipped(texts, last)), "column_pos").select(
            "column_pos", "digest", F.expr(f"substring(text, offset + 1, {WIDE})").alias("_piece"),
            (F.col("offset") + WIDE).alias("_next"), F.unhex(F.sha2(F.expr(f"left(text, offset + {WIDE})"), 256)).alias("_begun"))
        pieces = pieces.groupBy("column_pos", "digest").agg(*[F.min(c).alias(c) for c in ("_piece", "_next", "_begun")])
        met = left.join(pieces, ["column_pos", "digest"], "left").withColumns({
            f"_piece{number}": F.coalesce("_piece", F.lit("")),
            "_offset": F.coalesce("_next", "_offset"), "_mark": F.coalesce("_begun", "_mark"),
        }).drop("_piece", "_next", "_begun", "_rank")
        left = results.stored(_ranked(met, order, k), "wide")
    shown = left.join(_whole(texts, left), ["column_pos", "digest"], "left").withColumn("value", F.coalesce("_text", "value"))
    place = F.row_number().over(Window.partitionBy("column_pos").orderBy(*order, "value"))
    return shown.withColumn("_place", place).filter(F.col("_place") <= k).select(*[c for c in rows.columns if c not in ("digest", "width")])


def top_frequent(counts: DataFrame, df: DataFrame, k: int = 5) -> DataFrame:
    """``counts.top_frequent`` of ``value_counts(df)`` of this module."""
    rows = counts.select(*Y.keys(counts), "value", "cnt", "digest", "width")
    return C.top_frequent(first_values(rows, df, [F.desc("cnt")], k), k)


def text_by_length(typed_counts: DataFrame, df: DataFrame, longest: bool, k: int = 5) -> DataFrame:
    """``typing.text_by_length`` of ``typed(value_counts(df))`` of this module."""
    rows = Y._only(typed_counts, Y._is_text()).select(*Y.keys(typed_counts), "type", "value", "length", "cnt", "digest", "width")
    order = [F.desc("length") if longest else F.asc("length")]
    return Y.text_by_length(first_values(rows, df, order, k), longest, k)
