"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACED, annotate, drop, raw_texts, slices, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Rows of one size and source that one task ranks.
_RANKED = 10_000
_ROUNDS = 60


def _sizes(column):
    import numpy as np
    import pyarrow as pa

    data, offsets = raw_texts(column)
    out = np.zeros(len(column), np.int64)
    for first, last in slices(offsets):
        part, borders = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        inside = SPACED[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        starts = borders[:-1][borders[:-1] < len(part)]
        begins[starts] = inside[starts]
        out[first:last] = np.diff(np.concatenate(([0], np.cumsum(begins)))[borders])
    return [pa.array(out)]


def with_sizes(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """``documents`` with ``size``, the number of words between ASCII white space; 0 for a null text."""
    return annotate(documents, text_column, _sizes, "size bigint")


def targets(sources: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: words that the mix should take of each source.

    Sources in the order of their code points, null last, weigh ``weights``, repeating, and share ``share`` of all
    sizes. No target exceeds ``most`` times its source's size; the excess is shared again by weight until none does.

    A source is full exactly if its room per weight is at most the water level; so one pass in the order of that room
    finds the level. Windows run over sources, not over documents.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.partitionBy()
    rows = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    rows = rows.withColumn("whole", share * F.sum("source_size").over(every))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("level", F.greatest(F.lit(0.0), F.col("whole") - F.col("full")) / F.col("open"))
    # The level of the first source that is not full; if all are, every target is its cap.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"]
    return rows.withColumn("at", level).select(
        "source", "source_size",
        F.coalesce(F.least(F.col("cap"), F.col("at") * F.col("weight")), F.col("cap")).alias("target"))


def rate(size: Column, target: Column, source_size: Column, dual: Column, unit: Column, most: float) -> Column:
    """The rate of a document: its exponential tilt, at most ``most``; all there is where the target asks for it."""
    tilted = F.least(F.lit(float(most)), F.exp(dual * size / unit))
    return F.when(target <= 0, 0.0).when(target >= most * source_size * (1 - 1e-12), float(most)).otherwise(tilted)


def tilt(sizes: DataFrame, goals: DataFrame, *, most: float = MOST, tolerance: float = 1e-10, rounds: int = _ROUNDS) -> DataFrame:
    """The entropy balancing weights: ``goals`` (source, source_size, target) with the multiplier ``dual`` and the ``unit`` of each source.

    Among all document rates 0 <= r <= ``most`` whose words, sum of r * size, are the target of every source, the balancing
    takes those nearest to 1 in relative entropy, the sum over documents of r log r - r + 1. The optimum is
    r = min(most, exp(dual * size / unit)): a document is tilted by its size, in units of its source's mean size.

    Newton's method minimises the convex dual, whose gradient is taken - target and whose Hessian is the sum of
    size^2 / unit * r over the documents below ``most``. Each iteration is one distributed sum over (source, size,
    documents). Steps are at most 2 long; one that leaves the bracket of the signs seen so far goes to its middle.
    """
    mean = sizes.groupBy("source").agg((F.sum(F.col("documents") * F.col("size")) / F.sum(F.when(F.col("size") > 0, F.col("documents")))).alias("unit"))
    goals = _joined(goals, mean, ["source"]).withColumn("unit", F.coalesce("unit", F.lit(1.0)))
    open_ = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12))
    goals = goals.withColumn("dual", F.lit(0.0)).withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("inf")))
    state = written(goals, "dual")
    for _ in range(rounds):
        rated = _joined(sizes, state.where(open_), ["source"])
        words, tilted = F.col("documents") * F.col("size"), F.exp(F.col("dual") * F.col("size") / F.col("unit"))
        moments = rated.groupBy("source").agg(
            F.sum(words * F.least(F.lit(float(most)), tilted)).alias("taken"),
            F.sum(F.when(tilted < most, words * F.col("size") / F.col("unit") * tilted).otherwise(0.0)).alias("slope"))
        here = state.alias("s").join(moments.alias("m"), F.col("s.source").eqNullSafe(F.col("m.source")), "left")
        short = F.col("target") - F.col("taken")
        low, high = F.when(short > 0, F.col("dual")).otherwise(F.col("low")), F.when(short < 0, F.col("dual")).otherwise(F.col("high"))
        moved = here.select("s.source", "source_size", "target", "unit", "dual", low.alias("low"), high.alias("high"), short.alias("short"), "slope", F.col("taken").isNotNull().alias("live"))
        step = F.when(F.col("slope") > 0, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("short") / F.col("slope")))).otherwise(2.0 * F.signum("short"))
        new = F.col("dual") + step
        new = F.when((new > F.col("low")) & (new < F.col("high")), new).otherwise((F.col("low") + F.col("high")) / 2)
        moved = moved.withColumn("off", F.abs(F.col("short")) / F.col("target"))
        moved = moved.withColumn("dual", F.when(F.col("live") & (F.col("off") > tolerance), new).otherwise(F.col("dual")))
        last, state = state, written(moved.select(*goals.columns, "off"), "dual")
        drop(last)
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
        state, kept = state.drop("off"), state
        state._written = kept._written
    return state.select("source", "source_size", "target", "unit", "dual")


def mix(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` (of its source), ``copies`` and ``taken`` (words).

    Rates from ``tilt``, which differ with a document's size, become whole copies by systematic rounding: the documents of a source stand in the order of
    their size, then of a hash of their id; each takes as many copies as the running sum of rates passes whole numbers on it.
    So every stretch of similar sizes gives its share and the words taken come within a document of the target. What is
    still missing or over is mended by one copy of one document of fitting size, if that brings the source nearer.

    Ranks come from counts by (source, size, part of the hash) and ranks within those, so no task ranks a whole source
    or all documents of a size. Words are counted once; the texts are not shuffled.

    Null texts have size 0 and take 0 words; a null source is a source. Repeated rows are documents of their own; among
    rows alike in every respect it is open which one takes more copies. Null ids are allowed.
    """
    counted = documents.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.col(text_column).alias("text"))
    counted = with_sizes(counted).select("id", "source", "size", F.xxhash64(F.col("id").cast("string"), F.xxhash64("text")).alias("draw"))
    counted = written(counted, "sizes")
    cells = written(counted.groupBy("source", "size").agg(F.count(F.lit(1)).alias("documents")), "size-counts")
    goals = targets(cells.groupBy("source").agg(F.sum(F.col("documents") * F.col("size")).alias("source_size")), weights=weights, share=share, most=most)
    goals = written(goals, "targets")
    rates = tilt(cells, goals, most=most)
    of_size = rate(F.col("size"), F.col("target"), F.col("source_size"), F.col("dual"), F.col("unit"), most)

    parts = F.ceil(F.col("documents") / _RANKED)
    split = cells.select("source", "size", parts.alias("parts"))
    drawn = _joined(counted, split, ["source", "size"]).withColumn("part", F.pmod("draw", F.col("parts"))).drop("parts")
    drawn = written(drawn, "drawn")
    ordered = Window.partitionBy("source").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = _joined(drawn.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n")), rates, ["source"]).withColumn("rate", of_size)
    before = before.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(ordered), F.lit(0.0))).drop("n", "dual", "unit")
    own = Window.partitionBy("source", "size", "part").orderBy("draw", "id")
    ranked = drawn.withColumn("own", F.row_number().over(own))
    ranked = _joined(ranked, before, ["source", "size", "part"])
    upto = lambda k: F.floor(F.col("before") + F.col("rate") * k + F.lit(0.5 + 1e-9))
    copies = (upto(F.col("own")) - upto(F.col("own") - 1)).cast("long")
    rounded = written(ranked.select("id", "source", "size", "draw", "part", "own", "source_size", "target", F.least(copies, F.lit(int(most))).alias("copies")), "rounded")
    drop(counted, drawn)

    short = rounded.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("short"))
    open_ = _joined(rounded, short, ["source"])
    able = F.when(F.col("short") > 0, F.col("copies") < int(most)).otherwise(F.col("copies") > 0) & (F.abs(F.abs("short") - F.col("size")) < F.abs("short"))
    named = F.struct(F.abs(F.abs("short") - F.col("size")).alias("left"), "size", "draw", "part", "own")
    mended = open_.where(able).groupBy("source").agg(F.min(named).alias("pick"), F.first("short").alias("short"))
    mended = mended.select("source", F.col("pick.size").alias("at_size"), F.col("pick.part").alias("at_part"), F.col("pick.own").alias("at_own"), F.signum("short").cast("long").alias("more"))
    final = rounded.alias("r").join(mended.alias("m"), F.col("r.source").eqNullSafe(F.col("m.source")), "left")
    here = (F.col("size") == F.col("at_size")) & (F.col("part") == F.col("at_part")) & (F.col("own") == F.col("at_own"))
    number = F.col("copies") + F.when(here, F.col("more")).otherwise(0)
    return final.select(
        F.col("id").alias(id_column), F.col("r.source").alias(source_column), "draw", "size", "source_size", "target",
        number.alias("copies"), (number * F.col("size")).alias("taken"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"other_{k}" for k in keys})
    same: Column = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"other_{k}"])
    return left.join(renamed, same).drop(*[f"other_{k}" for k in keys])


def apply_mix(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with every row as often as the mix takes it.

    Rows meet their copies by id and a hash of id and text. Rows alike in both (repeated rows) each come as often as the
    first of them, so that a repeated row needs no number of its own.
    """
    id_column, text_column = options.get("id_column", "doc_id"), options.get("text_column", "text")
    plan = mix(documents, **options).groupBy(F.col("draw").alias("__draw")).agg(F.max("copies").alias("__copies")).where(F.col("__copies") > 0)
    marked = documents.withColumn("__draw", F.xxhash64(F.col(id_column).cast("string"), F.xxhash64(text_column)))
    many = marked.join(plan, "__draw").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return many.select(*documents.columns)
