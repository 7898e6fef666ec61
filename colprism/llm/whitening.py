"""Embedding whitening by a covariance that is weighted with the multiplicity of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_arrow, written

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Vectors longer than this are refused: the driver holds a few square matrices of that side.
MOST_DIMENSIONS = 4096
#: An eigenvalue below this part of the largest one is no component: its direction is rounding.
LEAST_EIGENVALUE = 1e-11
#: Distinct vectors that are joined back by broadcast, at most: those that hold over 1 / _HOT of all rows.
_HOT = 4096
#: Numbers that one step of numpy works on.
_CELLS = 1 << 21
_LONG = 1 << 62


def _usable(vector: Column) -> Column:
    whole = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float(_LONG // SCALE // 2))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, whole)


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """The equally long lists of an Arrow column as matrices of bounded size, each with the number of its first row."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    d = len(flat) // rows
    step = max(1, _CELLS // max(1, d))
    for low in range(0, rows, step):
        yield low, flat[low * d : min(rows, low + step) * d].reshape(-1, d)


def _sums(vectors: DataFrame, column: str, kind: str) -> DataFrame:
    """(place, total): weighted sums over ``vectors`` (column, weight) of each place, exact for longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                weight = batch.column(1).to_numpy()
                for low, x in _matrices(batch.column(0)):
                    w = weight[low : low + len(x)]
                    if x.dtype.kind == "i" and int(np.abs(x).max()) * int(w.sum()) >= _LONG:
                        x, w = x.astype(object), w.astype(object)
                    part = np.array([v if x.dtype.kind == "f" else int(v) for v in w @ x], object)
                    total = part if total is None else total + part
        if total is not None:
            values = [Decimal(int(v)) for v in total] if kind.startswith("decimal") else [float(v) for v in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(values, pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64())], names=["place", "total"])

    return vectors.select(column, "weight").mapInArrow(run, f"place int, total {kind}").groupBy("place").agg(F.sum("total").alias("total"))


def _covariance(vectors: DataFrame, column: str, centred, n: int, dimension: int) -> np.ndarray:
    """The covariance of ``vectors`` (column, weight), divisor n: a weighted product of centred matrices a task, summed by Spark.

    Tasks pass on the upper triangle only, and the driver gets dimension * dimension / 2 sums.
    """
    upper = np.triu_indices(dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            if batch.num_rows:
                weight = batch.column(1).to_numpy().astype(np.float64)
                for low, x in _matrices(batch.column(0)):
                    x = centred(x)
                    total += (x * weight[low : low + len(x), None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], names=["cell", "total"])

    cells = vectors.select(column, "weight").mapInArrow(run, "cell bigint, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    out = np.zeros((dimension, dimension))
    for cell, total in cells.collect():
        out[upper[0][cell], upper[1][cell]] = out[upper[1][cell], upper[0][cell]] = total / n
    return out


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: longs where they hold it, else Python's whole numbers."""
    if n * (int(np.abs(x).max()) if x.size else 0) < _LONG and max(map(abs, sums), default=0) < _LONG:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(off: np.ndarray) -> list[int | None]:
    """The sum of squares of each row of ``offsets``, exactly; None where no long holds it."""
    largest = int(np.abs(off).max()) if off.size else 0
    if largest * largest * off.shape[1] >= _LONG:
        off = off.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=1)]


def whiten(embeddings: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS,
           weights: str = "counts") -> DataFrame:
    """Every row of ``embeddings`` with a usable vector and each component: (id, component, n, deviation, whitened, explained, identity_error).

    Entries c become x = floor(64 * c) + 1,000,000. Rows of one x are one vector from there on: with ``weights="counts"``
    it weighs as many as they are in the fit (n rows), with ``"ones"`` it weighs one (n distinct vectors). The covariance is
    centred first, its divisor is n. Components are its eigenvectors by falling eigenvalue, with the largest entry positive;
    whitened = (x - mean) on the component over the root of its eigenvalue e; explained = e over the trace; deviation is
    the exact sum of (n * x - sums)^2 (null where no long holds it). identity_error is the largest absolute entry of
    whitened's covariance minus the identity.

    1. Distinct x with their counts, counted before they are shuffled. 2. Exact sums. 3. A weighted product of centred
    matrices in each task, summed by Spark; the eigenvectors of one dimension x dimension matrix on the driver. 4. Each
    distinct vector whitened once, and the covariance of that. 5. Rows meet their vector again by x itself; vectors that
    hold over a 4,096th of all rows (so at most 4,096 vectors) are broadcast, so no task gets the rows of a frequent one.

    Null vectors, empty ones, and those with null, non-finite or absurd entries (beyond 2^55, whose x no long holds) are
    left out. So are vectors whose length is not the most frequent one (ties: the longest). Directions without variance
    (one vector only, say) are no components, so a table of equal vectors gives no row, as does an empty table. Repeated
    rows and null ids give rows of their own.
    """
    if weights not in ("counts", "ones"):
        raise ValueError("weights are 'counts' or 'ones'")
    spark = embeddings.sparkSession
    id_type = embeddings.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    given = embeddings.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")).where(_usable(F.col("v")))
    lengths = given.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dimension, all_rows = lengths[0]["d"], lengths[0]["rows"]
    if dimension > MOST_DIMENSIONS:
        raise ValueError(f"vectors of over {MOST_DIMENSIONS} entries")
    as_long = lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("bigint") + F.lit(SHIFT)
    rows = given.where(F.size("v") == dimension).select("id", F.transform("v", as_long).alias("x"))

    weight = F.col("copies") if weights == "counts" else F.lit(1).cast("bigint")
    distinct = written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).withColumn("weight", weight), "vectors")
    n = int(distinct.agg(F.sum("weight")).first()[0])
    sums = [int(r["total"]) for r in sorted(_sums(distinct, "x", "decimal(38,0)").collect())]

    def centred(x: np.ndarray) -> np.ndarray:
        return (offsets(x, n, sums) / n).astype(np.float64)

    values, vectors = np.linalg.eigh(_covariance(distinct, "x", centred, n, dimension))
    order = np.argsort(-values, kind="stable")
    trace = float(values.sum())
    order = order[values[order] > max(0.0, values.max()) * LEAST_EIGENVALUE][:components]
    if not len(order):
        return spark.createDataFrame([], schema)
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(order))])
    to_white = vectors / np.sqrt(values)

    def whitened_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, x in _matrices(batch.column(0)):
            off = offsets(x, n, sums)
            white = (off / n).astype(np.float64) @ to_white
            part = batch.slice(low, len(x))
            border = pa.array(np.arange(0, white.size + 1, white.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(deviations(off), pa.int64()), pa.ListArray.from_arrays(border, pa.array(white.ravel()))],
                                             names=[*part.schema.names, "deviation", "white"])

    white = written(map_arrow(distinct, whitened_of, "x array<bigint>, copies bigint, weight bigint, deviation bigint, white array<double>"), "whitened")
    mean = np.array([r["total"] for r in sorted(_sums(white, "white", "double").collect())]) / n
    error = float(np.abs(_covariance(white, "white", lambda y: y - mean, n, len(order)) - np.eye(len(order))).max())

    found = white.select("x", "deviation", "white")
    hot = F.col("copies") > all_rows // _HOT
    frequent = F.broadcast(written(white.where(hot).select("x", "deviation", "white"), "frequent"))
    out = rows.join(frequent, "x").unionByName(
        rows.join(F.broadcast(frequent.select("x")), "x", "left_anti").join(white.where(~hot).select(*found.columns), "x"))
    place = F.posexplode("white").alias("place", "whitened")
    share = F.element_at(F.array(*[F.lit(float(v / trace)) for v in values]), F.col("place") + 1)
    out = out.select(F.col("id").alias(id_column), "deviation", place)
    return out.select(id_column, (F.col("place") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                      share.alias("explained"), F.lit(error).alias("identity_error"))
