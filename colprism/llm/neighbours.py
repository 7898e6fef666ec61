"""Approximate nearest neighbours: multiprobe hashing with p-stable projections."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import mix64, written

TABLES = 8
#: Width of a hash cell, in standard deviations of the projections of vectors of length 1.
WIDTH = 2.0
RECALL = 0.95
#: Queries whose true neighbours set the number of probes.
SAMPLE_QUERIES = 200
#: Probes of a table at most; where they are too few for the recall, cells get larger.
PROBES = 1 << 14
#: Most candidate rows and most queries that meet in one task.
SLICE_ROWS, QUERY_ROWS = 131072, 16384
#: Blocks of rows at least, whatever their number, so that small inputs run in parallel.
SLICES = 8
_PAIRS = 4_000_000


def probe_order(hashes: int, probes: int) -> np.ndarray:
    """The first perturbation sets in estimated success order, as rows of 0 and 1 over ranks of the ``2 * hashes`` steps.

    Rank r stands for a query's r-th cheapest step to a neighbouring cell of one hash. The expected squared cost of the
    ranks, for cell borders at random, orders the sets; a set never holds both steps of one hash (ranks r and 2m + 1 - r).
    """
    m = hashes
    if not m:
        return np.zeros((1, 0), np.int64)
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < probes:
        score, ranks = heapq.heappop(heap)
        if not any(2 * m - 1 - r in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1] + 1
        if last < 2 * m:
            heapq.heappush(heap, (score - cost[last - 1] + cost[last], (*ranks[:-1], last)))
            heapq.heappush(heap, (score + cost[last], (*ranks, last)))
    sets = np.zeros((len(out), 2 * m), np.int64)
    for i, ranks in enumerate(out):
        sets[i, list(ranks)] = 1
    return sets


class Index:
    """The hash functions: ``tables`` tables of ``hashes`` projections each, the same on every machine."""

    def __init__(self, dimension: int, longest: float, hashes: int, tables: int = TABLES, width: float = WIDTH):
        random = np.random.default_rng([dimension, hashes, tables])
        self.longest, self.hashes, self.tables, self.width = longest, hashes, tables, width
        self.lines = random.normal(size=(dimension + 1, tables * hashes))
        self.shift = random.uniform(0, 1, tables * hashes)
        self.weight = mix64(np.arange(1, tables * hashes + 1, dtype=np.uint64)).view(np.int64)

    def _cells(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Place of each vector on each line, in cells. The largest inner product is the smallest distance once
        candidates are scaled by the longest and get one more part that makes their length 1."""
        norm = np.linalg.norm(vectors, axis=1)
        if query:
            flat, rest = vectors / np.maximum(norm, 1e-300)[:, None], np.zeros(len(vectors))
        else:
            flat, rest = vectors / self.longest, np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))
        return (flat @ self.lines[:-1] + rest[:, None] * self.lines[-1]) / self.width + self.shift

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(row, table): the bucket of each candidate."""
        cells = np.floor(self._cells(vectors, False)).astype(np.int64) * self.weight
        return cells.reshape(len(vectors), self.tables, self.hashes).sum(axis=2)

    def probes(self, vectors: np.ndarray, order: np.ndarray) -> np.ndarray:
        """(row, table, probe): the buckets that a query visits, in the estimated order of success."""
        place = self._cells(vectors, True).reshape(-1, self.tables, self.hashes)
        cell = np.floor(place)
        below = place - cell
        weight = self.weight.reshape(self.tables, self.hashes)
        home = (cell.astype(np.int64) * weight).sum(axis=2)
        cost = np.concatenate([below, 1 - below], axis=2)
        step = np.broadcast_to(np.concatenate([-weight, weight], axis=1), cost.shape)
        step = np.take_along_axis(step, np.argsort(cost, axis=2), axis=2)
        return home[:, :, None] + step @ order.T


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, found: np.ndarray | None) -> tuple:
    """The k best rows of each query among ``found`` (all, if None): (query id, row id, score).

    A matrix product picks the rows within rounding of the k-th best; their scores are then summed alike for every row,
    so equal vectors score equally and ties go to the smaller id.
    """
    score = queries @ rows.T
    if found is not None:
        score[~found] = -np.inf
    score[query_ids[:, None] == ids[None, :]] = -np.inf
    if score.shape[1] > k:
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        scale = 1e-12 * (np.abs(queries).sum(axis=1) * max(np.abs(rows).max(initial=0.0), 1e-300) + 1e-300)
        near = (score >= (edge - scale)[:, None]) & (score > -np.inf)
    else:
        near = score > -np.inf
    q, r = np.nonzero(near)
    exact = (queries[q] * rows[r]).sum(axis=1)
    order = np.lexsort((ids[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
    keep = rank < k
    return query_ids[q[keep]], ids[r[keep]], exact[keep]


_FOUND = "query_id bigint, vec_id bigint, score double"


def _batch(found: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, embedding) without ids or vectors that are null, vectors that are empty, zero or not finite in a part."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))


def exact_neighbours(queries: list[tuple[int, list[float]]], rows: DataFrame, k: int) -> DataFrame:
    """True neighbours of a bounded list of queries: every row is scored, where it is."""
    ids, vectors = np.array([q[0] for q in queries], np.int64), np.array([q[1] for q in queries], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 8192):
                part = batch.slice(first, 8192)
                yield _batch(_best(vectors, ids, _matrix(part.column(1)), part.column(0).to_numpy(), k, None))

    return _top(rows.select("vec_id", "embedding").mapInArrow(run, _FOUND), k)


def fit(rows: DataFrame, queries: DataFrame, n: int, longest: float, dimension: int, *, k: int, recall: float = RECALL, sample: int = SAMPLE_QUERIES,
        tables: int = TABLES, width: float = WIDTH) -> tuple[Index, int]:
    """The index for ``n`` rows and the number of probes a table that finds ``recall`` of the neighbours.

    Buckets get smaller as rows get more. The number of probes is measured: of at most ``sample`` queries (those of the
    smallest hash) the true neighbours are looked up, and for each the first probe that would meet it in any table. Where
    ``PROBES`` probes meet too few of them, a table takes one hash less, until they are met; a table of no hash is one
    bucket of all rows.
    """
    hashes = max(2, round(math.log2(max(n, 2)) - 7.5))
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not some:
        return Index(dimension, longest, hashes, tables, width), 1
    true = exact_neighbours([(r[0], r[1]) for r in some], rows, k)
    true = true.join(rows.select("vec_id", "embedding"), "vec_id").select("query_id", "embedding").collect()
    if not true:
        return Index(dimension, longest, hashes, tables, width), 1
    place = {r[0]: i for i, r in enumerate(some)}
    owner = np.array([place[r[0]] for r in true])
    vectors, wanted = np.array([r[1] for r in true], np.float64), np.array([r[1] for r in some], np.float64)
    for fewer in range(hashes, -1, -1):
        index, order = Index(dimension, longest, fewer, tables, width), probe_order(fewer, min(3**fewer, PROBES))
        first = np.sort(_first_probes(index, order, vectors, owner, wanted))
        need = int(first[min(len(first) - 1, math.ceil(recall * len(first)) - 1)])
        if need < len(order):
            return index, need + 1
    raise AssertionError("a bucket of all rows holds all neighbours")


def _first_probes(index: Index, order: np.ndarray, vectors: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each vector the first probe at which its query (``owner``, a place in ``wanted``) meets it in any table; ``len(order)`` if none does."""
    first = np.full(len(vectors), len(order))
    keys = index.keys(vectors)
    for q in np.unique(owner):
        probes = index.probes(wanted[q : q + 1], order)[0]
        mine = np.flatnonzero(owner == q)
        for t in range(index.tables):
            sort = np.argsort(probes[t], kind="stable")
            at = np.minimum(np.searchsorted(probes[t][sort], keys[mine, t]), len(order) - 1)
            hit = probes[t][sort][at] == keys[mine, t]
            first[mine] = np.minimum(first[mine], np.where(hit, sort[at], len(order)))
    return first


def nearest(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", is_query=None, k: int = 20,
            recall: float = RECALL, tables: int = TABLES, width: float = WIDTH) -> DataFrame:
    """The ``k`` nearest rows of each query by inner product: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Queries are the rows of ``vectors`` that ``is_query`` (a condition on the id) names, by default every id divisible
    by 20. A query's candidates are the rows in the buckets that it probes in any table; their scores are exact. A query
    that meets fewer than k candidates is scored against every row.

    Rows and queries are cut into blocks of bounded size, whatever keys they hash to, and each block of rows builds its
    own buckets; so no bucket, however full, is one task's alone, and none is capped. Of rows with equal vectors only
    the k + 1 smallest ids can be among the nearest; the others leave the candidates (not the queries) first.

    Vectors that are null, zero or hold a null or non-finite part take no part, nor do null ids. Vectors of another
    length than a query's are no candidates of it. Rows that repeat an id and vector count once. Fewer than k
    candidates give fewer rows; an empty table gives none.
    """
    query = (F.col("vec_id") % 20 == 0) if is_query is None else is_query
    good = usable(vectors, id_column, vector_column)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    kinds = good.groupBy(F.size("embedding").alias("dimension")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest"), F.sum(query.cast("long")).alias("queries")).collect()
    out = None
    for dimension, n, longest, n_queries in kinds:  # as many as there are lengths of vectors
        mine = good.where(F.size("embedding") == dimension).dropDuplicates()
        same = Window.partitionBy("embedding").orderBy("vec_id")
        rows = mine.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")
        asked = mine.where(query)
        found = _search(rows, asked, n, n_queries or 0, longest, dimension, k=k, recall=recall, tables=tables, width=width)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return _top(out, k)


def _search(rows: DataFrame, asked: DataFrame, n: int, n_queries: int, longest: float, dimension: int, *, k: int, recall: float, tables: int, width: float) -> DataFrame:
    index, probes = fit(rows, asked, n, longest, dimension, k=k, recall=recall, tables=tables, width=width)
    if not index.hashes:
        return _top(_meet(rows, asked, n, n_queries, None, probes, k), k)
    found = written(_top(_meet(rows, asked, n, n_queries, index, probes, k), k), "nearest")
    whole = found.where(F.col("rank") == k).select("query_id")
    few = written(asked.join(whole, F.col("vec_id") == F.col("query_id"), "left_anti"), "few")
    n_few = few.count()
    if not n_few:
        return found
    return found.join(whole, "query_id", "left_semi").unionByName(_top(_meet(rows, few, n, n_few, None, probes, k), k))


def _meet(rows: DataFrame, asked: DataFrame, n: int, n_queries: int, index: Index | None, probes: int, k: int) -> DataFrame:
    """The k best candidates of each query in each block of rows; without an index all rows are candidates."""
    order = probe_order(index.hashes, probes) if index else None
    slices = max(SLICES, -(-n // SLICE_ROWS))
    blocks = max(1, -(-n_queries // QUERY_ROWS))

    def block(name: str, number: int):
        return F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(number)).cast("int")

    base = rows.select(block("row", slices).alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "embedding")
    query = asked.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), block("query", blocks).alias("block"), "vec_id", "embedding")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        vectors, ids = _matrix(left.column("embedding")), left.column("vec_id").to_numpy()
        wanted, query_ids = _matrix(right.column("embedding")), right.column("vec_id").to_numpy()
        parts = []
        if len(ids) and len(query_ids):
            step = _PAIRS // len(ids)
            if index:
                keys = index.keys(vectors)
                sort = np.argsort(keys, axis=0, kind="stable")
                keys = np.take_along_axis(keys, sort, axis=0)
                step = min(step, _PAIRS // (len(order) * index.tables))
            step = max(1, step)
            for first in range(0, len(query_ids), step):
                some = wanted[first : first + step]
                found = None
                if index:
                    visit = index.probes(some, order)
                    found = np.zeros((len(some), len(ids)), bool)
                    for t in range(index.tables):
                        low, high = (np.searchsorted(keys[:, t], visit[:, t].ravel(), side) for side in ("left", "right"))
                        size = high - low
                        at = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        found[np.repeat(np.arange(len(size)) // len(order), size), sort[at, t]] = True
                parts.append(_batch(_best(some, query_ids[first : first + step], vectors, ids, k, found)))
        return pa.Table.from_batches(parts, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return base.groupBy("slice", "block").cogroup(query.groupBy("slice", "block")).applyInArrow(meet, _FOUND)
