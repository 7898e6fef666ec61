"""Document fingerprints: MinHash signatures of word shingles, compared as a whole or joined by bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACED, map_arrow, mix64, raw_texts, shingles, slices, words_of, written
from .components import connected
from .jaccard_join import digests, sets_of

#: Hash functions, and of how many a band is made: two texts of Jaccard 0.8 share none of the 32 bands once in 10 million.
HASHES, BAND = 128, 4
SHINGLE_WORDS = 5
#: The sign of an empty set in every place.
EMPTY = np.uint32(0xFFFFFFFF)
#: Bytes of text in one part of the order of ids, up to so many parts; beyond that parts grow with the input.
PART_BYTES, MOST_PARTS = 32 << 20, 20_000
#: Shingles that the hash functions go over at a time, so that they stay in the processor's cache.
_STRETCH = 1 << 15
_LEAST = -(1 << 63)


def hash_functions(count: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of multiply-add-shift: h(x) = ((a * x + b) mod 2^64) >> 32 of 32-bit x is a universal family."""
    numbers = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[:count] | np.uint64(1), numbers[count:]


def signatures(data: np.ndarray, borders: np.ndarray, k: int = SHINGLE_WORDS, count: int = HASHES) -> np.ndarray:
    """A row of ``count`` 32-bit minima for each text; texts without words have ``EMPTY`` throughout."""
    factor, summand = hash_functions(count)
    hashes, _, _, counts = words_of(data, borders, SPACED)
    made, row = shingles(hashes, counts, k)
    x = made >> np.uint64(32)
    out = np.full((len(borders) - 1, count), EMPTY, np.uint32)
    room = np.empty(min(_STRETCH, len(x)), np.uint64)
    for low in range(0, len(x), _STRETCH):
        part, rows = x[low : low + _STRETCH], row[low : low + _STRETCH]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        at, value = rows[first], room[: len(part)]
        least = np.empty((len(first), count), np.uint32)
        for i in range(count):
            np.multiply(part, factor[i], out=value)
            value += summand[i]
            least[:, i] = np.minimum.reduceat(value, first) >> np.uint64(32)
        out[at] = np.minimum(out[at], least)
    return out


def _of_texts(texts: list[bytes], k: int, count: int) -> np.ndarray:
    """Signatures of encoded texts, in slices of bounded size."""
    borders = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    out = np.zeros((len(texts), count), np.uint32)
    for low, high in slices(borders, 1 << 20):
        part = np.frombuffer(b"".join(texts[low:high]), np.uint8)
        out[low:high] = signatures(part, borders[low : high + 1] - borders[low], k, count)
    return out


def as_text(signs: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signs.astype(">u4")]


def fingerprints(documents: DataFrame, *, text_column: str = "text", k: int = SHINGLE_WORDS, count: int = HASHES) -> DataFrame:
    """``documents`` with ``fingerprint``: the signature of the whole text, eight hex digits for each hash function.

    Words lie between ASCII white space, A-Z in lower case; a text of fewer than ``k`` words, but not none, is one shingle.
    Null counts as the empty text; texts without words have f throughout. Equal texts have equal fingerprints.
    """
    from .common import annotate

    def run(column: pa.Array) -> list:
        data, offsets = raw_texts(column)
        out: list[str] = []
        for low, high in slices(offsets, 1 << 20):
            out += as_text(signatures(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], k, count))
        return [pa.array(out, pa.string())]

    return annotate(documents, text_column, run, "fingerprint string")


def with_next(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(part, last, id, mark, text): all rows in the order of ids, sorted within each part, and after a part's rows the first
    row of the next one (``last``; after the last part's the very first row), so that each row's next one stands in its part.

    Parts are cut at percentiles of the ids; rows of one id follow each other by a hash of their text and may fill several
    parts. Null ids come first. Texts are shuffled once.
    """
    size, rows = documents.select(F.sum(F.octet_length(text_column)), F.count(F.lit(1))).first()
    parts = max(1, min(-(-(size or 0) // part_bytes), rows, MOST_PARTS))
    cuts = [i / parts for i in range(1, parts)]
    docs = documents.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_LEAST)).alias("id"), F.xxhash64(F.coalesce(text_column, F.lit(""))).alias("mark"), F.coalesce(text_column, F.lit("")).alias("text"))
    bounds = docs.select(F.percentile_approx("id", cuts, max(10_000, 20 * parts)).alias("p")).first()[0] or [] if cuts else []
    edges = np.array(bounds, np.int64)

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        low, high = np.searchsorted(edges, ids, "left"), np.searchsorted(edges, ids, "right")
        share = (marks.astype(np.float64) / 2.0**64 + 0.5) * (high - low + 1)
        part = low + np.minimum(share.astype(np.int64), high - low)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.zeros(len(part), bool)), *batch.columns], names=["part", "last", "id", "mark", "text"])

    placed = map_arrow(docs, place, "part int, last boolean, id bigint, mark bigint, text string")
    firsts = written(placed.groupBy("part").agg(F.min_by("text", F.struct("id", "mark")).alias("text"), F.min(F.struct("id", "mark")).alias("key")), "firsts")
    used = sorted(r["part"] for r in firsts.select("part").collect())  # a number per part
    before = documents.sparkSession.createDataFrame(list(zip(used, used[-1:] + used[:-1])), "part int, before int")
    ends = firsts.join(before, "part").select(F.col("before").alias("part"), F.lit(True).alias("last"), "key.id", "key.mark", "text")
    return placed.unionByName(ends).repartitionById(parts, "part").sortWithinPartitions("part", "last", "id", "mark")


def compare_edits(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", k: int = SHINGLE_WORDS, count: int = HASHES,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """Every document's fingerprint against that of its edited text and of the next document.

    The next document is the one of the next larger id, after the last the first. The edited text is the text with its last
    floor(n_chars / 4) code points replaced by the first as many (or all) of the next one. Rows: id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next, the shares of equal places of two signatures.

    Nulls count as empty texts; a text without words is like another one without (1), and like no other. Rows of one id
    stand in the order of a hash of their texts, equal rows next to each other, null ids first. One document alone is its own next.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row: its part, id, text and signature
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                parts, last = some.column(0).to_pylist(), some.column(1).to_pylist()
                ids, raw = some.column(2).to_pylist(), [t.as_buffer().to_pybytes() for t in some.column(4).cast(pa.large_binary())]
                signs = _of_texts(raw, k, count)
                if held is not None:
                    parts, last, ids, raw, signs = [held[0], *parts], [False, *last], [held[1], *ids], [held[2], *raw], np.concatenate((held[3][None], signs))
                texts, at, edited = [t.decode() for t in raw], [], []
                for i in range(len(ids) - 1):
                    if not last[i]:
                        cut = len(texts[i]) // 4
                        edited.append((texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut]).encode())
                        at.append(i)
                held = None if last[-1] else (parts[-1], ids[-1], raw[-1], signs[-1])
                own, other = np.array(at, np.int64), _of_texts(edited, k, count)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in edited], pa.string()),
                    pa.array(as_text(signs[own]), pa.string()), pa.array(as_text(other), pa.string()),
                    pa.array((signs[own] == other).mean(axis=1)), pa.array((signs[own] == signs[own + 1]).mean(axis=1)),
                ], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ordered = with_next(documents, id_column=id_column, text_column=text_column, part_bytes=part_bytes)
    found = ordered.mapInArrow(run, "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.select(F.when(F.col("id") != _LEAST, F.col("id")).alias(id_column), *found.columns[1:])


def near_groups(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", k: int = SHINGLE_WORDS, percent: int = 80,
                count: int = HASHES, band: int = BAND) -> DataFrame:
    """(id, group): documents in groups that verified links connect; ``group`` is the smallest id of its group.

    Documents of one set of shingles are one node. Nodes that share a band (``band`` minima) are candidates; a candidate pair
    is a link if its exact Jaccard index, from the shingles of both whole texts, reaches ``percent``. First each node of a
    bucket meets the bucket's smallest; what links leave in one component needs no further test, and buckets that still
    hold several components pair the nodes of different ones. No bucket is capped. Pairs that share no band are not found.

    Texts without words, nulls included, are their own group; a row without id has the smallest id of its group, or null.
    """
    places = [list(range(i, min(count, i + band))) for i in range(0, count, band)]

    def describe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = raw_texts(batch.column(1))
        for low, high, tokens, _, borders in sets_of(batch.column(1), k):
            signs = signatures(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], k, count)
            keys = np.zeros((high - low, len(places)), np.uint64)
            for i, columns in enumerate(places):
                for c in columns:
                    keys[:, i] = mix64(keys[:, i] * np.uint64(3) + signs[:, c] + np.uint64(i))
            border = pa.array(np.arange(0, keys.size + 1, len(places)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0)[low:high], pa.array(np.diff(borders)), pa.array(digests(tokens, borders)),
                pa.ListArray.from_arrays(border, pa.array(keys.ravel().view(np.int64))), batch.column(1)[low:high],
            ], names=["id", "n", "node", "keys", "text"])

    docs = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    described = map_arrow(docs, describe, "id bigint, n bigint, node bigint, keys array<bigint>, text string")
    known = written(described.select("id", "n", "node"), "nodes")
    # Rows of one set have the same keys; any of their texts stands for it.
    nodes = written(described.where("n > 0").groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("text").alias("text")), "texts")
    buckets = nodes.select("node", F.posexplode("keys").alias("place", "key"))
    least = buckets.groupBy("place", "key").agg(F.min("node").alias("first"), F.max("node").alias("end")).where(F.col("first") < F.col("end")).drop("end")
    buckets = written(buckets.join(least, ["place", "key"]), "buckets")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda name: nodes.select(F.col("node").alias(name), F.col("text").alias(f"{name}_text"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for low in range(0, batch.num_rows, 256):
                some, sets = batch.slice(low, 256), []
                for column in (2, 3):
                    sets.append([s for _, _, tokens, _, borders in sets_of(some.column(column), k) for s in np.split(tokens, borders[1:-1])])
                shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets)])
                union = np.array([len(x) + len(y) for x, y in zip(*sets)]) - shared
                yield some.select(["a", "b"]).filter(pa.array(100 * shared >= percent * union))

        return written(map_arrow(both.select("a", "b", "a_text", "b_text"), run, "a bigint, b bigint"), "links")

    first = buckets.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(first)
    roots = written(connected(links), "roots")
    rooted = buckets.join(roots.withColumnRenamed("root", "r"), "node", "left").select("place", "key", "node", F.coalesce("r", "node").alias("r"))
    mixed = rooted.groupBy("place", "key").agg(F.min("r").alias("low"), F.max("r").alias("high")).where(F.col("low") < F.col("high")).select("place", "key")
    open_ = written(rooted.join(mixed, ["place", "key"], "left_semi"), "open")
    left, right = (open_.select("place", "key", F.col("node").alias(x), F.col("r").alias(f"{x}_root")) for x in "ab")
    pairs = left.join(right, ["place", "key"]).where("a < b AND a_root <> b_root").select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    more = verified(pairs)
    if not more.isEmpty():
        roots = written(connected(links.unionByName(more)), "roots")
    named = known.join(roots, "node", "left").select("id", "n", F.coalesce("root", "node").alias("root"))
    smallest = named.where("n > 0").groupBy("root").agg(F.min("id").alias("smallest"))
    out = named.join(smallest, (named["n"] > 0) & (named["root"] == smallest["root"]), "left")
    return out.select(F.col("id").alias(id_column), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("id")).alias("group"))
