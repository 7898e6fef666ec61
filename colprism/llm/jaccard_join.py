"""N-gram Jaccard join: exact links between similar sets of word shingles, with set relations to skip work.

* **Block skipping.** Sets are indexed by a prefix of their shingles, rarest first. The list of a shingle holds (set,
  size, position of the shingle in the set's order); long lists are walked block against block, and a pair of blocks is
  passed over when its sizes, positions or components show that no pair in it can be a new link.
* **Incremental answers.** In a long list every set first meets one leader only, the set where the shingle stands
  earliest. The exact difference to the leader then answers for others: the difference of two sets is at least the gap
  between their differences to the leader, so most pairs of the list are settled without being compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import SPACED, drop, give_back, map_arrow, mix64, raw_texts, shingles, slices, words_of, written
from .components import connected

#: Lists up to this length compare all their sets at once.
SHORT = 8
#: Counters of the sketch of shingle frequencies, and of a part of it.
_COUNTERS, _PART = 1 << 22, 1 << 16
#: Bytes of text whose shingles are made at a time: the arrays take some forty times the bytes.
_SLICE = 1 << 20
#: Entries of the index that one group holds, about.
_GROUP = 400_000
_BLOCK = 64
#: Bits of a set's sign: bit i tells whether an odd number of its shingles falls on i.
_SIGN = 1024
#: Sets whose signs are counted at a time.
_SIGNED = 2048
_PAIRS = 2_000_000
_ENTRY = np.dtype([("token", "<u8"), ("set", "<i8"), ("size", "<i4"), ("pos", "<i4")])


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first and last row, the distinct 48-bit shingles of all rows (row after row, ascending), their row, and borders."""
    data, offsets = raw_texts(column)
    for begin, end in slices(offsets, _SLICE):
        for low in range(begin, end, 60_000):
            high = min(end, low + 60_000)
            part = data[offsets[low] : offsets[high]]
            hashes, _, _, counts = words_of(part, offsets[low : high + 1] - offsets[low], SPACED)
            made, row = shingles(hashes, counts, k)
            packed = np.sort((row.astype(np.uint64) << np.uint64(48)) | (made >> np.uint64(16)))
            keep = np.ones(len(packed), bool)
            keep[1:] = packed[1:] != packed[:-1]
            packed = packed[keep]
            row = (packed >> np.uint64(48)).astype(np.int64)
            yield low, high, packed & np.uint64((1 << 48) - 1), row, np.searchsorted(row, np.arange(high - low + 1))


def digests(tokens: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set; 0 for an empty one."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(tokens + np.uint64(1)))))
    n = np.diff(borders).astype(np.uint64)
    out = mix64((total[borders[1:]] - total[borders[:-1]]) ^ mix64(n))
    out[n == 0] = 0
    return out.view(np.int64)


def signs(tokens: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Signs of sets, as 64-bit words. Two signs differ in no more bits than their sets do in shingles."""
    bit = (mix64(tokens + np.uint64(7)) % np.uint64(_SIGN)).astype(np.int64)
    out = np.zeros((rows, _SIGN // 64), np.int64)
    for low in range(0, rows, _SIGNED):
        height = min(_SIGNED, rows - low)
        begin, end = np.searchsorted(row, [low, low + height])
        odd = (np.bincount((row[begin:end] - low) * _SIGN + bit[begin:end], minlength=height * _SIGN) & 1).astype(np.uint8)
        out[low : low + height] = np.packbits(odd.reshape(height, _SIGN), axis=1).view(np.int64)
    return out


def _least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that sets of sizes a and b need: 100 * overlap >= percent * (a + b - overlap)."""
    return -((-percent * (a.astype(np.int64) + b)) // (100 + percent))


def _possible(entries, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of entries of one list that sizes and positions allow, if the list's shingle is the first they share.

    A link passes in the list of its first shared shingle, so it need not pass in others.
    """
    a, b = entries["size"][x].astype(np.int64), entries["size"][y].astype(np.int64)
    most = np.minimum(a - entries["pos"][x], b - entries["pos"][y])
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (most >= _least_overlap(a, b, percent))


def _counted(entries, x: np.ndarray, y: np.ndarray, kind: int) -> pa.RecordBatch:
    """Distinct pairs of sets and how many lists showed each."""
    swap = entries["set"][x] > entries["set"][y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    order = np.lexsort((entries["set"][y], entries["set"][x]))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (entries["set"][x][1:] != entries["set"][x][:-1]) | (entries["set"][y][1:] != entries["set"][y][:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(x)))
    x, y = x[first], y[first]
    none = pa.nulls(len(x), pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(x), kind, np.int32)), pa.array(entries["set"][x]), pa.array(entries["set"][y]), pa.array(entries["size"][x]),
        pa.array(entries["size"][y]), pa.array(n.astype(np.int64)), none,
    ], names=["kind", "a", "b", "a_size", "b_size", "n", "token"])


_LISTED = "kind int, a bigint, b bigint, a_size int, b_size int, n bigint, token bigint"
_LISTED_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("a_size", pa.int32()), ("b_size", pa.int32()), ("n", pa.int64()), ("token", pa.int64())])


def _lists(table: pa.Table, percent: int) -> pa.Table:
    """Kind 0: pairs of short lists. Kind 1: pairs of the leader and the others of long lists. Kind 2: entries (set in
    ``a``, leader in ``b``, size, position in ``b_size``) of long lists."""
    entries = np.frombuffer(b"".join(table.column("entries").to_pylist()), _ENTRY)
    entries = entries[np.lexsort((entries["set"], entries["token"]))]
    keep = np.ones(len(entries), bool)
    keep[1:] = (entries["token"][1:] != entries["token"][:-1]) | (entries["set"][1:] != entries["set"][:-1])
    entries = entries[keep]
    entries = entries[np.lexsort((entries["set"], entries["size"], entries["pos"], entries["token"]))]
    opens = np.ones(len(entries), bool)
    opens[1:] = entries["token"][1:] != entries["token"][:-1]
    starts = np.flatnonzero(opens)
    lengths = np.diff(np.append(starts, len(entries)))
    out = []
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, SHORT + 1):
        at = starts[lengths == n]
        for i in range(n):
            for j in range(i + 1, n):
                good = _possible(entries, at + i, at + j, percent)
                x.append(at[good] + i)
                y.append(at[good] + j)
    out.append(_counted(entries, np.concatenate(x), np.concatenate(y), 0))
    long = lengths > SHORT
    if long.any():
        leader = np.repeat(starts[long], lengths[long])
        member = leader + np.arange(len(leader)) - np.repeat(np.cumsum(lengths[long]) - lengths[long], lengths[long])
        other = (member > leader) & _possible(entries, leader, member, percent)
        out.append(_counted(entries, leader[other], member[other], 1))
        out.append(pa.RecordBatch.from_arrays([
            pa.array(np.full(len(member), 2, np.int32)), pa.array(entries["set"][member]), pa.array(entries["set"][leader]), pa.array(entries["size"][member]),
            pa.array(entries["pos"][member]), pa.nulls(len(member), pa.int64()), pa.array(entries["token"][member].astype(np.int64)),
        ], names=_LISTED_ARROW.names))
    return pa.Table.from_batches(out, schema=_LISTED_ARROW)


def _rest(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of different components in long lists, block against block."""
    names = ["token", "set", "size", "pos", "root", "gap"]
    c = {n: table.column(n).to_numpy() for n in names}
    order = np.lexsort((c["pos"], c["size"], c["root"], c["token"]))
    c = {n: v[order] for n, v in c.items()}
    edges = np.append(np.flatnonzero(np.append(True, c["token"][1:] != c["token"][:-1])), len(order))
    out = []
    xs, ys, held = [], [], 0

    def flush() -> None:
        nonlocal xs, ys, held
        if held:
            out.append(_counted(c, np.concatenate(xs), np.concatenate(ys), 0))
        xs, ys, held = [], [], 0

    for begin, end in zip(edges[:-1], edges[1:]):
        cuts = np.append(np.arange(begin, end, _BLOCK), end)
        low, high = cuts[:-1], cuts[1:]
        spread = {n: (np.minimum.reduceat(c[n][begin:end], low - begin), np.maximum.reduceat(c[n][begin:end], low - begin)) for n in ("size", "pos", "root")}
        for i in range(len(low)):
            size, pos, root = (spread[n] for n in ("size", "pos", "root"))
            j = np.arange(i, len(low))
            skip = (root[0][j] == root[1][j]) & (root[0][i] == root[1][i]) & (root[0][i] == root[0][j])
            skip |= (100 * size[1][i] < percent * size[0][j]) | (100 * size[1][j] < percent * size[0][i])
            # From its first shared shingle on, the smaller rest of a pair must hold the overlap.
            skip |= np.minimum(size[1][i] - pos[0][i], size[1][j] - pos[0][j]) < _least_overlap(size[0][i], size[0][j], percent)
            for other in j[~skip]:
                x, y = np.divmod(np.arange((high[i] - low[i]) * (high[other] - low[other])), high[other] - low[other])
                x, y = x + low[i], y + low[other]
                good = (x < y) & (c["root"][x] != c["root"][y])
                x, y = x[good], y[good]
                good = _possible(c, x, y, percent)
                allowed = c["size"][x].astype(np.int64) + c["size"][y] - 2 * _least_overlap(c["size"][x], c["size"][y], percent)
                known = (c["gap"][x] >= 0) & (c["gap"][y] >= 0)
                good &= ~(known & (np.abs(c["gap"][x] - c["gap"][y]) > allowed))
                xs.append(x[good])
                ys.append(y[good])
                held += int(good.sum())
                if held > _PAIRS:
                    flush()
    flush()
    return pa.Table.from_batches(out, schema=_LISTED_ARROW)


def _pressed(texts: pa.Array) -> pa.Array:
    """Texts compressed one by one, for the shuffles on their way to the pairs."""
    press = zstandard.ZstdCompressor(level=1)
    return pa.array([press.compress(t.as_buffer()) for t in texts.cast(pa.large_binary())], pa.binary())


def _verify(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, a_size, b_size, overlap): exact overlaps from the whole texts of both sets."""
    left = texts.select(F.col("set").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("set").alias("b"), F.col("text").alias("b_text"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_size", "b_size", "a_text", "b_text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first in range(0, batch.num_rows, 512):
            some = batch.slice(first, 512)
            n = some.num_rows
            tokens: list[list[np.ndarray]] = [[], []]
            for side in (0, 1):
                open_ = zstandard.ZstdDecompressor()
                texts = pa.array([open_.decompress(t.as_buffer()) for t in some.column(4 + side)], pa.large_binary())
                for _, _, found, _, borders in sets_of(texts, k):
                    tokens[side] += np.split(found, borders[1:-1])
            overlap = np.array([len(np.intersect1d(tokens[0][i], tokens[1][i], assume_unique=True)) for i in range(n)], np.int64)
            yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(overlap)], names=["a", "b", "a_size", "b_size", "overlap"])

    return map_arrow(both, run, "a bigint, b bigint, a_size int, b_size int, overlap bigint")


def similar_groups(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Every document's ``n_shingles`` and ``component_id``, the group that links connect, exactly; not the links themselves.

    Words lie between ASCII white space, without regard to A-Z or a-z. A set holds the distinct shingles of
    ``shingle_words`` words; a text of fewer words has one shingle of all. Two documents link if
    100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id that links reach.

    1. One pass over the texts gives size and digest of every set and a sketch of shingle frequencies of fixed size.
       Documents of one set are one node from here on, however many.
    2. A second pass indexes prefixes: of a set's shingles, in the order of their frequency class, then of their hash,
       so many that sets which link share one of them.
    3. Short lists give all their pairs, long ones pairs with their leader; the pairs that sizes and positions allow are
       verified with the whole texts, unless 1,024 bits of each set already tell them apart, and links join components. Long lists that still hold several components are walked
       block by block for pairs across components, which are verified in turn. A pair within a component needs no test;
       no other is lost.

    Nulls and texts without words have no shingles, link with nothing and are their own component. Repeated rows are in
    one group. Rows with a null id belong to groups, but give no ``component_id`` unless nothing else is there (null).
    Digests have 64 bits and shingles 48; with n different sets, one pair of digests falls together with odds of about n * n / 2^65.
    """
    docs = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    spark = documents.sparkSession

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(_COUNTERS, np.uint32)
        names = ["id", "n", "set", "sign", "part", "counts"]
        for batch in batches:
            for low, high, tokens, row, borders in sets_of(batch.column(1), shingle_words):
                np.add.at(counters, (tokens & np.uint64(_COUNTERS - 1)).astype(np.int64), 1)
                size = high - low
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[low:high], pa.array(np.diff(borders)), pa.array(digests(tokens, borders)),
                    pa.FixedSizeListArray.from_arrays(pa.array(signs(tokens, row, size).ravel()), _SIGN // 64).cast(pa.list_(pa.int64())),
                    pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()),
                ], names=names)
        parts = [p for p in range(_COUNTERS // _PART) if counters[p * _PART : (p + 1) * _PART].any()]
        blobs = [zlib.compress(counters[p * _PART : (p + 1) * _PART].tobytes(), 1) for p in parts]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.list_(pa.int64())), pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=names)
        give_back()

    seen = docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(describe, "id bigint, n bigint, set bigint, sign array<bigint>, part int, counts binary")
    seen = written(seen, "sets")
    known = written(seen.where(F.col("part").isNull()).select("id", "n", "set"), "known")

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_PART, np.uint32)
        for blob in table.column("counts"):
            total += np.frombuffer(zlib.decompress(blob.as_py()), np.uint32)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    sketch = np.zeros(_COUNTERS, np.uint32)
    blobs = seen.where(F.col("part").isNotNull()).select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("lane"))
    lanes = blobs.groupBy("part", "lane").applyInArrow(add, "part int, counts binary")  # in two levels: no task adds the counters of all others
    for part, counts in lanes.groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        sketch[part * _PART : (part + 1) * _PART] = np.frombuffer(zlib.decompress(counts), np.uint32)
    total = int(sketch.sum(dtype=np.uint64))
    mean = total / _COUNTERS
    # Frequency classes: what stands out of the counters' noise, in powers of two.
    level = np.clip(np.floor(np.log2(np.maximum(1, (sketch - mean - 3 * np.sqrt(mean)) + 1))), 0, 15).astype(np.uint8)
    groups = max(1, -(-int(total * (100 - percent) / 100 + 1) // _GROUP))

    def index(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high, tokens, row, borders in sets_of(batch.column(0), shingle_words):
            size = np.diff(borders)
            names = digests(tokens, borders)
            _, first = np.unique(names, return_index=True)  # equal sets of a slice are indexed once
            once = np.zeros(high - low, bool)
            once[first] = True
            once &= size > 0
            order = level[(tokens & np.uint64(_COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
            packed = np.sort((row.astype(np.uint64) << np.uint64(48)) | (order << np.uint64(44)) | (tokens >> np.uint64(4)))
            place = np.arange(len(packed)) - borders[row]
            length = size - (-(-percent * size // 100)) + 1
            keep = (place < length[row]) & once[row]
            entries = np.zeros(int(keep.sum()), _ENTRY)
            entries["token"] = packed[keep] & np.uint64((1 << 44) - 1)
            entries["set"], entries["size"], entries["pos"] = names[row[keep]], size[row[keep]], place[keep]
            group = (mix64(entries["token"]) % np.uint64(groups)).astype(np.int32)
            sort = np.argsort(group, kind="stable")
            entries, group = entries[sort], group[sort]
            cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([
                pa.array(group[cuts]), pa.array([e.tobytes() for e in np.split(entries, cuts[1:])] if len(cuts) else [], pa.binary()),
            ], names=["group", "entries"])

    posted = map_arrow(docs.select("text"), index, "group int, entries binary")
    listed = posted.groupBy("group").applyInArrow(lambda table: _lists(table, percent), _LISTED)
    listed = written(listed, "lists")

    def distinct(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a", "b").agg(F.first("a_size").alias("a_size"), F.first("b_size").alias("b_size"))

    linked = 100 * F.col("overlap") >= percent * (F.col("a_size") + F.col("b_size") - F.col("overlap"))
    owners = known.where(F.col("n") > 0).groupBy("set").agg(F.min("id").alias("id"))  # null where no row of the set has an id

    def text_of(nodes: DataFrame) -> DataFrame:
        """(set, text) of one document for each of the nodes."""
        wanted = nodes.join(owners, "set").select("set", F.col("id").alias("wanted"))
        number = F.col("id").cast("long")
        found = docs.join(wanted, number == F.col("wanted")).select("set", "text")

        def check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for low, high, tokens, _, borders in sets_of(batch.column(1), shingle_words):
                right = digests(tokens, borders) == batch.column(0)[low:high].to_numpy()  # rows of one id may have several texts
                some = batch.slice(low, high - low).filter(pa.array(right))
                yield pa.RecordBatch.from_arrays([some.column(0), _pressed(some.column(1))], names=["set", "text"])

        def name(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for low, high, tokens, _, borders in sets_of(batch.column(0), shingle_words):
                yield pa.RecordBatch.from_arrays([pa.array(digests(tokens, borders)), _pressed(batch.column(0)[low:high].fill_null(""))], names=["set", "text"])

        # Rows without id are many to one null: their sets are told by digest.
        nameless = map_arrow(docs.where(number.isNull()).select("text"), name, "set bigint, text binary")
        nameless = nameless.join(wanted.where(F.col("wanted").isNull()).select("set"), "set", "left_semi")
        return map_arrow(found, check, "set bigint, text binary").unionByName(nameless).dropDuplicates(["set"])

    sign_of = seen.where(F.col("n") > 0).groupBy("set").agg(F.any_value("sign").alias("sign"))
    sign_of = written(sign_of, "signs")
    drop(seen)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        # Signs that differ in more bits than linked sets can differ in shingles rule a pair out before texts are fetched.
        signed = pairs.join(sign_of.select(F.col("set").alias("a"), F.col("sign").alias("a_sign")), "a")
        signed = signed.join(sign_of.select(F.col("set").alias("b"), F.col("sign").alias("b_sign")), "b")
        apart = F.aggregate(F.zip_with("a_sign", "b_sign", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        both = F.col("a_size") + F.col("b_size")
        pairs = signed.where(apart <= both - 2 * F.ceil(percent * both / (100 + percent))).select("a", "b", "a_size", "b_size")
        pairs = written(pairs, name)
        nodes = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
        texts = written(text_of(nodes), "texts")
        found = written(_verify(pairs, texts, shingle_words), "overlaps")
        drop(pairs, texts)
        return found

    first = verified(distinct(listed.where("kind < 2")), "pairs")
    links = first.where(linked).select("a", "b")
    roots = written(connected(links), "roots")

    entries = listed.where("kind = 2").select("token", F.col("a").alias("set"), F.col("b").alias("leader"), F.col("a_size").alias("size"), F.col("b_size").alias("pos"))
    entries = entries.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    mixed = entries.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") < F.col("high")).select("token")
    gaps = first.select(F.explode(F.array(F.struct(F.col("a").alias("leader"), F.col("b").alias("set")), F.struct(F.col("b").alias("leader"), F.col("a").alias("set")))).alias("p"),
                        (F.col("a_size") + F.col("b_size") - 2 * F.col("overlap")).alias("gap")).select("p.*", "gap")
    open_ = entries.join(mixed, "token", "left_semi").join(gaps, ["leader", "set"], "left")
    open_ = open_.withColumn("gap", F.when(F.col("leader") == F.col("set"), 0).otherwise(F.coalesce("gap", F.lit(-1))).cast("long"))
    open_ = open_.withColumn("group", F.pmod(F.xxhash64("token"), F.lit(groups)).cast("int")).select("group", "token", "set", "size", "pos", "root", "gap")
    rest = open_.groupBy("group").applyInArrow(lambda table: _rest(table, percent), _LISTED)
    rest = written(rest, "rest")
    drop(listed)
    second = distinct(rest).join(first.select("a", "b"), ["a", "b"], "left_anti")
    second = verified(second, "more-pairs")
    drop(rest, sign_of, first)
    new = second.where(linked).select("a", "b")
    if not new.isEmpty():
        before, roots = roots, written(connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new)), "roots")
        drop(before)
    drop(second)

    rooted = owners.join(roots.withColumnRenamed("node", "set"), "set", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "set"))
    least = rooted.groupBy("root").agg(F.min("id").alias("least"))
    named = written(rooted.join(least, "root").select(F.col("set").alias("of"), "least"), "components")
    drop(roots)
    out = known.join(named, (F.col("n") > 0) & (F.col("set") == F.col("of")), "left")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))
