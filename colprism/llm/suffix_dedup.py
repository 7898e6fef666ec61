"""Suffix-array dedup: remove bytes covered by long strings that occur elsewhere, by external induced sorting.

Shards of the corpus are suffix-sorted apart from each other. So that equal strings meet, a shard holds everything
around the anchors that hash to it: an anchor is the 32 bytes of smallest hash in some window, and every string of the
wanted length holds an anchor that its content alone decides. Only anchors that occur twice are sorted at all.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop, map_arrow, mix64, raw_texts, written

LENGTH = 400
GRAM = 32
#: Bytes of text that a shard holds, about; and bytes of queues that a task keeps in memory before they go to its disk.
SHARD_BYTES = 4_000_000
QUEUE_BYTES = 256_000_000
#: An anchor of more occurrences than this is no shard's: its strings are counted one by one, over all tasks.
HOT = 20_000
_STRETCH = 2 << 20
_HASHED = 1 << 18
_BASE = 0xD1342543DE82EF95
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            np.multiply.accumulate(row, out=row)
            made.append(row)
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every string of ``width`` bytes, a stretch at a time."""
    n = max(0, len(data) - width + 1)
    out = np.empty(n, np.uint64)
    for low in range(0, n, _HASHED):
        high = min(n, low + _HASHED)
        part = data[low : high + width - 1]
        power, inverse = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * power[: len(part)], out=total[1:])
        out[low:high] = mix64((total[width:] - total[: high - low]) * inverse[: high - low])
    return out


def anchors(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's anchors in order: hash, and the first and last start of the strings that they stand for.

    The anchor of a string of ``length`` bytes is its gram of smallest hash, the first of equals; so equal strings have
    equal anchors at equal places, and an anchor stands for a stretch of starts. Long texts are done in pieces.
    """
    width = length - gram + 1
    where, hashes = [], []
    for begin in range(0, max(0, len(data) - length + 1), _STRETCH):
        part = data[begin : begin + _STRETCH + length - 1]
        found = window_hashes(part, gram)
        key = (found & ~np.uint64((1 << 22) - 1)) | np.arange(len(found), dtype=np.uint64)
        blocks = -(-len(key) // width)
        padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        square = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(square, axis=1).ravel()
        behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(part) - length + 1
        least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
        at = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
        where.append(at + begin)
        hashes.append(found[at])
    if not where:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, found = np.concatenate(where), np.concatenate(hashes)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return found[first], first, np.append(first[1:], len(place)) - 1


class Queues:
    """Queues of suffixes by first letter, served letter by letter; what exceeds ``limit`` bytes waits on the task's disk.

    A letter's entries come out in the order in which they went in. The file has no name and goes with the task.
    """

    def __init__(self, letters: int, limit: int = QUEUE_BYTES):
        self.parts: list[list] = [[] for _ in range(letters)]
        self.limit, self.held, self.file = limit, 0, None

    def push(self, letters: np.ndarray, suffixes: np.ndarray) -> None:
        order = np.argsort(letters, kind="stable")
        letters, suffixes = letters[order], suffixes[order]
        cuts = np.flatnonzero(np.append(True, letters[1:] != letters[:-1])) if len(letters) else np.zeros(0, int)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(letters)]):
            part = suffixes[a:b]
            if self.held + part.nbytes > self.limit:
                self.file = self.file or tempfile.TemporaryFile()
                self.file.seek(0, 2)
                at = self.file.tell()
                self.file.write(part.tobytes())
                self.parts[letters[a]].append((at, len(part)))
            else:
                self.held += part.nbytes
                self.parts[letters[a]].append(part)

    def pop(self, letter: int) -> np.ndarray:
        out = []
        for part in self.parts[letter]:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(4 * part[1]), np.int32)
            else:
                self.held -= part.nbytes
            out.append(part)
        self.parts[letter] = []
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int, limit: int) -> np.ndarray:
    """All suffixes in order, induced from the seeds (suffixes that open a rising stretch) in order.

    A suffix that falls follows from the one after it, letter by letter upwards; one that rises follows downwards.
    ``small`` marks rising suffixes. Every step takes a whole queue at a time.
    """
    seeded = Queues(letters, limit)
    seeded.push(text[seeds], seeds)
    queues = Queues(letters, limit)

    def induce(batch: np.ndarray, letter: int, rising: bool) -> np.ndarray:
        """Push what the batch induces at other letters; return what it induces at the same."""
        before = batch[batch > 0] - 1
        before = before[small[before] == rising]
        first = text[before]
        same = first == letter
        if not same.all():
            queues.push(first[~same], before[~same])
        return before[same]

    falling: list[np.ndarray] = []
    for letter in range(letters):
        out, batch = [], queues.pop(letter)
        while len(batch):
            out.append(batch)
            batch = induce(batch, letter, False)
        falling.append(np.concatenate(out) if out else np.zeros(0, np.int32))
        induce(seeded.pop(letter), letter, False)
    rising: list[np.ndarray] = [np.zeros(0, np.int32)] * letters
    for letter in range(letters - 1, -1, -1):
        out, batch = [], queues.pop(letter)
        while len(batch):
            out.append(batch)
            batch = induce(batch, letter, True)
        rising[letter] = np.concatenate(out) if out else np.zeros(0, np.int32)
        induce(falling[letter][::-1], letter, True)
    # The end of the text is a seed that nothing induces: it comes first.
    return np.concatenate([[len(text) - 1], *(part for i in range(letters) for part in (falling[i], rising[i][::-1]))]).astype(np.int32)


def _rank_tuples(names: np.ndarray, rounds: int, alike: np.ndarray | None) -> np.ndarray:
    """Order of the suffixes of a string of names, by ranks of tuples that double; only ties are sorted again.

    Suffixes that tie and are ``alike`` (as far as the order matters) stay tied.
    """
    order = np.argsort(names, kind="stable")
    new = np.append(True, names[order][1:] != names[order][:-1])
    rank = np.zeros(len(names), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    n, step = len(rank), 1

    def open_ties(live: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Of suffixes in order, with the first of each tie marked, those of ties that must be sorted on."""
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(live)))
        going = size > 1
        if alike is not None:
            going &= np.minimum.reduceat(alike[live], heads) != np.maximum.reduceat(alike[live], heads)
        return live[np.repeat(going, size)]

    live = open_ties(order, new)
    for _ in range(rounds):
        if not len(live):
            break
        then = np.where(live + step < n, rank[np.minimum(live + step, n - 1)] + 1, 0)
        order = np.lexsort((then, rank[live]))
        live, key = live[order], then[order]
        group = rank[live]
        opens = np.append(True, group[1:] != group[:-1])
        new = opens | np.append(True, key[1:] != key[:-1])
        at = np.arange(len(live))
        rank[live] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(opens, at, 0))
        live = open_ties(live, new)
        step *= 2
    return np.argsort(rank, kind="stable")


def suffix_order(text: np.ndarray, letters: int, depth: int, limit: int = QUEUE_BYTES, alike: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of ``text`` in the order of their first ``depth`` letters, at least. The last letter must be 0, and no other.

    Induced sorting: seeds are the suffixes that rise where the one before falls. A first induction sorts the pieces
    between seeds and names them; the string of names, a third as long or less, is sorted in turn by tuples of ranks (its
    alphabet is too large for queues by letter); a second induction takes the seeds' order to all suffixes. Suffixes of
    equal ``alike`` values share their first ``depth`` letters: their order among each other is left open.
    """
    n = len(text)
    step = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    at = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n))
    following = np.minimum.accumulate(at[::-1])[::-1]
    del at
    small = np.append(step[np.minimum(following, n - 2)] > 0, True)
    del following, step
    seeds = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    inner = seeds[seeds < n - 1]
    if len(inner) > 1:
        is_seed = np.zeros(n, bool)
        is_seed[inner] = True
        order = _induce(text, small, np.append(inner, np.int32(n - 1)), letters, limit)
        order = order[is_seed[order]]
        number = np.zeros(n, np.int32)
        number[inner] = np.arange(len(inner))
        length = np.diff(np.append(inner, n - 1))[number[order]] + 1
        differ = np.append(True, length[1:] != length[:-1])
        live, i = np.flatnonzero(~differ), 0
        while len(live):
            a, b = order[live], order[live - 1]
            unlike = text[a + i] != text[b + i]
            differ[live[unlike]] = True
            i += 1
            live = live[~unlike & (length[live] > i)]
        names = np.zeros(len(inner), np.int64)
        names[number[order]] = np.cumsum(differ)
        inner = inner[_rank_tuples(names, max(1, int(np.ceil(np.log2(depth / 2 + 2))) + 1), None if alike is None else alike[inner])]
    return _induce(text, small, np.append(inner, n - 1).astype(np.int32), letters, limit)


def shard_spans(owner: np.ndarray, start: np.ndarray, texts: list[bytes], length: int, limit: int = QUEUE_BYTES) -> Iterator[tuple[int, int, int]]:
    """(entry, first byte, byte after the last) that repeated strings cover in each entry of a shard.

    ``owner`` and ``start`` tell where an entry's text lies: document and first byte. Entries of equal text are sorted
    once; those at two places are repeated as a whole. A string at one place in two entries is one occurrence.
    """
    place: dict[bytes, int] = {}
    which = np.array([place.setdefault(t, len(place)) for t in texts], np.int64)
    distinct = list(place)
    sizes = np.array([len(t) for t in distinct], np.int64)
    _, numbers = np.unique(owner, return_inverse=True)
    spot = (numbers.ravel().astype(np.int64) << 40) + start
    low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), -1)
    np.minimum.at(low, which, spot)
    np.maximum.at(high, which, spot)
    many = low != high
    data = np.frombuffer(b"\0".join(distinct) + b"\0", np.uint8)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    letters = data.astype(np.uint16) + 2
    letters[begins + sizes] = 1
    # Strings of the wanted length inside an entry go by their hash; no other place is like another.
    inside = np.zeros(len(data) + 1, np.int8)
    whole = sizes >= length
    inside[begins[whole]] += 1
    inside[(begins + sizes - length + 1)[whole]] -= 1
    inside = np.cumsum(inside, dtype=np.int8).astype(bool)
    places = np.flatnonzero(inside)
    alike = np.arange(1, len(data) + 2, dtype=np.uint64)
    alike[places] = window_hashes(data, length)[places] | np.uint64(1 << 63)
    del places, data
    order = suffix_order(np.append(letters, 0).astype(np.uint16), 258, length, limit, alike)
    del letters
    order = order[inside[order]]
    alike = alike[order]
    same = np.zeros(len(order), bool)
    same[1:] = alike[1:] == alike[:-1]
    del alike, inside
    entry = (np.searchsorted(begins, order, "right") - 1).astype(np.int32)
    offset = order - begins[entry].astype(np.int32)
    del order
    # A run of equal strings is repeated if it lies at two places: (document, byte) of one of each entry.
    one = np.zeros(len(distinct), np.int64)
    one[which] = np.arange(len(which))
    at = spot[one[entry]] + offset
    run = np.cumsum(~same) - 1
    heads = np.flatnonzero(~same)
    if not len(heads):
        return
    least, most = np.minimum.reduceat(at, heads), np.maximum.reduceat(at, heads)
    repeated = ((least != most) | np.logical_or.reduceat(many[entry], heads))[run]
    first, last = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), -1)
    np.minimum.at(first, entry[repeated], offset[repeated])
    np.maximum.at(last, entry[repeated], offset[repeated] + length)
    for i in np.flatnonzero(last[which] > 0).tolist():
        yield i, int(start[i] + first[which[i]]), int(start[i] + last[which[i]])


def _counted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """(digest, a, b): the spans of very common anchors, without any shard, from their pieces (digest, start, body).

    Equal pieces around an anchor are counted first, within tasks and by a digest of theirs; those at two places are repeated
    as a whole. The strings of the distinct pieces that are left are counted by their hashes.
    """

    def strings(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for digest, a, lone, body in zip(*(c.to_pylist() for c in batch.columns)):
            found = window_hashes(np.frombuffer(body, np.uint8), length)
            n = len(found)
            yield pa.RecordBatch.from_arrays([
                pa.array([digest] * n, pa.binary()), pa.array(np.full(n, a)), pa.array(a + np.arange(n)), pa.array(np.full(n, lone)), pa.array(found.view(np.int64)),
            ], names=["digest", "piece", "start", "lone", "hash"])

    each = pieces.select("digest", F.col("start").alias("a"), (F.col("start") + F.octet_length("body")).alias("b"), "body", F.unhex(F.md5("body")).alias("key"))
    counted = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), F.min("digest").alias("digest"), F.any_value("body").alias("body"))
    counted = written(counted, "distinct-pieces")
    whole = each.select("digest", "a", "b", "key").join(counted.where("n > 1").select("key"), "key").select("digest", "a", "b")
    # A piece that occurs once carries its own place; of others any will do, as only their strings matter.
    found = map_arrow(counted.select("digest", "a", (F.col("n") == 1).alias("lone"), "body"), strings, "digest binary, piece bigint, start bigint, lone boolean, hash bigint")
    found = written(found, "common-strings")
    repeated = written(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "common-repeats")
    rest = found.where("lone").join(repeated, "hash").groupBy("digest", "piece").agg(F.min("start").alias("a"), (F.max("start") + length).alias("b"))
    spans = written(whole.unionByName(rest.drop("piece")), "common-spans")
    drop(counted, found, repeated)
    return spans


def remove_repeats(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Texts, as UTF-8 bytes, without each byte that a string of ``length`` bytes covers that also starts elsewhere.

    Rows: id, ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs). Strings never cross
    documents; overlaps and repeats within a document count; all is judged on the input.

    1. One pass lists digest and anchors of each text. Texts that occur twice are repeated as a whole; one of them stands
       for all from here on, so groups of copies cost one text.
    2. Anchors whose hash occurs twice go, with the text of the strings that they stand for, to the shard of their hash.
       The strings of an anchor overlap in it, so what they cover is one span.
    3. Each shard is suffix-sorted by induction; runs of suffixes that share ``length`` bytes (by a 64-bit hash of them) and
       lie at two places are repeated. Spans return to the documents and are united.

    An anchor that occurs over ``hot`` times, as in a passage that a third of the documents share, would make one shard
    of any length. Its pieces, then the strings of distinct pieces, are counted instead, first within tasks, so that
    what is common collapses before it is shuffled; the first and last repeated string bound a span as in a shard.
    Pieces of both kinds come from one pass over the texts: these cross the shuffle twice, whatever is common in them.

    Null and empty texts have no bytes. Repeated rows are copies of each other. Ids may be null or repeat.
    """
    docs = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))

    def mark(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = raw_texts(batch.column(1))
        seen: dict[bytes, int] = {}
        rows = []
        for i, digest in enumerate(batch.column(0).to_pylist()):
            if digest in seen:
                rows[seen[digest]][1] += 1
                continue
            seen[digest] = len(rows)
            found, first, last = anchors(data[offsets[i] : offsets[i + 1]], length, gram)
            rows.append([digest, 1, found.view(np.int64), first, last])
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
            *(pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (2, 3, 4)),
        ], names=["digest", "copies", "hash", "first", "last"])

    marked = map_arrow(docs.select("digest", "text"), mark, "digest binary, copies bigint, hash array<bigint>, first array<bigint>, last array<bigint>")
    marked = marked.groupBy("digest").agg(F.sum("copies").alias("copies"), *[F.any_value(c).alias(c) for c in ("hash", "first", "last")])
    marked = written(marked, "anchors")
    each = marked.select("digest", F.inline(F.arrays_zip("hash", "first", "last")))
    twice = written(each.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
    common = not twice.where(F.col("n") > hot).isEmpty()
    total = twice.where(F.col("n") <= hot).agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total * (length + length // 2) // SHARD_BYTES))
    owners = docs.groupBy("digest").agg(F.min("id").alias("owner"))

    # One text of each digest that holds such anchors, with these; a common anchor says so.
    wanted = each.join(twice.select("hash", (F.col("n") > hot).alias("common")), "hash")
    wanted = wanted.groupBy("digest").agg(F.collect_list(F.struct("hash", "first", "last", "common")).alias("marks"))
    wanted = written(wanted.join(owners, "digest"), "repeated-anchors")
    texts = docs.join(wanted, "digest").where(F.col("id").eqNullSafe(F.col("owner"))).select("digest", "text", "marks")

    def around(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = raw_texts(batch.column(1))
        for i, marks in enumerate(batch.column(2)):
            text = data[offsets[i] : offsets[i + 1]]
            marks = marks.values
            found, first, last = (marks.field(c).to_numpy() for c in ("hash", "first", "last"))
            shard = (mix64(found.view(np.uint64)) % np.uint64(shards)).astype(np.int32)
            shard[marks.field("common").to_numpy(zero_copy_only=False)] = -1
            for some in range(0, len(found), 4096):
                start, stop = first[some : some + 4096], last[some : some + 4096] + length
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard[some : some + 4096]),
                    pa.array([batch.column(0)[i].as_py()] * len(start), pa.binary()), pa.array(start),
                    pa.array([text[a:b].tobytes() for a, b in zip(start, stop)], pa.binary()),
                ], names=["shard", "digest", "start", "body"])

    pieces = map_arrow(texts, around, "shard int, digest binary, start bigint, body binary")
    if common:  # two readers
        pieces = written(pieces, "pieces")

    def sort(table: pa.Table) -> pa.Table:
        digest = table.column("digest").to_pylist()
        number: dict[bytes, int] = {}
        owner = np.array([number.setdefault(d, len(number)) for d in digest], np.int64)
        found = list(shard_spans(owner, table.column("start").to_numpy(), table.column("body").to_pylist(), length))
        return pa.table({"digest": pa.array([digest[i] for i, _, _ in found], pa.binary()), "a": pa.array([a for _, a, _ in found], pa.int64()), "b": pa.array([b for _, _, b in found], pa.int64())})

    spans = written(pieces.where("shard >= 0").groupBy("shard").applyInArrow(sort, "digest binary, a bigint, b bigint"), "spans")
    drop(wanted, twice)
    if common:
        spans = spans.unionByName(_counted_spans(pieces.where("shard < 0"), length))
        drop(pieces)
    listed = spans.groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    copied = marked.where("copies > 1").select("digest", F.lit(True).alias("copied"))
    judged = written(listed.join(copied, "digest", "full"), "judged")
    drop(marked)

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = raw_texts(batch.column(1))
        kept, numbers = [], []
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            found = batch.column(2)[i].as_py() or []
            if batch.column(3)[i].as_py() and len(text) >= length:
                found = [{"a": 0, "b": len(text)}]
            runs: list[list[int]] = []
            for s in sorted(found, key=lambda s: s["a"]):
                if runs and s["a"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s["b"])
                else:
                    runs.append([s["a"], s["b"]])
            edges = [0, *(x for r in runs for x in r), len(text)]
            kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
            numbers.append((len(text), len(text) - len(kept[-1]), len(runs)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array([n[i] for n in numbers], pa.int64()) for i in range(3))], names=["id", "kept", "n_bytes", "n_removed", "n_spans"])

    out = docs.join(judged, "digest", "left").select("id", "text", "spans", "copied")
    out = out.withColumn("id", F.col("id").cast("long"))
    return map_arrow(out, cut, "id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint").withColumnRenamed("id", id_column)
