"""Spelling variants: words one edit apart, grouped under their most frequent form, by dense prefix-suffix tiling."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import raw_texts, written

#: Runs of letters, after A-Z are lower-cased.
_RUN = re.compile("[a-zÀ-ÿ]+")
_LETTER = re.compile("[a-zÀ-ÿ]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Distinct words that a task counts before it passes them on, and code points of a text searched at a time.
_HELD, _STRETCH = 100_000, 1 << 20
#: Words of a block; a tile compares two of them.
BLOCK = 1024
#: Copies of the root table that a step of ``_roots`` joins, so that a form of very many words is no single group.
_SALT = 16


def _runs(text: str) -> Iterator[list[str]]:
    """All runs of a text, a stretch at a time; stretches end between runs."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _STRETCH)
        while end < len(text) and _LETTER.match(text, end):
            end += 1
        yield _RUN.findall(text, at, end)
        at = end


def count_words(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", drop_every: int = 199) -> DataFrame:
    """(word, n): the words of all whole texts and how often each occurs.

    A word is a run of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case. Where the crc32 of ``<id>:<run>`` is a multiple
    of ``drop_every`` (0: nowhere), the run loses its code point number crc32 % length. Null texts have no words, a null
    id counts as no text before the colon; what is left of a run of one code point is no word. Each task counts on its
    own and passes partial counts on, so a word that fills a third of the corpus costs a row a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            data, offsets = raw_texts(batch.column(1))
            for row, name in enumerate(batch.column(0).to_pylist()):
                text = data[offsets[row] : offsets[row + 1]].tobytes().translate(_LOWER).decode()
                start = zlib.crc32(f"{name if name is not None else ''}:".encode())
                for found in _runs(text):
                    for word, n in Counter(found).items():
                        if drop_every:
                            code = zlib.crc32(word.encode(), start)
                            if code % drop_every == 0:
                                at = code % len(word)
                                word = word[:at] + word[at + 1 :]
                        held[word] += n
                    if len(held) > _HELD:
                        yield out()
                        held = Counter()
        if held:
            yield out()

    texts = documents.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    counted = texts.mapInArrow(run, "word string, n bigint").where("word <> ''")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the words and two padded matrices of their code points: from the first on, and up to the last. Padding is 0."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint32) + np.uint32(1)
    if len(codes) and codes.max() < 256:
        codes = codes.astype(np.uint8)
    width = int(lengths.max()) if len(words) else 0
    place = np.arange(width)
    left, right = np.zeros((len(words), width), codes.dtype), np.zeros((len(words), width), codes.dtype)
    left[place < lengths[:, None]] = codes
    right[place >= width - lengths[:, None]] = codes
    return lengths, left, right


def _common(a: np.ndarray, b: np.ndarray, places) -> np.ndarray:
    """For all pairs of rows of a and b, the number of equal code points before the first unequal one, in the order of ``places``."""
    alive = np.ones((len(a), len(b)), bool)
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in places:
        alive &= a[:, k, None] == b[None, :, k]
        if not alive.any():
            break
        out += alive
    return out


def near_pairs(words: tuple[np.ndarray, np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, least: int | None = None) -> np.ndarray:
    """The matrix of the rows a against the rows b of ``code_points``: which pairs differ by one edit.

    Common prefix and common suffix of two different words together reach the longer length minus one exactly where one
    inserted, deleted or replaced code point makes one of the other. With ``least``, pairs of so long a common prefix are left out.
    """
    lengths, left, right = words
    width = left.shape[1]
    prefix = _common(left[a], left[b], range(width))
    suffix = _common(right[a], right[b], range(width - 1, -1, -1))
    la, lb = lengths[a][:, None], lengths[b][None, :]
    near = (np.abs(la - lb) <= 1) & (prefix + suffix >= np.maximum(la, lb) - 1) & ((la != lb) | (prefix < la))
    return near & (prefix < least) if least is not None else near


def _tile(table: dict[str, np.ndarray], words: tuple, begin: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of one tile, as row numbers. Rows begin to end hold its one or two blocks, each of words of the tile's length or one more."""
    short = int(table["length"][begin])
    least = short // 2 if table["side"][begin] == "s" else None
    rows = np.arange(begin, end)
    second = table["block"][begin:end] == table["high"][begin]
    blocks = [rows[second]] if table["low"][begin] == table["high"][begin] else [rows[~second], rows[second]]
    is_short = words[0] == short
    first, last = blocks[0], blocks[-1]
    for a, b in [(first[is_short[first]], last)] + ([(first[~is_short[first]], last[is_short[last]])] if len(blocks) == 2 else []):
        if len(a) and len(b):
            near = near_pairs(words, a, b, least)
            if len(blocks) == 1:  # of two words of one length, once
                near &= ~is_short[b][None, :] | (a[:, None] < b[None, :])
            x, y = np.nonzero(near)
            yield a[x], b[y]


def _best(table: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """For each word of the pairs: how many near words it has here, and the most frequent (then smallest) of them."""
    x, y = np.concatenate((x, y)), np.concatenate((y, x))
    order = np.lexsort((table["word"][y], -table["n"][y], table["word"][x]))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.append(True, table["word"][x][1:] != table["word"][x][:-1])) if len(x) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(table["word"][x[first]].tolist(), pa.string()), pa.array(np.diff(np.append(first, len(x)))),
        pa.array(table["n"][y[first]]), pa.array(table["word"][y[first]].tolist(), pa.string()),
    ], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) of every word of ``words`` (word, n; distinct) that has a near one.

    Of two near words, the shorter with a code points, the first or the last a // 2 code points are equal. So words meet in
    groups of one such half and length, and only there, tile by tile: a group is cut into blocks of about ``block`` words,
    each two blocks are a tile of their own, dealt over the tasks, and a tile compares all its words in dense matrices.
    Pairs that share both halves are counted in the group of the first. Tiles pass on sums, not pairs.
    """
    size = F.length("word")

    def halves(short):
        half = F.floor(short / 2).cast("int")
        return [F.struct(F.lit("p").alias("side"), short.alias("length"), F.left("word", half).alias("half")),
                F.struct(F.lit("s").alias("side"), short.alias("length"), F.right("word", half).alias("half"))]

    key = ["side", "length", "half"]
    entries = words.where(size > 0).select("word", "n", F.explode(F.array(*halves(size), *halves(size - 1))).alias("k")).select("k.*", "word", "n").where("length > 0")
    large = entries.groupBy(*key).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > block)
    blocks = F.ceil(F.coalesce(F.col("words"), F.lit(1)) / block).cast("int")
    placed = entries.join(large, key, "left").withColumn("block", F.pmod(F.xxhash64("word"), blocks).cast("int"))
    tiles = placed.select(*key, "word", "n", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    tiles = tiles.select(*key, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "word", "n")
    dealt = tiles.repartition(*key, "low", "high").sortWithinPartitions(*key, "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def compared(part: pa.Table, whole: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            """Near words of all tiles that end in ``part``, then the rows of the tile still open."""
            plain = {n: part.column(n).to_numpy(zero_copy_only=False) for n in part.column_names}
            plain["half"] = plain["half"].astype(str)
            new = np.zeros(len(part), bool)
            new[:1] = True
            for n in (*key, "low", "high"):
                new[1:] |= plain[n][1:] != plain[n][:-1]
            edges = np.append(np.flatnonzero(new), len(part))
            done = len(edges) - 1 if whole else len(edges) - 2
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            if done > 0:
                plain["word"] = plain["word"].astype(str)
                codes, held = code_points(plain["word"].tolist()), 0
                for begin, end in zip(edges[:done], edges[1 : done + 1]):
                    if end - begin > 1:
                        for x, y in _tile(plain, codes, begin, end):
                            pairs.append((x, y))
                            held += len(x)
                    if held > 1 << 20:
                        yield _best(plain, *map(np.concatenate, zip(*pairs)))
                        pairs, held = [], 0
                if pairs:
                    yield _best(plain, *map(np.concatenate, zip(*pairs)))
            if not whole:
                yield part.slice(edges[done])

        for batch in batches:
            if batch.num_rows:
                for found in compared(pa.Table.from_batches([*waiting, batch]), False):
                    if isinstance(found, pa.Table):
                        waiting = found.combine_chunks().to_batches()
                    else:
                        yield found
        if waiting:
            yield from compared(pa.Table.from_batches(waiting), True)

    found = dealt.mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def _roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) of all words of ``forms`` (word, form): the end of each chain, by steps that double."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        # Only words that are a root of others are looked up; hot ones in _SALT copies.
        named = now.select(F.col("root").alias("word")).distinct()
        further = now.join(named, "word", "left_semi").select(F.col("word").alias("at"), F.col("root").alias("next"))
        if further.isEmpty():
            return now
        further = further.select("*", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))).alias("salt"))
        salted = now.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(_SALT)).cast("int"))
        now = written(salted.join(further, (salted["root"] == further["at"]) & (salted["salt"] == further["salt"]), "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    raise RuntimeError(f"chains of forms do not end after {rounds} rounds")


def spelling_variants(words: DataFrame, *, factor: int = 5, block: int = BLOCK) -> DataFrame:
    """Every word of ``words`` (word, n; distinct) with ``n_near``, ``form``, ``form_n`` and ``root``.

    Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its near
    word of largest n (ties: the first in the order of code points) if that n is at least ``factor`` times its own, else null;
    its root is where its forms end, or itself. Null and empty words are left out; an empty table gives an empty one.
    """
    if factor < 2:
        raise ValueError("forms must be more frequent than their words, or chains would not end")
    words = words.select("word", "n").where("word <> ''")
    joined = words.join(near_words(words, block), "word", "left")
    good = F.col("best_n") >= factor * F.col("n")
    named = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    named = written(named, "forms")
    roots = _roots(named.where(F.col("form").isNotNull()))
    out = named.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_of(documents: DataFrame, *, least_length: int = 6, least_n: int = 5, factor: int = 5, **options) -> DataFrame:
    """``spelling_variants`` of the words of all documents that have ``least_length`` code points and occur ``least_n`` times."""
    words = count_words(documents, **options).where((F.length("word") >= least_length) & (F.col("n") >= least_n))
    return spelling_variants(written(words, "words"), factor=factor)
