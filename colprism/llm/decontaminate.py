"""Benchmark decontamination: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ALPHANUMERIC, annotate, mix64, raw_texts, slices, words_of

WINDOW = 13
#: Characters of benchmark texts whose tables go to the tasks together; more texts are searched block after block.
BLOCK_CHARS = 1_500_000
#: Windows of a document that one cursor walks over.
_RUN = 1024


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(3) + mix64(b))


@dataclass
class Patterns:
    """Tables for test strings of one length in words.

    ``shift``: by the hash of a block (two words; one, if the strings have one), how far the window may move. ``keys``:
    sorted hash of a string's last block and first block; ``words``: the hashes of the words, in the same order;
    ``texts``: the words themselves; ``items``: the items that hold the string.
    """

    length: int
    words: np.ndarray
    texts: list[bytes]
    items: list[list[int]]
    shift: np.ndarray = field(init=False)
    keys: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n, last = self.length, self.length - 1
        blocks = self.words if n == 1 else _pair(self.words[:, :-1], self.words[:, 1:])
        bits = max(16, int(np.ceil(np.log2(max(1, blocks.size) * 8))))
        self.shift = np.full(1 << min(bits, 26), max(1, last), np.uint16)
        ends = np.zeros(1, int) if n == 1 else np.arange(1, n)
        for column, end in enumerate(ends):
            np.minimum.at(self.shift, self.slot(blocks[:, column]), last - end)
        keys = _pair(blocks[:, -1], blocks[:, 0])
        order = np.argsort(keys, kind="stable")
        self.keys, self.words = keys[order], self.words[order]
        self.texts, self.items = [self.texts[i] for i in order], [self.items[i] for i in order]

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks & np.uint64(len(self.shift) - 1)).astype(np.int64)

    def search(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of all places where the words of the texts equal a pattern.

        Every text is walked by cursors over runs of windows; all cursors jump together, each by its own shift.
        """
        n = self.length
        ends = counts[1:]
        starts = counts[:-1] + n - 1
        runs = np.maximum(0, -(-(ends - starts) // _RUN))
        text = np.repeat(np.arange(len(runs)), runs)
        number = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
        at = starts[text] + number * _RUN
        stop = np.minimum(ends[text], at + _RUN)
        found = []
        while len(at):
            block = hashes[at] if n == 1 else _pair(hashes[at - 1], hashes[at])
            jump = self.shift[self.slot(block)].astype(np.int64)
            stay = jump == 0
            if stay.any():
                found.append(at[stay])
            at = at + np.maximum(jump, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(found) - (n - 1)
        tail = hashes[at] if n == 1 else _pair(hashes[at + n - 2], hashes[at + n - 1])
        head = hashes[at] if n == 1 else _pair(hashes[at], hashes[at + 1])
        key = _pair(tail, head)
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        size = high - low
        at = np.repeat(at, size)
        pattern = np.repeat(low, size) + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        for i in range(n):
            same = hashes[at + i] == self.words[pattern, i]
            at, pattern = at[same], pattern[same]
        return at, pattern


def make_patterns(texts: list[str | None], window: int = WINDOW) -> list[Patterns]:
    """All windows of the item texts, by length; items are numbered by their place in ``texts``."""
    data, offsets = raw_texts(pa.array(texts, pa.string()))
    hashes, first, last, counts = words_of(data, offsets, ALPHANUMERIC)
    low = data.tobytes().lower()
    by_length: dict[int, dict[tuple, tuple[bytes, set[int]]]] = {}
    for item in range(len(texts)):
        a, b = counts[item], counts[item + 1]
        n = min(window, b - a)
        if not n:
            continue
        for i in range(a, b - n + 1):
            text = b" ".join(low[first[j] : last[j]] for j in range(i, i + n))
            by_length.setdefault(n, {}).setdefault(text, (hashes[i : i + n], set()))[1].add(item)
    return [
        Patterns(n, np.array([w for w, _ in strings.values()], np.uint64).reshape(-1, n), list(strings), [sorted(s) for _, s in strings.values()])
        for n, strings in sorted(by_length.items())
    ]


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, chars: int):
    """The benchmark in blocks of bounded size: lists of (id as text, text)."""
    items = benchmark.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).alias("text"))
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // chars))
    for b in range(blocks):
        yield items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()


def find_occurrences(documents: DataFrame, benchmark: DataFrame, *, text_column: str = "text", item_column: str = "item_id",
                     item_text_column: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``documents`` with ``n_words``, ``n_hit`` (words inside an occurrence of a test string) and ``items`` (their ids).

    Words are runs of ASCII letters and digits and of what lies beyond ASCII, without regard to A-Z or a-z. Test
    strings are the windows of ``window`` words of each item; an item of fewer words, but not none, is one string.

    The documents are read once, in place: no shuffle. The tables of a block of the benchmark go to the tasks; a benchmark
    over ``block_chars`` characters is searched in several blocks, one after another over the same rows.

    Null and empty texts have no words and no hits. Items without words match nothing; items with a null id count as
    occurring but carry no id. Repeated rows each get the same result; repeated items give one id.
    """
    fields = "n_words bigint, hit_words array<struct<a: int, b: int>>, items array<string>"
    out = documents
    for number, block in enumerate(_blocks(benchmark, item_column, item_text_column, block_chars)):
        shared = [r[0] for r in block], make_patterns([r[1] for r in block], window)
        own = fields if not number else "n_words bigint, hit_more array<struct<a: int, b: int>>, items_more array<string>"
        out = annotate(out, text_column, lambda column, shared=shared: _search(column, shared), own)
        if number:
            out = out.withColumns({
                "hit_words": F.concat("hit_words", "hit_more"), "items": F.array_union("items", "items_more"),
            }).drop("hit_more", "items_more")
    ranges = F.array_sort("hit_words")
    covered = F.aggregate(
        ranges, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["to"]))).alias("n"),
            F.greatest(s["to"], r["b"]).alias("to")))["n"]
    return out.withColumns({"n_hit": covered.cast("long"), "items": F.array_sort("items")}).drop("hit_words")


def _search(column: pa.Array, tables: tuple[list[str | None], list[Patterns]]) -> list:
    ids, patterns = tables
    data, offsets = raw_texts(column)
    n_words = np.zeros(len(column), np.int64)
    ranges: list[list[dict]] = [[] for _ in range(len(column))]
    items: list[list[str]] = [[] for _ in range(len(column))]
    for begin, end in slices(offsets):
        part = data[offsets[begin] : offsets[end]]
        hashes, first, last, counts = words_of(part, offsets[begin : end + 1] - offsets[begin], ALPHANUMERIC)
        n_words[begin:end] = np.diff(counts)
        hits: dict[int, tuple[list, set]] = {}
        for p in patterns:
            at, pattern = p.search(hashes, counts)
            rows = np.searchsorted(counts, at, "right") - 1
            for i, which, row in zip(at.tolist(), pattern.tolist(), rows.tolist()):
                words = [part[first[j] : last[j]].tobytes().lower() for j in range(i, i + p.length)]
                if b" ".join(words) == p.texts[which]:
                    spans, held = hits.setdefault(row, ([], set()))
                    spans.append((i - int(counts[row]), i - int(counts[row]) + p.length))
                    held.update(p.items[which])
        for row, (spans, held) in hits.items():
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            ranges[begin + row] = [{"a": a, "b": b} for a, b in merged]
            items[begin + row] = sorted({ids[i] for i in held if ids[i] is not None})
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    return [pa.array(n_words), pa.array(ranges, kind), pa.array(items, pa.list_(pa.string()))]


def contaminated():
    """The rule for a contaminated document: one word of twenty, or more, inside occurrences."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
