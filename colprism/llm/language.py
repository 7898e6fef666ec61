"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import annotate, give_back, mix64, raw_texts, slices

DIMENSION = 1024
UNDETERMINED = "und"
_SPACE = 32
#: Texts whose counts stand in one dense matrix at a time, and most n-grams (columns) of one.
_ROWS, _COLUMNS = 512, 8192
#: Bytes of text whose trigrams are listed at a time: a trigram takes some forty times the byte's room.
_SLICE = 1 << 20


_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or a space for all that is no letter."""
    if _TABLE:
        return _TABLE[0]
    out = np.full(0x110000, _SPACE, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            out[code] = ord(c.lower()[0])
    _TABLE.append(out)
    return out


def ngram_vectors(grams: np.ndarray, dimension: int = DIMENSION) -> np.ndarray:
    """Vectors of +1 and -1 for letter trigrams, each packed as three code points of 21 bits.

    A letter's vector is random, seeded by the letter alone. The trigram binds (multiplies) the vector of its first
    letter permuted (rotated) twice, of its second permuted once, and of its third.
    """
    bound = np.zeros((len(grams), dimension), np.uint8)
    for turns, shift in ((2, 42), (1, 21), (0, 0)):
        letters, where = np.unique((grams >> np.uint64(shift)) & np.uint64(0x1FFFFF), return_inverse=True)
        lanes = np.arange(-(-dimension // 64), dtype=np.uint64)
        random = mix64((letters[:, None] << np.uint64(16)) + lanes[None, :] + np.uint64(0x5DEECE66D << 24))
        bits = np.unpackbits(random.view(np.uint8).reshape(len(letters), -1), axis=1)[:, :dimension]
        bound ^= np.roll(bits, turns, axis=1)[where]
    return 1 - 2 * bound.astype(np.float32)


def _trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of rows: first and last row, (row, trigram) of all trigrams around a letter, letters per row."""
    data, offsets = raw_texts(column)
    table = _letters()
    for first, last in slices(offsets, _SLICE):
        part = data[offsets[first] : offsets[last]]
        borders = offsets[first : last + 1] - offsets[first]
        codes = table[np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        lead = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        ends = lead[borders]
        rows = np.repeat(np.arange(last - first), np.diff(ends))
        codes = np.insert(codes, ends, _SPACE)
        rows = np.insert(rows, ends, 0)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
        codes, rows = codes[keep].astype(np.uint64), rows[keep]
        middle = np.flatnonzero(codes[1:-1] != _SPACE) + 1
        grams = (codes[middle - 1] << np.uint64(42)) | (codes[middle] << np.uint64(21)) | codes[middle + 1]
        yield first, last, rows[middle], grams, np.bincount(rows[middle], minlength=last - first)


def _numbered(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams and the number of each; by counting where the alphabet is small."""
    parts = [(grams >> np.uint64(s)) & np.uint64(0x1FFFFF) for s in (42, 21, 0)]
    seen = np.zeros(0x200000, bool)
    for p in parts:
        seen[p] = True
    alphabet = np.flatnonzero(seen)
    size = len(alphabet)
    if size > 160:
        return np.unique(grams, return_inverse=True)
    number = np.zeros(0x200000, np.int64)
    number[alphabet] = np.arange(size)
    dense = (number[parts[0]] * size + number[parts[1]]) * size + number[parts[2]]
    used = np.zeros(size**3, bool)
    used[dense] = True
    distinct = np.flatnonzero(used)
    place = np.zeros(size**3, np.int64)
    place[distinct] = np.arange(len(distinct))
    a = alphabet.astype(np.uint64)
    return (a[distinct // (size * size)] << np.uint64(42)) | (a[distinct // size % size] << np.uint64(21)) | a[distinct % size], place[dense]


def _bundles(rows: np.ndarray, grams: np.ndarray, count: int, dimension: int) -> np.ndarray:
    """For each of ``count`` rows the sum of the vectors of its trigrams."""
    out = np.zeros((count, dimension), np.float32)
    for low in range(0, count, _ROWS):
        a, b = np.searchsorted(rows, [low, low + _ROWS])
        if a == b:
            continue
        distinct, number = _numbered(grams[a:b])
        height = min(_ROWS, count - low)
        for left in range(0, len(distinct), _COLUMNS):
            width = min(_COLUMNS, len(distinct) - left)
            inside = slice(None) if width == len(distinct) else (number >= left) & (number < left + width)
            cells = (rows[a:b][inside] - low) * width + number[inside] - left
            counts = np.bincount(cells, minlength=height * width).reshape(height, width).astype(np.float32)
            out[low : low + height] += counts @ ngram_vectors(distinct[left : left + width], dimension)
    return out


def train_prototypes(documents: DataFrame, *, text_column: str = "text", lang_column: str = "lang",
                     dimension: int = DIMENSION, max_languages: int = 4096) -> dict[str, np.ndarray]:
    """The bundle of all texts of each language: integer sums, so every run and every partitioning gives the same.

    Rows without text or without language teach nothing. Sums are made per task, then per (language, place) by Spark;
    only languages x dimension numbers reach the driver. More than ``max_languages`` languages raise an error.
    """
    known = documents.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    known = known.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "bundle"])

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, last, rows, grams, _ in _trigrams(batch.column(1)):
                for lang in sorted(set(langs[first:last])):
                    mine = (langs[first:last] == lang)[rows]
                    distinct, number = _numbered(grams[mine]) if mine.any() else (grams[:0], rows[:0])
                    sums.setdefault(lang, np.zeros(dimension, np.int64))
                    for left in range(0, len(distinct), _COLUMNS):
                        counts = np.bincount(number, minlength=len(distinct))[left : left + _COLUMNS].astype(np.float64)
                        sums[lang] += np.rint(counts @ ngram_vectors(distinct[left : left + _COLUMNS], dimension).astype(np.float64)).astype(np.int64)
            if len(sums) > 512:
                yield out()
                sums = {}
        if sums:
            yield out()
        give_back()

    places = known.mapInArrow(run, "lang string, bundle array<bigint>").select("lang", F.posexplode("bundle").alias("place", "value"))
    rows = places.groupBy("lang", "place").agg(F.sum("value").alias("value")).limit(max_languages * dimension + 1).collect()
    if len(rows) > max_languages * dimension:
        raise ValueError(f"over {max_languages} languages")
    out: dict[str, np.ndarray] = {}
    for lang, place, value in rows:
        out.setdefault(lang, np.zeros(dimension))[place] = value
    return out


def identify(documents: DataFrame, prototypes: dict[str, np.ndarray], *, text_column: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score``, the cosine with the nearest prototype, from 0 to 1.

    Texts that are null or hold no letter are ``und`` with score 0; so is every text if no language was learned.
    Equal cosines go to the language that sorts first. Texts are read whole, whatever their length.
    """
    names = sorted(prototypes)
    dimension = len(prototypes[names[0]]) if names else DIMENSION
    matrix = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-9) for n in names], np.float32).reshape(-1, dimension)

    def run(column: pa.Array) -> list:
        best, score = np.full(len(column), -1), np.zeros(len(column))
        for first, last, rows, grams, letters in _trigrams(column):
            if not names:
                continue
            bundle = _bundles(rows, grams, last - first, dimension)
            cosines = (bundle @ matrix.T) / np.maximum(np.linalg.norm(bundle, axis=1), 1e-9)[:, None]
            pick = np.argmax(cosines, axis=1)
            found = letters > 0
            best[first:last][found] = pick[found]
            score[first:last][found] = np.clip(cosines[np.arange(last - first), pick], 0, 1)[found]
        return [pa.array([names[b] if b >= 0 else UNDETERMINED for b in best], pa.string()), pa.array(score)]

    return annotate(documents, text_column, run, "lang_pred string, score double")
