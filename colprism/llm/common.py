"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.results import scratch_folder

#: Bytes of text that the numpy helpers work on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one that the cluster names in ``spark.checkpoint.dir``."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system that holds a folder remove it when the application ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a table in the shared folder: computed once, its lineage cut, kept when executors are lost."""
    spark, path = frame.sparkSession, scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    drop_at_exit(spark, path)
    back = spark.read.schema(frame.schema).parquet(path)
    back._written = path
    return back


def drop(*frames: DataFrame) -> None:
    """Delete tables of ``written`` whose readers have all been written themselves; other frames are left alone.

    The shuffle files of finished jobs go with the plans that hold them, once the driver's JVM looks for garbage: it is asked to.
    """
    for frame in frames:
        path = getattr(frame, "_written", None)
        if path is not None:
            where = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
            frame._written = None
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def fold(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3


def give_back() -> None:
    """Return the memory that a finished task has freed: workers live on, and the next stage's tasks run in them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(frame: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)
        give_back()

    return frame.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column and the offsets of each; null is the empty text."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Random 64-bit value of a byte after A-Z are lower-cased, and the base of the powers.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]
_BASE = np.uint64(0xD1342543DE82EF95)


def separators(*spans: tuple[int, int]) -> np.ndarray:
    """Table by byte: True where a byte belongs to a word, False in the given spans."""
    word = np.ones(256, bool)
    for low, high in spans:
        word[low : high + 1] = False
    return word


#: Words as runs of bytes that are no ASCII white space.
SPACED = separators((0x20, 0x20), (0x09, 0x0D))
#: Words as runs of ASCII letters and digits and of all that lies beyond ASCII.
ALPHANUMERIC = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def words_of(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts: (hash without regard to A-Z or a-z, first byte, byte after the last, number of words up to each text).

    The hash is a 64-bit polynomial over random values of the bytes. A word never crosses the border of two texts.
    """
    n = len(data)
    inside = word[data]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    borders = offsets[:-1]
    before[borders[borders < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = offsets[1:] - 1
    after[ends[ends >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    counts = np.searchsorted(start, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), start, end, counts
    length = end - start
    place = np.flatnonzero(inside)
    first = np.cumsum(length) - length
    powers = np.ones(int(length.max()), np.uint64)
    powers[1:] = _BASE
    np.multiply.accumulate(powers, out=powers)
    value = _BYTE[data[place]]
    value *= powers[np.arange(len(place)) - np.repeat(first, length)]
    return mix64(np.add.reduceat(value, first) + length.astype(np.uint64)), start, end, counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each text and the row of each; a text of fewer words, but not none, has one run."""
    rows = len(counts) - 1
    n = np.diff(counts)
    made = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    row = np.repeat(np.arange(rows), made)
    begin = np.repeat(counts[:-1] - (np.cumsum(made) - made), made) + np.arange(len(row))
    out = np.zeros(len(row), np.uint64)
    limit = counts[1:][row]
    for i in range(k):
        at = begin + i
        there = at < limit
        step = np.zeros(len(row), np.uint64)
        step[there] = hashes[at[there]]
        out = mix64(out * np.uint64(3) + step + np.uint64(i + 1) * there.astype(np.uint64))
    return out, row


def annotate(frame: DataFrame, text_column: str, function: Callable[[pa.Array], list], fields: str) -> DataFrame:
    """``frame`` with further columns that ``function`` makes of a column of texts, batch by batch.

    ``fields`` is a DDL string; a column of ``frame`` with the same name is replaced.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(fields)
    frame = frame.drop(*[c for c in frame.columns if c in new.names and c != text_column])
    at = frame.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = function(batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *new.names])
        give_back()

    return frame.mapInArrow(run, StructType([*frame.schema.fields, *new.fields]))
