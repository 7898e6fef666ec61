"""Token ids in a binary store: bit-plane or byte-plane shuffled blocks, zstandard per plane, and a chunk index.

A store is a folder with two Parquet tables, which any file system that Spark reads can hold:

* ``chunks``: a row per chunk, a run of whole documents in order. ``planes`` holds for each block of ``block_ids`` ids
  (the last block of a chunk may be shorter) the compressed planes, lowest first. ``documents`` holds id and number of ids.
* ``index``: a row per chunk, without the planes: its part and place, first id in the store, number of ids and bytes.

Each task writes whole chunks by Spark's commit protocol, so a lost executor's part is written anew. Parts are ranges of
document ids, so no task holds more than a share of the store, and reading needs no shuffle.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import SPACED, drop_at_exit, give_back, mix64, raw_texts, scratch, slices, words_of, written

BLOCK_IDS = 65536
CHUNK_IDS = 1 << 20
END_ID = 2
#: Distinct words that a process remembers as its latest; as many before them stay until they are older.
_WORDS = 200_000
#: Bytes of text that one part of the store stands for.
PART_BYTES = 32_000_000


def split_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of a block of ids, lowest first."""
    columns = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [columns[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(columns, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def join_planes(parts: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its planes: four are byte planes, 32 are bit planes."""
    if len(parts) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1).reshape(-1).view("<u4") if n else np.zeros(0, np.uint32)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4") if n else np.zeros(0, np.uint32)


def pack(ids: np.ndarray, block_ids: int, planes: str, level: int) -> list[list[bytes]]:
    press = zstandard.ZstdCompressor(level=level)
    return [[press.compress(p) for p in split_planes(ids[i : i + block_ids], planes)] for i in range(0, len(ids), block_ids)]


def unpack(blocks: list[list[bytes]], n: int, block_ids: int) -> np.ndarray:
    open_ = zstandard.ZstdDecompressor()
    parts = [join_planes([open_.decompress(p) for p in b], min(block_ids, n - i * block_ids)) for i, b in enumerate(blocks)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


_LOADED: dict = {}
#: Words, after A-Z are lower-cased, that no normalising step changes and that are one piece, and marks behind them (all of
#: ASCII but the apostrophe, which may begin an ending such as 's), a piece of their own.
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
#: The commonest marks, by number.
_STOPS = {".": 1, ",": 2}
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _tokenizer(path: str) -> list:
    """The tokenizer of a file; one that only spells and merges words; the words that this process encoded lately, and
    those before: by word the ids as bytes; the ids of each stop by its number, none for 0."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            bare = json.load(file)
        spell = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        bare |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spell]}}
        whole = Tokenizer.from_file(path)
        stops = [np.array(whole.encode(stop, add_special_tokens=False).ids, "<u4") for stop in ["", *_STOPS]]
        _LOADED[path] = [whole, Tokenizer.from_str(json.dumps(bare)), {}, {}, stops]
    return _LOADED[path]


def _merged(bare, words: list[str]) -> Iterator[bytes]:
    """The ids of plain words: many in one text, with zeros between them, whose id tells where a word ends."""
    mark = bare.encode("0", add_special_tokens=False).ids
    for i in range(0, len(words), 1 << 14):
        rows = [words[j : j + 512] for j in range(i, min(i + (1 << 14), len(words)), 512)]
        for row, found in zip(rows, bare.encode_batch_fast([" 0 ".join(row) for row in rows], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            cuts = (4 * np.flatnonzero(ids == mark[0])).tolist()
            data = ids.tobytes()
            yield from (data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True))


def _learn(loaded: list, plain: list[bytes], others: list[bytes]) -> None:
    """Remember the ids of new words: plain ones by their merges, all others by every step of the tokenizer.

    ``plain`` are words of the letters a to z; a word of ``others`` is looked at for letters beyond ASCII.
    """
    tokenizer, bare, known = loaded[:3]
    cores, ends, rest = dict(zip(plain, (w.decode() for w in plain))), [], []
    for word in others:
        if found := _PLAIN.fullmatch(word.lower().decode()):
            core, marks = found.groups()
            name = word[: len(word) - len(marks)]
            if name not in known:
                cores[name] = core
            if marks:
                ends.append((word, name, marks))
        else:
            rest.append(word)
    known.update(zip(cores, _merged(bare, list(cores.values()))))
    runs = list({marks for _, _, marks in ends})
    behind = {marks: np.array(e.ids, "<u4").tobytes() for marks, e in zip(runs, tokenizer.encode_batch_fast(runs, add_special_tokens=False))}
    known.update((word, known[name] + behind[marks]) for word, name, marks in ends)
    for i in range(0, len(rest), 4096):
        texts = [w.decode() for w in rest[i : i + 4096]]
        known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest[i:], tokenizer.encode_batch_fast(texts, add_special_tokens=False)))


def _stops(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the stops that end a word of ASCII letters, and the number of each stop."""
    place = np.flatnonzero((data == 46) | (data == 44))
    text = np.searchsorted(offsets, place, "right") - 1
    follows = data[np.minimum(place + 1, len(data) - 1)]
    place, text = (x[(place + 1 == offsets[text + 1]) | ~SPACED[follows]] for x in (place, text))
    border = np.flatnonzero(~_LETTER[data])
    before = np.searchsorted(border, place) - 1  # the last byte before the stop that is no letter
    before = np.where(before >= 0, border[before], -1)
    begin = offsets[text]
    good = np.where(before < begin, place > begin, ~SPACED[data[before]] & (before < place - 1))
    place = place[good]
    return place, np.where(data[place] == 46, 1, 2)


def encode_words(data: np.ndarray, offsets: np.ndarray, path: str) -> list[np.ndarray]:
    """The ids of each text, for tokenizers that lower-case and treat ASCII white space as a border only.

    Words are told apart by 64-bit hashes; each word of a batch is looked up once, and encoded once while it is remembered.
    A stop behind ASCII letters is set apart first, so that a word is the same before it as elsewhere.
    Only words of ASCII are lower-cased before: NFC joins some marks with small letters alone (h, j, t, w and y have such),
    so a word with a byte beyond ASCII stays as it is.
    Texts that may hold the name of a special token, which is no matter of words, are encoded as they are.
    """
    loaded = _tokenizer(path)
    place, kind = _stops(data, offsets)
    bare = data.copy()
    bare[place] = 32
    hashes, first, last, counts = words_of(bare, offsets, SPACED)
    stop = np.zeros(len(hashes), np.int64)
    stop[np.searchsorted(first, place) - 1] = kind
    wide = np.logical_or.reduceat(bare > 0x7F, first) if len(first) else np.zeros(0, bool)
    mixed = np.logical_or.reduceat(SPACED[bare] & ~_LETTER[bare], first) if len(first) else wide
    capitals = np.flatnonzero((bare >= 65) & (bare <= 90))
    owner = np.searchsorted(first, capitals, "right") - 1
    capitals, owner = capitals[wide[owner]], owner[wide[owner]]
    cased = np.zeros(len(hashes), np.uint64)
    np.add.at(cased, owner, mix64((capitals - first[owner] + 1).astype(np.uint64)))
    hashes = np.where(cased != 0, mix64(hashes ^ cased), hashes)
    _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    raw = data.tobytes()
    low = raw.lower()
    words = [raw[a:b] if w else low[a:b] for a, b, w in zip(first[index].tolist(), last[index].tolist(), wide[index].tolist())]
    other = mixed[index].tolist()
    known, before = loaded[2], loaded[3]
    unknown = [i for i, w in enumerate(words) if w not in known]
    if len(known) + len(unknown) > _WORDS:
        before = loaded[3] = known
        known = loaded[2] = {}
        unknown = range(len(words))
    new = []
    for i in unknown:
        if (ids := before.get(words[i])) is None:
            new.append(i)
        else:
            known[words[i]] = ids
    _learn(loaded, [words[i] for i in new if not other[i]], [words[i] for i in new if other[i]])
    found = list(map(known.__getitem__, words))
    ids = np.frombuffer(b"".join(found), "<u4")
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    begin = np.cumsum(size) - size
    ends = loaded[4]
    extra = np.array([len(x) for x in ends])[stop]
    own = size[inverse]
    each = own + extra
    total = np.concatenate(([0], np.cumsum(each)))
    flat = np.empty(total[-1], "<u4")
    start = total[:-1]
    at = np.repeat(start, own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    flat[at] = ids[np.repeat(begin[inverse] - (np.cumsum(own) - own), own) + np.arange(len(at))]
    for number in range(1, len(ends)):
        behind = (start + own)[stop == number]
        for i, value in enumerate(ends[number]):
            flat[behind + i] = value
    cuts = total[counts]
    out = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    if b"<|" in raw:
        for i in range(len(out)):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            if b"<|" in text:
                out[i] = np.array(loaded[0].encode(text.decode(), add_special_tokens=False).ids, "<u4")
    return out


def _spaces_are_borders(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        kind = json.load(file)
    steps = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or [kind.get("pre_tokenizer") or {}]
    lower = any(n.get("type") == "Lowercase" for n in (kind.get("normalizer") or {}).get("normalizers", []))
    return lower and [s.get("type") for s in steps] == ["Split", "ByteLevel"] and any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and "[^\\s" in s["pattern"].get("Regex", "") for s in steps)


def _encoded(documents: DataFrame, id_column: str, text_column: str, tokenizer_path: str, end_id: int, bounds: list[int]) -> DataFrame:
    """(id, mark of the text, part, ids in compressed byte planes, number of ids) of each row."""
    by_word = _spaces_are_borders(tokenizer_path)
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, press = np.uint32(end_id), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = raw_texts(batch.column(1))
            numbers, marks = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            ids = numbers.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(edges, ids, "left"), np.searchsorted(edges, ids, "right")
            share = (marks.astype(np.float64) / 2.0**64 + 0.5) * (high - low + 1)
            part = low + np.minimum(share.astype(np.int64), high - low)
            for first, last in slices(offsets, 2 << 20):
                if by_word:
                    found = encode_words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], tokenizer_path)
                else:
                    texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(first, last)]
                    found = [np.array(e.ids, "<u4") for e in _tokenizer(tokenizer_path)[0].encode_batch(texts, add_special_tokens=False)]
                rows = [np.append(x, end).astype("<u4") for x in found]
                yield pa.RecordBatch.from_arrays([
                    numbers[first:last], batch.column(2)[first:last], pa.array(part[first:last].astype(np.int32)),
                    pa.array([press.compress(b"".join(split_planes(x, "byte"))) for x in rows], pa.binary()),
                    pa.array([len(x) for x in rows], pa.int64()),
                ], names=["id", "mark", "part", "ids", "n"])
        if by_word:
            _tokenizer(tokenizer_path)[3] = {}  # the older words; the latest stay for the next task
        give_back()

    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    return rows.mapInArrow(run, "id bigint, mark bigint, part int, ids binary, n bigint")


def write_store(documents: DataFrame, path: str, *, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
                end_id: int = END_ID, block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS, planes: str = "byte",
                level: int = 3, part_bytes: int = PART_BYTES) -> None:
    """Encode all whole texts and write them to ``path`` in ascending order of ids; ``end_id`` closes each document.

    The ids of one id column value (rows of one id, ordered by a hash of the text, may be many) are dealt over as many
    parts as they fill. Texts are encoded once, before the shuffle, which moves compressed ids.

    Null and empty texts give the end id alone. Null ids come first. Repeated rows are written as often as they occur.
    """
    size = documents.select(F.sum(F.octet_length(text_column))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    cuts = [i / parts for i in range(1, parts)]
    bounds = []
    if cuts:
        bounds = documents.select(F.percentile_approx(F.col(id_column).cast("long"), cuts, max(10_000, 20 * parts)).alias("p")).first()[0] or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, waiting, part, number = zstandard.ZstdDecompressor(), [], None, 0

        def chunk() -> pa.RecordBatch:
            nonlocal waiting, number
            ids = np.concatenate([x for _, _, x in waiting])
            row = {
                "part": part, "chunk": number, "n_ids": len(ids), "block_ids": block_ids, "planes": pack(ids, block_ids, planes, level),
                "documents": [{"id": i, "mark": m, "n": len(x)} for i, m, x in waiting],
            }
            waiting, number = [], number + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([
            ("part", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int64()), ("block_ids", pa.int32()), ("planes", pa.list_(pa.list_(pa.binary()))),
            ("documents", pa.list_(pa.struct([("id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64())]))),
        ])
        held = 0
        for batch in batches:
            for i, mark, p, ids, n in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting and (p != part or held >= chunk_ids):
                    yield chunk()
                    held = 0
                if p != part:
                    part, number = p, 0
                waiting.append((i, mark, join_planes(_cut(open_.decompress(ids), n), n)))
                held += n
        if waiting:
            yield chunk()

    encoded = _encoded(documents, id_column, text_column, tokenizer_path, end_id, bounds)
    ordered = encoded.repartitionById(parts, "part").sortWithinPartitions("part", F.col("id").asc_nulls_first(), "mark")
    kind = ("part int, chunk int, n_ids bigint, block_ids int, planes array<array<binary>>, documents array<struct<id: bigint, mark: bigint, n: bigint>>")
    ordered.mapInArrow(run, kind).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    spark = documents.sparkSession
    sizes = F.aggregate(F.flatten("planes"), F.lit(0).cast("long"), lambda s, p: s + F.octet_length(p))
    listed = spark.read.parquet(f"{path}/chunks").select("part", "chunk", "n_ids", sizes.alias("n_bytes"))
    listed = written(listed, "index")
    totals = listed.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row per part
    begin = np.concatenate(([0], np.cumsum([r["n"] for r in totals], dtype=np.int64)))
    starts = spark.createDataFrame([(r["part"], int(b)) for r, b in zip(totals, begin)], "part int, part_start bigint")
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    index = listed.join(starts, "part").select("part", "chunk", (F.col("part_start") + F.coalesce(before, F.lit(0))).alias("start"), "n_ids", "n_bytes")
    index.write.parquet(f"{path}/index")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Each document of a store in its place: ``id``, ``start`` (ids before it), ``n_tokens`` and ``ids`` (little-endian, 32 bits)."""
    chunks = spark.read.parquet(f"{path}/chunks")
    index = spark.read.parquet(f"{path}/index").select("part", "chunk", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}
                ids = unpack(x["planes"], x["n_ids"], x["block_ids"])
                n = np.array([d["n"] for d in x["documents"]], np.int64)
                begin = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([
                    pa.array([d["id"] for d in x["documents"]], pa.int64()), pa.array(begin + x["start"]), pa.array(n),
                    pa.array([ids[b : b + k].tobytes() for b, k in zip(begin, n)], pa.binary()),
                ], names=["id", "start", "n_tokens", "ids"])

    # Small indexes are sent to the chunks; larger ones are joined as Spark sees fit.
    joined = chunks.join(F.broadcast(index) if _small(index) else index, ["part", "chunk"])
    return joined.select("planes", "n_ids", "block_ids", "documents", "start").mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids binary")


def _small(index: DataFrame, rows: int = 100_000) -> bool:
    return index.limit(rows + 1).count() <= rows


def _cut(data: bytes, n: int) -> list[bytes]:
    return [data[i * n : (i + 1) * n] for i in range(4)]


def tokens_of(documents: DataFrame, *, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write ``documents`` to a store (a new folder in the shared one, if no path is given) and list what it holds.

    Rows: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, read back from the store.
    """
    own = path is None
    path = path or scratch(documents.sparkSession, "tokens")
    write_store(documents, path, tokenizer_path=tokenizer_path, **options)
    if own:
        drop_at_exit(documents.sparkSession, path)
    back = read_store(documents.sparkSession, path)

    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
