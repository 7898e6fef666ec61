"""The ten operators against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colprism.llm import components, decontaminate, jaccard_join, language, line_dedup, mixing, neighbours, pii, suffix_dedup, token_store, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, score string, size string, base string, items string"


@pytest.fixture(scope="module")
def rows():
    """Small documents with all that is odd: (id, text, lang, source)."""
    random_ = random.Random(7)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "Ön", "shu") for b in ("n", "ra", "x", "ti", "ße")]
    line = " ".join(random_.choices(words, k=12))
    passage = " ".join(random_.choices(words, k=120))
    out = []
    for i in range(60):
        text = "\n".join(" ".join(random_.choices(words, k=random_.randint(1, 40))) for _ in range(random_.randint(1, 6)))
        if i % 4 == 0:
            text += "\n  " + (line.upper() if i % 8 == 0 and line.isascii() else line) + "\t"
        if i % 5 == 0:
            text = text[: len(text) // 2] + " " + passage + " " + text[len(text) // 2 :]
        out.append((i, text, ("en", "de", None)[i % 3], ("a", "b", None, "Z")[i % 4]))
    base = out[5][1].split()
    for i in range(60, 72):  # near copies
        near = list(base)
        near[(i * 3) % len(near)] = f"new{i}"
        out.append((i, " ".join(near), "en", "a"))
    out += [(72, out[0][1], "en", "a"), (73, out[0][1], "en", "b"), (74, None, "en", None), (75, "", "de", "a"), (76, " \n\t ", None, "b"), (77, "12 34 !!", "en", "a")]
    out += [(78, "x" * 5000 + " tail", "en", "b"), (79, ("ab " * 30000).strip(), "de", "a"), (80, "word", "en", None), (81, "Zwei Wörter", "de", "Z")]
    out += [out[3], (None, "a row without id and " + line, None, "b"), (None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "n", "s", "z", "b", "i") for r in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(frame):
    out = collections.defaultdict(list)
    for r in frame.collect():
        out[r["doc_id"]].append(r)
    return out


def test_line_dedup(docs, rows, none):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = collections.defaultdict(set)
    for i, text, *_ in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 20 and i is not None:
                holders[key(x)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    assert gone
    got = by_id(line_dedup.drop_repeated_lines(docs))
    assert sum(map(len, got.values())) == len(rows)
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if key(x) not in gone or (i is not None and i >= gone[key(x)])]
        assert any(r["text"] == "\n".join(keep) and r["n_lines"] == len(lines) and r["n_dropped"] == len(lines) - len(keep) for r in got[i]), i
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_language(docs, rows, none, spark):
    taught = language.train_prototypes(docs)
    assert set(taught) == {"en", "de"}
    got = by_id(language.identify(docs, taught))
    for i, text, *_ in rows:
        for r in got[i]:
            assert 0 <= r["score"] <= 1
        if text is None or not any(c.isalpha() for c in text):
            assert any(r["lang_pred"] == "und" and r["score"] == 0 for r in got[i]), i
    assert {r["lang_pred"] for r in got[80]} <= {"en", "de"}
    again = language.train_prototypes(docs.repartition(2))
    assert all((again[k] == taught[k]).all() for k in taught)
    assert language.train_prototypes(none) == {} and language.identify(none, taught).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, {}).collect()} == {"und"}
    # The bundle of a text is the sum of its trigrams' vectors, each a product of rotated letter vectors.
    v = language.ngram_vectors(np.array([(97 << 42) | (98 << 21) | 99, (98 << 42) | (98 << 21) | 98], np.uint64), 256)
    assert set(np.unique(v)) == {-1.0, 1.0} and abs(v[0] @ v[1]) < 100


def test_language_accuracy(spark, tiny):
    documents = spark.read.parquet(f"{tiny}/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    taught = language.train_prototypes(documents.where("not held"))
    found = language.identify(documents.where("held"), taught)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_decontamination(docs, rows, none, spark):
    passage = rows[5][1].split("\n")[0]
    tests = [(1, " ".join(split(rows[10][1])[20:45])), (2, "ZWEI Wörter"), (3, "word"), (4, None), (5, ""), (6, " ".join(split(rows[10][1])[22:40])), (11, passage), (None, "word"), (3, "word"), (12, "not there at all in any of these documents whatever one may look for")]
    benchmark = spark.createDataFrame(tests, "item_id bigint, text string")
    want = {}
    for i, text, *_ in rows:
        words, hit, items = split(text), set(), set()
        for item, t in tests:
            w = split(t)
            n = min(13, len(w))
            windows = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
            for j in range(len(words) - n + 1 if n else 0):
                if tuple(words[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    items.add(str(item))
        want[i, text] = (len(words), len(hit), sorted(items - {"None"}))
    for chars in (16_000_000, 60):
        found = decontaminate.find_occurrences(docs, benchmark, block_chars=chars).collect()
        assert len(found) == len(rows)
        for r in found:
            assert (r["n_words"], r["n_hit"], r["items"]) == want[r["doc_id"], r["text"]], (chars, r["doc_id"])
    assert decontaminate.find_occurrences(none, benchmark).count() == 0
    assert {r["n_hit"] for r in decontaminate.find_occurrences(docs, benchmark.limit(0)).collect()} == {0}


def test_wu_manber_skips():
    patterns = decontaminate.make_patterns(["a b c d e f g h i j k l m n"])
    assert [p.length for p in patterns] == [13] and len(patterns[0].words) == 2
    assert patterns[0].shift.max() == 12 and patterns[0].shift.min() == 0


def test_token_store(docs, rows, none, spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    for name, planes in (("word_bpe_49k.json", "byte"), ("byte_bpe_50k.json", "bit")):
        path = public.path(name)
        tokenizer = Tokenizer.from_file(path)
        out = str(tmp_path / planes)
        token_store.write_store(docs, out, tokenizer_path=path, planes=planes, block_ids=300, chunk_ids=1000, part_bytes=4000)
        got = sorted(token_store.read_store(spark, out).collect(), key=lambda r: r["start"])
        ordered = [r["id"] for r in got]
        assert ordered == sorted(ordered, key=lambda i: (i is not None, i or 0)) and len(got) == len(rows)
        start, texts = 0, collections.defaultdict(list)
        for i, text, *_ in rows:
            texts[i].append((*tokenizer.encode(text or "", add_special_tokens=False).ids, 2))
        for r in got:
            ids = tuple(np.frombuffer(r["ids"], "<u4").tolist())
            assert r["start"] == start and r["n_tokens"] == len(ids)
            texts[r["id"]].remove(ids)
            start += len(ids)
        assert spark.read.parquet(f"{out}/index").agg(F.sum("n_ids")).first()[0] == start
    path = public.path("word_bpe_49k.json")
    crcs = sorted(r["ids_crc32"] for r in token_store.tokens_of(docs, tokenizer_path=path).collect())
    tokenizer = Tokenizer.from_file(path)
    assert crcs == sorted(zlib.crc32(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in rows)
    assert token_store.tokens_of(none, tokenizer_path=path).count() == 0


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n).astype(np.uint32)
    assert (token_store.join_planes(token_store.split_planes(ids, planes), n) == ids).all()
    assert (token_store.unpack(token_store.pack(ids, 64, planes, 3), n, 64) == ids).all()


def test_words_as_whole_texts():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tokenizer, random_ = Tokenizer.from_file(path), random.Random(3)
    pieces = [*"aA.,!0 1\n\té€İǅKKΣß\x1c\x85中\U0001F600_-#٠'", "é", "<|endoftext|>", "<|EndOfText|>", "don't", "I'LL", "10.5", "...", "a.", "b,", "é."]
    texts = ["".join(random_.choices(pieces, k=random_.randint(0, 30))) for _ in range(2000)]
    raw = [t.encode() for t in texts]
    found = token_store.encode_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), path)
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_marks_that_join_small_letters_only():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    words = [x + mark + "adith" for x, mark in zip("HJTWY", "\u0331\u030c\u0308\u030a\u030a")]
    texts = [t for w in words for t in (w, w.lower(), w.upper(), f"{w.lower()} {w}", f"{w}. {w.lower()},")]
    texts += ["Größe größe GRÖSSE GRÖße", "ẞ ß Übung. übung, É e\u0301 E\u0301", "", "A\u030a a\u030a"]
    for some in (texts, texts[::-1], *([t] for t in texts)):
        raw = [t.encode() for t in some]
        found = token_store.encode_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), path)
        for text, ids in zip(some, found, strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_marks_behind_words():
    """Words with marks behind, between and before them, letters beyond ASCII and odd spaces: the ids of the whole text."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    parts = [
        "a", "B", "z", "\u00e9", "\u00c9", "\u00df", "\u0178", "\u0331", "H", "\u01f0", "1", "23", ".", ",", "..", ".,", "'", "'s", "'S", "&&&", "-", "--", "$",
        "<", "|", ">", "</s>", "<|x|>", " ", "  ", "\n", "\t", "\u65e5\u672c", "\x1c", "\x85", "\u212a", "\u0130", "_", "^", "`", "~", "[", "]", " a.", " the,", "A.", "Hello,",
    ]
    random = np.random.default_rng(5)
    texts = ["".join(parts[i] for i in random.integers(0, len(parts), n)) for n in random.integers(0, 25, 4000)]
    raw = [t.encode() for t in texts]
    for some in (slice(0, 1), slice(0, 0), slice(None)):
        found = token_store.encode_words(np.frombuffer(b"".join(raw[some]), np.uint8), np.cumsum([0, *map(len, raw[some])]), path)
        want = tokenizer.encode_batch(texts[some], add_special_tokens=False)
        assert [x.tolist() for x in found] == [e.ids for e in want]


def test_mixing(docs, rows, none):
    size = lambda t: len((t or "").encode().split())
    got = mixing.mix(docs).collect()
    assert sorted((r["size"] for r in got)) == sorted(size(r[1]) for r in rows)
    whole = collections.Counter()
    for _, text, _, source in rows:
        whole[source] += size(text)
    order = sorted(whole, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        rest = 1.5 * sum(whole.values()) - sum(2 * whole[s] for s in full)
        over = {s for s in order if s not in full and rest * weight[s] / sum(weight[x] for x in order if x not in full) > 2 * whole[s]}
        if not over:
            break
        full |= over
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        want = 2 * whole[r["source"]] if r["source"] in full else rest * weight[r["source"]] / sum(weight[x] for x in order if x not in full)
        assert r["source_size"] == whole[r["source"]] and r["target"] == pytest.approx(want)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for r in got:
        assert abs(taken[r["source"]] - r["target"]) <= largest[r["source"]]
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixing.apply_mix(none).count() == 0


def test_newton_agrees_with_a_plain_solver(spark):
    random_ = random.Random(5)
    cells = [(s, size, random_.randint(1, 40)) for s in ("a", "b", None) for size in random_.sample(range(1, 20_000), 25)]
    cells += [("one", 10, 5), ("one", 100, 2), ("empty", 0, 4), ("full", 50, 3), ("full", 60, 1), ("none", 70, 2)]
    whole = collections.Counter()
    for s, size, n in cells:
        whole[s] += size * n
    goals = {"a": 0.31 * whole["a"], "b": 1.7 * whole["b"], None: 1.02 * whole[None], "one": 400.0, "empty": 0.0, "full": 2.0 * whole["full"], "none": 0.0}
    frame = spark.createDataFrame(cells, "source string, size bigint, documents bigint")
    table = spark.createDataFrame([(s, whole[s], t) for s, t in goals.items()], "source string, source_size bigint, target double")
    found = {r["source"]: r for r in mixing.tilt(frame, table).collect()}
    assert set(found) == set(goals)

    def rates(s, dual):
        return {size: min(2.0, np.exp(min(700.0, dual * size / found[s]["unit"]))) for t, size, _ in cells if t == s}

    for s in ("a", "b", None, "one"):
        low, high = -1e3, 1e3  # bisection of the same dual
        for _ in range(200):
            middle = (low + high) / 2
            taken = sum(n * size * rates(s, middle)[size] for t, size, n in cells if t == s)
            low, high = (middle, high) if taken < goals[s] else (low, middle)
        want, got = rates(s, low), rates(s, found[s]["dual"])
        assert all(abs(want[size] - got[size]) < 1e-6 for size in want)
        assert sum(n * size * got[size] for t, size, n in cells if t == s) == pytest.approx(goals[s], rel=1e-8)
        assert len(set(round(r, 6) for r in got.values())) > 1  # rates differ with size


def test_jaccard_join(docs, rows, none):
    for k, percent in ((3, 90), (5, 80), (1, 50)):
        sets = []
        for _, text, *_ in rows:
            w = (text or "").encode().lower().split()
            sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
        parent = list(range(len(rows)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b]:
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        parent[find(a)] = find(b)
        least = {}
        for i, r in enumerate(rows):
            if r[0] is not None:
                least[find(i)] = min(least.get(find(i), r[0]), r[0])
        want = sorted(str((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows))
        got = jaccard_join.similar_groups(docs, shingle_words=k, percent=percent).collect()
        assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == want, k
    assert jaccard_join.similar_groups(none).count() == 0


def test_jaccard_join_copies_without_id(spark):
    texts = {name: " ".join(f"{name}{i}" for i in range(60)) for name in "abc"}
    rows = [(None, texts["a"]), (1, texts["a"]), (2, texts["a"] + " end"), (7, texts["b"]), (None, texts["b"])]
    rows += [(None, texts["c"]), (None, texts["c"] + " end"), (9, texts["c"] + " other end")]  # sets without any id
    rows += [(None, f"only{i} a few words that no one else has {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.similar_groups(docs).collect())
    assert got == {(1, 1): 1, (2, 1): 1, (7, 7): 1, (9, 9): 1, (None, 1): 1, (None, 7): 1, (None, 9): 2, (None, None): 30}


def test_jaccard_join_long_lists(spark):
    """A large group of near copies, chained beyond the threshold, and a passage shared by unlike texts."""
    random_ = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(80):
        t = list(base)
        for j in range(random_.choice((0, 1, 1, 2, 2))):
            t[random_.randrange(100)] = f"v{i}_{j}"
        texts.append(t)
    for i in range(60):
        texts.append(base[20:60] + [f"u{i}_{random_.randrange(40)}" for _ in range(60)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    for k, percent in ((3, 90), (1, 96)):
        sets = [{tuple(t[j : j + k]) for j in range(len(t) - k + 1)} for t in texts]
        root = list(range(len(texts)))
        for _ in range(len(texts)):
            before = list(root)
            for a in range(len(texts)):
                for b in range(a):
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        root[a] = root[b] = min(root[a], root[b])
            if root == before:
                break
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(docs, shingle_words=k, percent=percent).collect()}
        assert got == dict(enumerate(root))


def test_components_need_all_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    assert {(r["node"], r["root"]) for r in components.connected(chain).collect()} == {(i, 0) for i in range(41)}
    with pytest.raises(RuntimeError):
        components.connected(chain, rounds=2)


def test_suffix_dedup(docs, rows, none, spark):
    for length, gram, hot in ((400, 32, 50_000), (40, 8, 50_000), (40, 8, 5)):
        texts = [(r[1] or "").encode() for r in rows]
        count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = []
        for r, t in zip(rows, texts):
            cover = np.zeros(len(t) + 1, int)
            for i in range(len(t) - length + 1):
                if count[t[i : i + length]] > 1:
                    cover[i] += 1
                    cover[i + length] -= 1
            cover = np.cumsum(cover)[:-1] > 0
            kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
            want.append(str((r[0], len(t), int(cover.sum()), int((np.diff(np.append(0, cover.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())))
        got = suffix_dedup.remove_repeats(docs, length=length, gram=gram, hot=hot).collect()
        assert sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())) for r in got) == sorted(want)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_reads_texts_as_often_with_common_anchors(spark, docs, rows):
    reads = {}
    for hot in (50_000, 5):
        read = spark.sparkContext.accumulator(0)

        def counting(text):
            read.add(1)
            return text

        counted = docs.withColumn("text", F.udf(counting, "string").asNondeterministic()("text"))
        assert suffix_dedup.remove_repeats(counted, length=40, gram=8, hot=hot).count() == len(rows)
        reads[hot] = read.value
    assert reads[5] == reads[50_000] > 0


def test_induced_sorting():
    random_ = random.Random(1)
    for _ in range(200):
        size = random_.choice((1, 2, 3, 20))
        text = [random_.randint(1, size) for _ in range(random_.randint(1, 60))] + [0]
        order = suffix_dedup.suffix_order(np.array(text, np.uint16), size + 1, 1000, limit=random_.choice((0, 64, 10**9)))
        assert list(order) == sorted(range(len(text)), key=lambda i: text[i:])


def test_anchors_across_stretches(monkeypatch):
    data = np.frombuffer(np.random.default_rng(4).bytes(5000), np.uint8)
    whole = suffix_dedup.anchors(data, 100, 8)
    monkeypatch.setattr(suffix_dedup, "_STRETCH", 700)
    parts = suffix_dedup.anchors(data, 100, 8)
    assert all((a == b).all() for a, b in zip(whole, parts))
    _, first, last = whole
    assert first[0] == 0 and last[-1] == 4900 and (first[1:] == last[:-1] + 1).all()
    grams = suffix_dedup.window_hashes(data, 8)
    for i in range(0, 4901, 53):
        key = grams[i : i + 93] >> np.uint64(22)
        assert whole[0][np.searchsorted(first, i, "right") - 1] == grams[i + int(np.argmin(key))]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub("[^0-9]", "", m.group())
        out += [(m.start(), 2, m.end())] * (14 <= len(g) <= 19 and luhn(g))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        out += [(m.start(), 3, m.end())] * (10 <= len(re.sub("[^0-9]", "", m.group())) <= 15)
    return sorted(out)


def test_base_spans():
    random_ = random.Random(5)
    pieces = [*"0123456789", *"@@@....--++()   \n", "a", "Z", "é", "a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (234) 555-1234", "007.1.1.1", "٣"]
    for _ in range(20000):
        text = "".join(random_.choices(pieces, k=random_.randint(0, 25)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 300000 + "@") == [] and pii.base_spans("1" * 100000) == []


def test_pii(spark, docs, rows, none):
    crf = pii.train()
    more = spark.createDataFrame([(1, "ring (988) 555-2485 or mail bo.42@mail8.example.com, ip 10.1.2.3 é card 4111 1111 1111 1111."), (2, "in 2019 version 2.0 cost 15.99 on 2020-01-02"), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.find(more, crf).select("doc_id", "text", "base", "spans", pii.as_text(F.col("spans")).alias("said")).collect()}
    assert [tuple(s) for s in got[1]["base"]] == plain_spans(got[1]["text"])
    assert "phone:5:19" in got[1]["said"] and got[2]["said"] == got[3]["said"] == got[4]["said"] == ""
    found = pii.find(docs, crf).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(s) for s in r["base"]] == plain_spans(r["text"] or "")
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}
    assert pii.find(none, crf).count() == 0


def test_viterbi_is_best():
    random_ = np.random.default_rng(3)
    crf = pii.Crf(np.zeros((1, 5)), random_.normal(size=(5, 5)), np.zeros(0, np.uint64))
    lengths = np.array([1, 3, 2, 4, 1])
    starts = np.cumsum(lengths) - lengths
    scores = random_.normal(size=(lengths.sum(), 5))
    tags = crf.viterbi(scores, starts, lengths)
    for a, n in zip(starts, lengths):
        def value(path):
            return sum(scores[a + i, t] for i, t in enumerate(path)) + sum(crf.move[x, y] for x, y in zip((0, *path), (*path, 0)))
        best = max(np.ndindex(*(5,) * n), key=value)
        assert tuple(tags[a : a + n]) == best


def test_toxicity(spark, docs, none):
    random_ = random.Random(6)
    neutral = [f"n{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = random_.choices(neutral, k=20) + random_.sample(("idiot", "scum", "moron"), 2) * toxic
        if random_.random() < (0.7 if toxic else 0.1):  # a group named mostly in toxic texts
            words.append("muslim")
        random_.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    labelled = spark.createDataFrame([*labels, (None, 1), (5, None), (5, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(documents, labelled)
    scored = {r["doc_id"]: r for r in toxicity.score(documents, model).collect()}
    assert np.mean([scored[i]["predicted"] == y for i, y in labels]) > 0.98
    weights = dict(zip(model.known.tolist(), model.weights))
    loose = toxicity.train(documents, labelled, swap_weight=0.0)
    before = dict(zip(loose.known.tolist(), loose.weights))
    term, other = toxicity.term_hash("muslim"), toxicity.term_hash("buddhist")
    assert abs(weights[term] - weights[other]) < 0.5 * abs(before[term] - before[other])
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.train(none, labelled.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, blank).collect()} == {0}


def test_neighbours(spark):
    random_ = np.random.default_rng(8)
    vectors = [(i, v.tolist(), 1) for i, v in enumerate(random_.normal(size=(1500, 12)))]
    vectors += [(1500 + i, vectors[40][1], 1) for i in range(60)]  # equal vectors
    vectors += [(2000, None, 1), (2020, [0.0] * 12, 1), (2040, [float("nan")] + [1.0] * 11, 1), (2060, [], 1), (None, [1.0] * 12, 1), (2080, [None] + [1.0] * 11, 1), (2100, [1.0, 2.0], 1), (2120, [3.0, 1.0], 1)]
    vectors += [vectors[20]]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, rank int").repartition(6)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame, k=20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {v[0]: np.array(v[1], np.float32).astype(float) for v in vectors if v[0] is not None and v[1] and None not in v[1] and np.isfinite(v[1]).all() and any(v[1])}
    hits = total = 0
    for q in (i for i in good if i % 20 == 0):
        scores = sorted(((-(good[q] * v).sum(), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        assert all(m[2] == pytest.approx((good[q] * good[m[1]]).sum(), rel=1e-12) for m in mine)
        hits += len({m[1] for m in mine} & {i for _, i in scores})
        total += len(scores)
    assert hits / total >= 0.9 and set(got) == {i for i in good if i % 20 == 0}
    assert neighbours.nearest(frame.limit(0)).count() == 0


def test_recall_where_the_probes_are_few(spark):
    """As many hashes as a hundred million rows would get; the list of probes is far shorter than their cells."""
    random_ = np.random.default_rng(5)
    vectors = random_.normal(size=(1500, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    index, probes = neighbours.fit(rows, rows.where("vec_id % 20 = 0"), 100_000_000, float(np.linalg.norm(vectors, axis=1).max()), 24, k=20)
    keys, order = index.keys(vectors), neighbours.probe_order(index.hashes, probes)
    hits = total = 0
    for q in range(0, 1500, 20):
        visit = index.probes(vectors[q : q + 1], order)[0]
        met = np.any([np.isin(keys[:, t], visit[t]) for t in range(index.tables)], axis=0)
        true = [i for i in np.argsort(-(vectors @ vectors[q]), kind="stable") if i != q][:20]
        hits += met[true].sum()
        total += 20
    assert hits / total >= 0.95


def test_queries_without_enough_candidates(spark):
    random_ = np.random.default_rng(6)
    main = np.array([1.0] + [0.0] * 11)
    vectors = [(i, (main + random_.normal(scale=1e-3, size=12)).tolist()) for i in range(2000)]
    vectors += [(2000 + 20 * i, (-main + random_.normal(scale=0.1, size=12)).tolist()) for i in range(4)]  # far from all others
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(dict)
    for r in neighbours.nearest(frame, k=20).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    assert all(sorted(got[q]) == list(range(1, 21)) for q, _ in vectors if q % 20 == 0)
    ids, flat = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors])
    for q in range(2000, 2080, 20):
        score = np.where(ids == q, -np.inf, (flat * flat[ids == q]).sum(axis=1))
        assert [got[q][r] for r in range(1, 21)] == ids[np.lexsort((ids, -score))[:20]].tolist()


def test_probe_order():
    order = neighbours.probe_order(4, 50)
    assert order[0].sum() == 0 and len({tuple(r) for r in order.tolist()}) == len(order)
    assert not any(r[i] and r[7 - i] for r in order for i in range(4))
    assert len(neighbours.probe_order(3, 1000)) == 27
