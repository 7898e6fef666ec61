"""Whitening, fingerprints and spelling variants against plain versions, on odd rows too."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colprism.llm import minhash, pii, queries as Q, spelling, whitening
from colprism.llm.common import table

DOCS = "doc_id bigint, text string, n_chars string, word string, n string, part string, mark string, id string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], DOCS).repartition(3)


def sorted_rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


# Whitening

VECTORS = "vec_id bigint, embedding array<float>, x string, n string, white string, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *["c"] * 4) for i, v in rows], VECTORS).repartition(3)


def plain_whitening(rows, components=32, ones=False):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows])
    fit = np.unique(x, axis=0) if ones else x
    n, sums = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], -1)
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)
    e, u = e[order], u[:, order]
    e = e[e > e[0] * 1e-11][:components]
    white = (x - sums / n) @ u[:, : len(e)] / np.sqrt(e)
    return n, ((n * x - sums) ** 2).sum(axis=1), white, e / np.trace(cov)


def check_whitening(frame, rows, ones=False):
    n, deviation, white, explained = plain_whitening(rows, ones=ones)
    got = collections.defaultdict(dict)
    for r in frame.collect():
        got[r["vec_id"]].setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] < 1e-4
    signs = {}
    for i, (vec_id, _) in enumerate(rows):
        assert sorted(got[vec_id]) == list(range(1, len(explained) + 1))
        for c, found in got[vec_id].items():
            want = white[i, c - 1]
            if abs(want) > 1e-3:
                sign = signs.setdefault(c, np.sign(found[0]["whitened"] * want))
                assert any(abs(r["whitened"] * sign - want) < 1e-8 for r in found)
            assert all(r["deviation"] == deviation[i] for r in found) and abs(found[0]["explained"] - explained[c - 1]) < 1e-9


def test_whitening(spark):
    random_ = np.random.default_rng(5)
    mix = random_.normal(size=(6, 6))
    rows = [(i, [float(np.float32(v)) for v in random_.normal(size=6) @ mix]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(2000, [v + 1e-4 for v in rows[8][1]])]  # a third are copies of one vector
    odd = [(3000, None), (3001, []), (3002, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (3003, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
           (3004, [float("inf")] * 6), (3005, [1.0, 2.0]), (3006, [3e38] * 6)]
    frame = vectors(spark, rows + odd)
    check_whitening(whitening.whiten(frame), rows)
    check_whitening(whitening.whiten(frame, weights="ones"), rows, ones=True)
    twice = whitening.whiten(vectors(spark, [(5, rows[0][1]), (5, rows[0][1]), (None, rows[1][1]), (6, rows[2][1])]))
    assert twice.where("vec_id = 5 AND component = 1").count() == 2 and twice.where("vec_id IS NULL AND component = 1").count() == 1
    assert whitening.whiten(vectors(spark, [(1, [2.0, 3.0])] * 3)).count() == 0  # no variance, no component
    empty = whitening.whiten(vectors(spark, odd[:2]))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_uses_frequent_vectors_once(spark, monkeypatch):
    monkeypatch.setattr(whitening, "_HOT", 10)  # vectors of over a tenth of the rows go by broadcast
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)] + [(100 + i, [5.0, 5.0, 5.0]) for i in range(40)]
    frame = whitening.whiten(vectors(spark, rows))
    check_whitening(frame, rows)
    assert "BroadcastHashJoin" in frame._jdf.queryExecution().toString()


def test_whole_numbers_beyond_longs():
    x = np.array([[1 << 40, 3], [5, 7]], np.int64)
    big = whitening.offsets(x, 1 << 30, [1 << 50, 2])
    assert big.dtype == object and big[0][0] == (1 << 70) - (1 << 50)
    assert whitening.deviations(big)[0] is None
    assert whitening.deviations(whitening.offsets(x, 2, [4, 4])) == [(2 * (1 << 40) - 4) ** 2 + 4 if (2 * (1 << 40) - 4) ** 2 + 4 < 1 << 63 else None, 36 + 100]


def test_whitening_query(spark, tiny):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, tiny, "embeddings").collect()]
    check_whitening(Q.QUERIES["op11_embedding_whitening"](spark, tiny), rows)


# Fingerprints

WORDS = "kan lora mix ter öns shu tira boß wen gal nem".split()


def lowered(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def texts():
    random_ = random.Random(3)
    out = [(i * 10, " ".join(random_.choices(WORDS, k=random_.randint(40, 300)))) for i in range(40)]
    out += [(401, None), (402, ""), (403, "  \n"), (404, "eins"), (405, "EINS"), (406, "x" * 3_000), (407, "ä€𝄞 " * 9_000), (408, out[3][1]), (409, out[3][1].replace("kan", "neu", 1))]
    out += [(30, out[4][1]), (30, "one more of id thirty"), out[5], (None, "no id at all here"), (None, None)]
    return out


def check_edits(rows, texts):
    order = sorted(texts, key=lambda r: -(1 << 63) if r[0] is None else r[0])
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    assert len(rows) == len(texts)
    values = [(x["fingerprint"], x["edited_fingerprint"]) for x in rows]
    assert all(len(a) == len(b) == 1024 for a, b in values)
    same_id = collections.Counter(r[0] for r in texts)
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)]
        if same_id[doc_id] > 1 or same_id[following[0]] > 1:
            continue  # order by a hash of the text: tested below
        text, after = text or "", following[1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        [r] = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        # 128 places: 0.25 is over five standard deviations
        assert abs(r["near_edited"] - jaccard(shingle_set(text), shingle_set(edited))) < 0.25, doc_id
        assert abs(r["near_next"] - jaccard(shingle_set(text), shingle_set(after))) < 0.25, doc_id


def test_fingerprints(spark, texts):
    frame = documents(spark, texts)
    whole = minhash.compare_edits(frame).collect()
    check_edits(whole, texts)
    assert {r["near_next"] for r in whole if r["doc_id"] == 402} == {1.0}  # no words, like the next one
    cut = minhash.compare_edits(frame, part_bytes=5_000).collect()  # some twenty parts
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, cut)) == sorted(map(key, whole))
    single = {r["doc_id"]: r["fingerprint"] for r in minhash.fingerprints(frame).where("doc_id > 300").collect()}
    assert single[401] == single[402] == single[403] == "f" * 1024 and single[404] == single[405] != single[406]
    assert {r["fingerprint"] for r in whole if r["doc_id"] == 390} == {single[390]}
    assert minhash.compare_edits(frame.limit(0)).count() == 0
    [alone] = minhash.compare_edits(documents(spark, [(5, "one two three four five six seven")])).collect()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 33
    stuffed = minhash.compare_edits(documents(spark, [(7, "a b c")] * 50 + [(8, "d")]), part_bytes=30)
    assert stuffed.count() == 51 and stuffed.where("near_next = 1").count() == 49


def test_signatures_are_minima(texts):
    text = texts[2][1].encode()
    data = np.frombuffer(text, np.uint8)
    whole = minhash.signatures(data, np.array([0, len(text)]))
    half = minhash.signatures(data, np.array([0, len(text) // 2, len(text)]))
    assert whole.shape == (1, 128) and half.shape == (2, 128) and (whole != minhash.EMPTY).all()
    factor, summand = minhash.hash_functions()
    assert (factor % 2 == 1).all() and len(set(factor)) == len(set(summand)) == 128


def test_near_groups(spark):
    random_ = random.Random(11)
    rows, base = [], [random_.choices(range(10_000), k=120) for _ in range(12)]
    for g, words in enumerate(base):
        for j in range(6):
            near = list(words)
            near[(7 * j) % 120] = 10_000 + j
            if j > 3:  # too far from the others
                near[::6] = [20_000 + 31 * j + i for i in range(20)]
            rows.append((g * 100 + j, " ".join(map(str, near))))
    rows += [(5000, rows[0][1]), (5000, rows[0][1]), (5001, None), (5002, ""), (5003, " "), (None, rows[0][1]), (None, "quite alone here")]
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and x and y and 10 * len(x & y) >= 8 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = minhash.near_groups(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["group"]) for r in got if r["doc_id"] is not None} == {(i, find(i)) for i, _ in sets if i is not None}
    assert sorted(str(r["group"]) for r in got if r["doc_id"] is None) == ["0", "None"]
    assert minhash.near_groups(documents(spark, rows).limit(0)).count() == 0


# Spelling variants

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, factor=5):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if one_edit(w, v)]
        best = min(near, default=None)
        out[w] = (best[1] if best and -best[0] >= factor * n else None, n, len(near), -best[0] if best and -best[0] >= factor * n else None)
    rows = set()
    for w, (form, n, near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, near, form_n))
    return rows


def plain_words(rows, drop=199):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if run:
                counts[run] += 1
    return counts


def test_count_words(spark, monkeypatch):
    random_ = random.Random(2)
    rows = [(i, " ".join("".join(random_.choices("abcÀÿÉ€1-Z", k=random_.randint(1, 9))) for _ in range(80))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "Wort ohne Nummer"), (52, "große" * 2000 + " " + "Ab " * 3000), (53, "×÷a"), rows[3]]
    frame = documents(spark, rows)
    for drop in (199, 7, 0):
        assert {r["word"]: r["n"] for r in spelling.count_words(frame, drop_every=drop).collect()} == dict(plain_words(rows, drop))
    long = "".join(random_.choices("abÿ c", k=5000))
    want = re.findall("[a-zÀ-ÿ]+", long)
    monkeypatch.setattr(spelling, "_STRETCH", 7)
    assert [w for some in spelling._runs(long) for w in some] == want
    assert spelling.count_words(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 50, 1024])
def test_spelling_variants(spark, block):
    random_ = random.Random(4)
    counts = {"".join(random_.choices("abé𝄞", k=random_.randint(1, 6))): 5 ** random_.randint(0, 6) for _ in range(400)}
    counts |= {"aabbaabb" + "a" * i: 7**i for i in range(6)}  # a chain of forms
    frame = spark.createDataFrame([*counts.items(), (None, 3), ("", 9)], "word string, n bigint").withColumn("form", F.lit("clash"))
    got = spelling.spelling_variants(frame, block=block)
    assert {tuple(r) for r in got.collect()} == plain_variants(counts) and got.count() == len(counts)
    assert spelling.spelling_variants(frame.limit(0)).count() == 0


def test_near_pairs_by_brute_force():
    random_ = random.Random(8)
    words = sorted({"".join(random_.choices("ab", k=random_.randint(1, 7))) for _ in range(120)})
    every = np.arange(len(words))
    near = spelling.near_pairs(spelling.code_points(words), every, every)
    assert all(near[i, j] == one_edit(a, b) for i, a in enumerate(words) for j, b in enumerate(words))


def test_spelling_ties_and_hubs(spark):
    hub = {"abcdef": 1000} | {f"abcde{c}": 2 for c in "ghijklmnop"} | {"xbcdef": 1000, "ybcdef": 3}
    frame = spark.createDataFrame(list(hub.items()), "word string, n bigint")
    assert {tuple(r) for r in spelling.spelling_variants(frame, block=2).collect()} == plain_variants(hub)


def test_spelling_query(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, tiny, "documents").collect()]
    counts = {w: n for w, n in plain_words(rows).items() if len(w) >= 6 and n >= 5}
    assert {tuple(r) for r in Q.QUERIES["op13_spelling_variants"](spark, tiny).collect()} == plain_variants(counts)


# Personal data: all columns of the query

def test_pii_query(spark, tiny):
    def spans(text):
        found = []
        for kind, pattern in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
            for m in re.finditer(pattern, text):
                digits = [int(d) for d in re.findall("[0-9]", m[0])]
                doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
                good = [True, all(int(p) <= 255 for p in re.findall("[0-9]+", m[0])), 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 10 <= len(digits) <= 15][kind]
                if good:
                    found.append((m.start(), kind, m.end()))
        return sorted(found)

    for r, d in zip(Q.QUERIES["op1_pii"](spark, tiny).orderBy("doc_id").collect(), table(spark, tiny, "documents").orderBy("doc_id").collect()):
        want = spans(d["text"] or "")
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(k == i for _, k, _ in want) for i in range(4)], r["doc_id"]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(",")) | {""}
