"""Dictionaries that are tables: the answers of the literal lists, at any number of terms."""

import random

import pytest

from colprism.functions import predicates as P
from colprism.operators import dictionaries as D
from pyspark.sql import functions as F


def frame(spark, words, name):
    return spark.createDataFrame([(w, i) for i, w in enumerate(words)], f"{name} string, place int").repartition(3)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_keywords(spark):
    random_ = random.Random(1)
    text = lambda n: "".join(random_.choices("abcde äß𝄞\n.*", k=n))
    values = [text(random_.randint(0, 200)) for _ in range(150)] + [None, "", "abc", "a" * 5000, "abc", "x\ny"]
    terms = [text(random_.randint(1, 9)) for _ in range(60)] + ["a", "abc", None, "no such term", values[0][:20], values[3][5:60], ".*", "abc"]
    values_, terms_ = frame(spark, values, "value"), frame(spark, terms, "term")
    want = sorted({(v, t) for v in values if v is not None for t in terms if t is not None and t in v})
    assert sorted(tuple(r) for r in D.keyword_hits(values_, terms_).collect()) == want
    rows = lambda f: sorted(r["place"] for r in f.collect())
    literal = values_.filter(P.contains_any([t for t in terms if t])(F.col("value")))
    assert rows(D.match_keywords(values_, terms_)) == rows(literal) and len(rows(literal)) > 50
    assert rows(D.match_keywords(values_, frame(spark, [""], "term"))) == [i for i, v in enumerate(values) if v is not None]
    assert rows(D.match_keywords(values_, frame(spark, [None], "term"))) == [] == rows(D.match_keywords(values_.limit(0), terms_))


def test_many_keywords(spark):
    random_ = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms = ["".join(random_.choices(letters, k=random_.randint(4, 12))) for _ in range(100_000)]
    values = ["".join(random_.choices(letters, k=120)) for _ in range(200)] + [f"it holds {t} inside" for t in terms[:50]]
    found = D.match_keywords(frame(spark, values, "value"), frame(spark, terms, "term"))
    by_size = {n: {t for t in terms if len(t) == n} for n in range(4, 13)}
    want = [i for i, v in enumerate(values) if any(v[j : j + n] in known for n, known in by_size.items() for j in range(len(v) - n + 1))]
    assert sorted(r["place"] for r in found.collect()) == want
    plan = found._jdf.queryExecution().toString()
    assert terms[0] not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_keywords_by_key(spark, monkeypatch):
    """Hits by the values' key; distinct words, not the places of the texts, meet the index of grams."""
    met = []
    inner = D._containing
    monkeypatch.setattr(D, "_containing", lambda words, parts: met.append(words.count()) or inner(words, parts))
    random_ = random.Random(3)
    words = ["wagon", "wag", "on the", "größe", "été", "x-y", "日本", "--", "a\u3000b"]
    values = [" ".join(random_.choices(words, k=100)) for _ in range(50)] + [None, "", "waggon", "--x", "a b"]
    terms = ["wag", "agon", "on the wag", "röß", "t", "x-y x-y", "本", "- ", "--", " ", "", None, "zebra", "a\u3000b"]
    found = D.keyword_hits(frame(spark, values, "value"), frame(spark, terms, "term"), key="place")
    want = sorted({(i, t) for i, v in enumerate(values) if v is not None for t in terms if t is not None and t in v})
    assert sorted(tuple(r) for r in found.collect()) == want
    assert met[0] < 60
    twice = spark.createDataFrame([(1, "on a wagon"), (1, "wagons"), (None, "wag")], "k int, value string")
    found = D.keyword_hits(twice, frame(spark, ["wag", "on a"], "term"), key="k")
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "on a"), (1, "wag"), (None, "wag")]


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.75, 0.8, 0.9, 1.0])
def test_similar(spark, threshold):
    random_ = random.Random(int(threshold * 100))
    word = lambda low, high: "".join(random_.choices("abcé𝄞", k=random_.randint(low, high)))
    values = [word(1, 7) for _ in range(60)] + [word(8, 30) for _ in range(40)] + [None, "", "a", "aa"]
    terms = [word(1, 7) for _ in range(30)] + [None, "", "a"]
    for v in values[60:100]:  # terms at every distance from long words
        letters = list(v)
        for _ in range(random_.randint(0, len(v) // 2)):
            at = random_.randrange(len(letters) or 1)
            letters[at : at + random_.randint(0, 1)] = random_.choices("abcé𝄞", k=random_.randint(0, 1))
        terms.append("".join(letters))
    want = sorted({(v, t) for v in values if v for t in terms if t and max(len(v), len(t)) - distance(v, t) >= threshold * max(len(v), len(t)) - 1e-9})
    values_, terms_ = frame(spark, values, "value"), frame(spark, terms, "term")
    found = D.similar_terms(values_, terms_, threshold)
    assert sorted(tuple(r) for r in found.collect()) == want and want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    if threshold in (0.5, 0.8):
        got = sorted(r["place"] for r in D.match_similar(values_, terms_, threshold).collect())
        literal = values_.filter(P.similar_to([t for t in terms if t], threshold)(F.col("value")))
        assert got == sorted(r["place"] for r in literal.collect())
        assert D.match_similar(values_, terms_.limit(0), threshold).count() == 0 == D.match_similar(values_.limit(0), terms_, threshold).count()
