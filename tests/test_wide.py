"""Wide texts by stand-ins: the same answers as on whole values."""

import random

import pytest
from pyspark.sql import functions as F

from colprism.operators import cells as L, counts as C, typing as Y, wide as W
from colprism.plans.profile import column_profiles


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def frame(spark):
    random.seed(3)
    shared = "<html><head>" + "x" * 700
    texts = [shared + "".join(random.choice("ab") for _ in range(150)) for _ in range(60)]
    texts += [t + " more" for t in texts[:20]] + [shared[:64], shared[:128], shared[:65]] + texts[:7] * 2
    texts += ["9" * 80, "+" + "8" * 90, " " * 100, "\n" * 70, "", None, "short", "short", "é" * 64, "é" * 65, "\U0001F600" * 66]
    return spark.createDataFrame([(i, t, (t or "")[:3]) for i, t in enumerate(texts)], "n long, t string, s string")


def plain_and_slim(df):
    return Y.typed(L.value_counts(df), keep=("is_blank",)), W.typed(W.value_counts(df))


def test_counts_and_types(spark):
    plain, slim = plain_and_slim(frame(spark))
    assert rows(C.column_counts(plain), "column_name", *C.NUMBERS) == rows(C.column_counts(slim), "column_name", *C.NUMBERS)
    assert rows(Y.type_counts(plain), "column_name", "type", "count") == rows(Y.type_counts(slim), "column_name", "type", "count")
    assert rows(Y.text_stats(plain), "column_name", "average_length") == rows(Y.text_stats(slim), "column_name", "average_length")
    ends = ["column_name", "type", "max_value", "min_value"]
    assert rows(Y.numeric_stats(plain), *ends) == rows(Y.numeric_stats(slim), *ends)


@pytest.mark.parametrize("settled", [1000, 6])
def test_lists(spark, monkeypatch, settled):
    """With few values settled at once, ties are narrowed by pieces behind what the texts share."""
    monkeypatch.setattr(W, "SETTLED", settled)
    df = frame(spark)
    plain, slim = plain_and_slim(df)
    shown = ["column_name", "value", "cnt", "rank"]
    assert rows(C.top_frequent(plain), *shown) == rows(W.top_frequent(W.value_counts(df), df), *shown)
    for longest in (True, False):
        shown = ["column_name", "value", "length", "rank"]
        assert rows(Y.text_by_length(plain, longest), *shown) == rows(W.text_by_length(slim, df, longest), *shown)


def test_prefixes_of_each_other(spark, monkeypatch):
    monkeypatch.setattr(W, "SETTLED", 3)
    df = spark.createDataFrame([("a" * n,) for n in range(60, 400)], "t string")
    got = rows(W.top_frequent(W.value_counts(df), df, 3), "value", "rank")
    assert got == [("a" * 60, 1), ("a" * 61, 2), ("a" * 62, 3)]
    longer = df.filter(F.length("t") > 150)
    assert [len(v) for v, _ in rows(W.top_frequent(W.value_counts(longer), longer, 3), "value", "rank")] == [151, 152, 153]


def test_profile_is_the_same(spark):
    df = frame(spark)
    assert rows(column_profiles(df), "*") == rows(column_profiles(df, wide=True), "*")


def test_empty_table(spark):
    df = spark.createDataFrame([], "t string, n long")
    assert W.top_frequent(W.value_counts(df), df).isEmpty()
    assert W.text_by_length(W.typed(W.value_counts(df)), df, True).isEmpty()


def test_pages_shuffle_a_tenth(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet").select("html")
    size = lambda counts, *columns: counts.select(F.sum(sum(F.octet_length(F.col(c)) for c in columns))).first()[0]
    assert size(W.value_counts(pages), "value", "digest") * 10 < size(L.value_counts(pages), "value")
