import pytest

from colprism.functions.detect import DATETIME, INTEGER, REAL, TEXT
from colprism.operators import report as Q


@pytest.fixture
def columns(spark):
    rows = [("d1", "a", [INTEGER]), ("d1", "b", [INTEGER, TEXT]), ("d1", "c", []), ("d2", "a", [REAL, DATETIME, TEXT]), ("d2", "b", ["ODD"])]
    return spark.createDataFrame(rows, "dataset_name string, column_name string, types array<string>")


def test_types(columns):
    by = {r.dataset_name: tuple(r)[1:] for r in Q.type_counts_by_dataset(columns).collect()}
    assert by == {"d1": (2, 0, 0, 1), "d2": (0, 1, 1, 2)}
    assert tuple(Q.type_totals(Q.type_counts_by_dataset(columns)).first()) == (2, 1, 1, 3)
    assert [tuple(r) for r in Q.untyped_columns(columns).collect()] == [("d1", "c")]
    assert [tuple(r) for r in Q.type_set_frequency(columns).collect()] == [("I", 1), ("IT", 1), ("RDT", 1), ("Empty", 2)]


def test_equal_width(spark):
    frame = spark.createDataFrame([(float(v),) for v in [0, 1, 1, 2, 10]], "x double")
    rows = Q.histogram_equal_width(frame, "x", 5).orderBy("bin").collect()
    assert [r.n for r in rows] == [3, 1, 0, 0, 1] and (rows[0].low, rows[-1].high) == (0.0, 10.0)


def test_equal_width_matches_numpy(spark):
    import numpy as np

    values = np.random.default_rng(1).integers(0, 1000, 3000) / 7
    frame = spark.createDataFrame([(float(v),) for v in values], "x double")
    rows = Q.histogram_equal_width(frame, "x").orderBy("bin").collect()
    assert [r.n for r in rows] == np.histogram(values, 50)[0].tolist()


def test_equal_width_of_equal_values(spark):
    rows = Q.histogram_equal_width(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 4).orderBy("bin").collect()
    assert (rows[0].low, rows[-1].high) == (2.5, 3.5) and [r.n for r in rows] == [0, 0, 2, 0]


def test_fixed_edges(spark):
    frame = spark.createDataFrame([(float(v),) for v in [-1, 0, 4.9, 5, 100, 101, 97]], "x double")
    rows = Q.histogram_fixed_edges(frame, "x").orderBy("bin").collect()
    assert len(rows) == 20 and rows[0].n == 2 and rows[1].n == 1 and rows[19].n == 2 and sum(r.n for r in rows) == 5
    with pytest.raises(ValueError):
        Q.histogram_fixed_edges(frame, "x", [1, 1])


def test_heterogeneity(spark):
    counts = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")], "column_name string, semantic_type string")
    assert [tuple(r) for r in Q.heterogeneity(Q.labels_per_column(counts)).collect()] == [(1, 2), (2, 1)]
