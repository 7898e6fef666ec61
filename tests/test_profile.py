import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from colprism.operators import counts as C, typing as Y
from colprism.operators.cells import UnsupportedColumnType, cells, value_counts
from colprism.plans.profile import column_profiles, profile_dataset, profile_datasets
from colprism.sources import results


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_counts(spark):
    row = C.column_counts(value_counts(column(spark, ["a", "b", "a", " ", ""]))).first()
    assert (row.n_rows, row.n_non_empty, row.n_empty, row.n_distinct) == (5, 3, 2, 4)


def test_null_and_empty_text_are_one_value(spark):
    row = C.column_counts(value_counts(column(spark, [None, "", "a"]))).first()
    assert (row.n_empty, row.n_distinct) == (2, 2)


def test_one_empty_cell_may_be_part_of_a_key(spark):
    per_column = C.column_counts(value_counts(column(spark, ["a", "b", ""])))
    assert C.key_candidates(per_column).count() == 1


def test_top_frequent_breaks_ties_by_value(spark):
    top = C.top_frequent(value_counts(column(spark, ["c", "b", "a", "a", "", "e", "d"]))).orderBy("rank")
    assert [(r.value, r.cnt) for r in top.collect()] == [("a", 2), ("", 1), ("b", 1), ("c", 1), ("d", 1)]


def test_cells_print_as_python_does(spark):
    values = [1.5, 1e7, 12345678.9, 1e16, 1.25e300, 0.0001, 1.5e-05, -0.0, 0.0, float("nan"), float("-inf"), 100.0, 0.1]
    got = {r.value for r in cells(column(spark, values, "double")).collect()}
    assert got == {repr(v) for v in values}
    flags = {r.value for r in cells(column(spark, [True, False, None], "boolean")).collect()}
    assert flags == {"True", "False", ""}


def test_extremes_take_lexical_ends(spark):
    stats = Y.numeric_stats(Y.typed(value_counts(column(spark, ["5", "+5", "3"])))).first()
    assert (stats.max_value, stats.min_value) == ("5", "3")
    assert stats["mean"] == pytest.approx(13 / 3) and stats.stddev == pytest.approx(0.942809, abs=1e-6)


def test_whole_numbers_of_any_length_are_ordered(spark):
    values = [str(v) for v in [10**40, 10**40 + 1, -(10**40), -(10**40) - 1, 5, -7, 10**19]]
    stats = Y.extremes(Y.typed(value_counts(column(spark, values)))).first()
    assert (stats.max_value, stats.min_value) == (str(10**40 + 1), str(-(10**40) - 1))


def test_cells_and_counts_agree(spark):
    values = ["1", "1", "2.5", "7", "7", "7", "", "abc", "abc", "2017-01-01"]
    frame = column(spark, values)
    for operator in (Y.type_stats, Y.extremes, Y.deviations, Y.type_counts, Y.text_stats, Y.datetime_stats, Y.numeric_stats):
        one, other = operator(Y.typed(cells(frame))), operator(Y.typed(value_counts(frame)))
        plain = lambda df: sorted(
            (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr
        )
        assert plain(one) == plain(other)
    for longest in (True, False):
        by = lambda df: [r.value for r in Y.text_by_length(Y.typed(df), longest).orderBy("rank").collect()]
        assert by(cells(frame)) == by(value_counts(frame))


def test_repeated_values_fill_the_places(spark):
    typed = Y.typed(value_counts(column(spark, ["long text"] * 9 + ["a", ""])))
    assert [r.value for r in Y.text_by_length(typed, True).orderBy("rank").collect()] == ["long text"] * 5
    assert [r.value for r in Y.text_by_length(typed, False).orderBy("rank").collect()] == ["", "a"] + ["long text"] * 3


def test_deviation_does_not_cancel(spark):
    values = [1e12 + 1, 1e12 + 2, 1e12 + 3]
    row = Y.deviations(Y.typed(value_counts(column(spark, values, "double")))).first()
    assert row.stddev == pytest.approx((2 / 3) ** 0.5, rel=1e-6)


def test_nested_profile(spark):
    frame = spark.createDataFrame([(1, "x", None), (2, "x", 2.5), (3, None, 3.5)], "k int, t string, r double")
    profile = profile_dataset(frame, "demo").first()
    assert profile.dataset_name == "demo" and profile.key_column_candidates == ["k", "r"]
    k, t, r = profile.columns
    assert [c.column_name for c in profile.columns] == ["k", "t", "r"]
    assert t.frequent_values == ["x", ""] and t.number_empty_cells == 1
    assert [(e.type, e["count"]) for e in r.data_types] == [("REAL", 2), ("TEXT", 1)]
    assert k.data_types[0].max_value == "3" and k.data_types[0].longest_values is None
    assert t.data_types[0].longest_values == ["x", "x", ""] and t.data_types[0].average_length == pytest.approx(2 / 3)


def test_table_without_rows(spark):
    profile = profile_dataset(spark.createDataFrame([], "a int, b string"), "empty").first()
    assert profile.key_column_candidates == ["a", "b"]
    assert [(c.number_distinct_values, c.data_types) for c in profile.columns] == [(0, []), (0, [])]


def test_column_names_with_quotes(spark):
    frame = spark.createDataFrame([(1, "x")], "`it's` int, `a``b\\c` string")
    names = [r.column_name for r in column_profiles(frame).orderBy("column_pos").collect()]
    assert names == frame.columns


def test_array_column_is_refused(spark):
    with pytest.raises(UnsupportedColumnType):
        value_counts(spark.createDataFrame([([1],)], "a array<int>"))


def test_decimal_column(spark):
    stats = Y.numeric_stats(Y.typed(value_counts(column(spark, [Decimal("12.50"), Decimal("3.25")], "decimal(10,2)")))).first()
    assert (stats.type, stats.max_value, stats.min_value) == ("REAL", "12.50", "3.25")


def test_one_failure_does_not_stop_the_others(spark, tmp_path):
    good = column(spark, ["a"])
    status = profile_datasets(
        spark,
        {"aaaa-bbbb.tsv": lambda: good, "bad": lambda: spark.createDataFrame([([1],)], "a array<int>"),
         "gone": lambda: spark.read.parquet("/nowhere")},
        str(tmp_path),
    )
    assert {r.dataset_name: r.status for r in status.collect()} == {
        "aaaa-bbbb.tsv": "finished", "bad": "failed", "gone": "failed"}
    errors = {r.dataset_name: r.error for r in status.collect()}
    assert errors["bad"].startswith("UnsupportedColumnType: column a") and errors["aaaa-bbbb.tsv"] is None
    back = results.read_profiles(spark, str(tmp_path)).first()
    assert (back.dataset_name, back.dataset_id, back.columns[0].frequent_values) == ("aaaa-bbbb.tsv", "aaaa-bbbb", ["a"])


def test_datasets_of_one_id_are_both_kept(spark, tmp_path):
    readers = {f"aaaa-bbbb.v{i}.tsv": (lambda i=i: column(spark, [f"x{i}"])) for i in (1, 2)} | {"a/b c.tsv": lambda: column(spark, ["y"])}
    status = profile_datasets(spark, readers, str(tmp_path))
    assert {r.status for r in status.collect()} == {"finished"}
    got = {(r.dataset_name, r.dataset_id, r.columns[0].frequent_values[0]) for r in results.read_profiles(spark, str(tmp_path)).collect()}
    assert got == {("aaaa-bbbb.v1.tsv", "aaaa-bbbb", "x1"), ("aaaa-bbbb.v2.tsv", "aaaa-bbbb", "x2"), ("a/b c.tsv", "a/b c.tsv", "y")}


def test_without_folder_nothing_is_finished(spark):
    status = profile_datasets(spark, {"a": lambda: column(spark, ["a"])}).collect()
    assert [(r.status, r.error) for r in status] == [("planned", None)]


def test_table_without_rows(spark):
    empty = column(spark, []).limit(0)
    counted = C.column_counts(value_counts(empty), empty)
    assert [(r.n_rows, r.n_distinct) for r in C.key_candidates(counted).collect()] == [(0, 0)]


def test_sums(spark, tiny):
    orders = spark.read.parquet(f"{tiny}/orders.parquet")
    rows = orders.count()
    counts = value_counts(orders)
    for r in C.column_counts(counts).collect():
        assert r.n_rows == rows == r.n_empty + r.n_non_empty and r.n_distinct <= rows
    per_type = Y.type_counts(Y.typed(counts)).groupBy("column_pos").agg(F.sum("count").alias("n"))
    assert {r.n for r in per_type.collect()} == {rows}


def test_values_are_shuffled_once(spark, tiny):
    """The branches of a profile read the stored values, typed once, and top-k is cut before its shuffle."""
    frame = column_profiles(spark.read.parquet(f"{tiny}/orders.parquet"))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "orders.parquet" not in final and "try_to_timestamp" not in final and "RLIKE" not in final
    assert "WindowGroupLimit" in final
    unstored = column_profiles(spark.read.parquet(f"{tiny}/orders.parquet"), store=False)
    assert "orders.parquet" in unstored._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, unstored.collect())) == sorted(map(str, frame.collect()))


def test_statistics_need_no_sort(spark, tiny):
    typed = Y.typed(value_counts(spark.read.parquet(f"{tiny}/orders.parquet")))
    for operator in (Y.numeric_stats, Y.datetime_stats, Y.full_stats):
        frame = operator(typed)
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "Sort" not in plan
        assert plan.count("FileScan") + plan.count("ReusedExchange") <= 2  # two reads of the values


@pytest.mark.parametrize("middle", [0.0, 1e9, -1e9, 1e12])
def test_merged_moments(spark, middle):
    random_ = random.Random(3)
    values = [round(middle + random_.uniform(-1, 1), 3) for _ in range(300)]
    values = [v for v in values for _ in range(random_.choice([1, 1, 2, 3, 7, 100]))]
    row = Y.full_stats(Y.typed(value_counts(column(spark, values, "double")))).first()
    exact = [Decimal(v) for v in values]
    mean = sum(exact) / len(exact)
    deviation = (sum((v - mean) ** 2 for v in exact) / len(exact)).sqrt()
    assert row["count"] == len(values)
    assert row["mean"] == pytest.approx(float(mean), rel=1e-14, abs=1e-12) and row["stddev"] == pytest.approx(float(deviation), rel=1e-9 if abs(middle) < 1e10 else 1e-6)


def test_combined_document_is_json(spark):
    records = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "name string, n int")
    lines = results.combined_document(records, "name", "datasets").orderBy("section", "key").collect()
    assert json.loads("\n".join(r.line for r in lines)) == {
        "datasets": [{"name": "a", "n": 2}, {"name": "b", "n": 1}, {"name": "c", "n": 3}]}
    twice = results.combined_document(records.union(records), "name", "datasets").orderBy("section", "key", F.col("line").startswith(","), "line").collect()
    assert len(json.loads("\n".join(r.line for r in twice))["datasets"]) == 6


def test_combined_files_are_one_document(spark, tmp_path):
    records = spark.range(200).selectExpr("lpad(cast(id as string), 4, '0') AS name")
    results.write_combined(records, "name", "datasets", str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert [r["name"] for r in json.loads(text)["datasets"]] == [f"{i:04d}" for i in range(200)]


def test_long_texts_are_ranked_whole(spark):
    head = "word " * 100
    texts = [head + "b"] * 3 + [head + c for c in "hgfedca"] + ["x" * 300, "9" * 300, " " * 300, "Jan 5, 2017" + " " * 300, "short", None, "é" * 200]
    row = column_profiles(spark.createDataFrame([(t,) for t in texts], "t string")).first()
    assert list(row.frequent_values) == [head + "b", ""] + sorted({t for t in texts if t} - {head + "b"})[:3]
    kinds = {e["type"]: e for e in row.data_types}
    assert kinds["DATE/TIME"]["count"] == 1 and kinds["INTEGER(LONG)"]["count"] == 1
    assert list(kinds["TEXT"]["longest_values"]) == [head + c for c in ("a", "b", "b", "b", "c")]


def test_documents_profile(spark, tiny):
    import duckdb

    path = f"{tiny}/documents.parquet"
    row = column_profiles(spark.read.parquet(path)).filter("column_name = 'text'").first()
    counted = duckdb.execute(f"SELECT count(DISTINCT text), max(length(text)) FROM '{path}'").fetchall()[0]
    longest = row.data_types[-1].longest_values
    assert (row.n_distinct, len(longest[0])) == counted
    top = duckdb.execute(f"SELECT count(*) AS n FROM '{path}' GROUP BY text ORDER BY n DESC LIMIT 5").fetchall()
    for text, (n,) in zip(row.frequent_values, top):
        assert duckdb.execute(f"SELECT count(*) FROM '{path}' WHERE text = ?", [text]).fetchall()[0][0] == n


def test_types_without_a_row_per_typed_cell(spark):
    """Types by the schema come from two cells a column; the types are those of all cells."""
    from colprism.operators.cells import cells, type_cells

    rows = [(1, None, 2.5, "x", None), (None, None, float("nan"), "7", None), (3, None, -0.0, " ", None)] * 50
    df = spark.createDataFrame(rows, "`a.b` bigint, none date, r double, t string, `n``x` string")
    for frame, most in ((df, 306), (df.limit(0), 0), (df.select("t"), 150), (df.select("`a.b`", "none"), 4)):
        some = type_cells(frame, "d")
        assert some.count() <= most
        for blank in (True, False):
            of = lambda c: sorted(map(str, Y.types_per_column(Y.typed(c, empty_as_text=blank)).collect()))
            assert of(some) == of(cells(frame, "d"))


def test_summaries_are_computed_once(spark, monkeypatch):
    calls, inner = [], Y.summaries
    monkeypatch.setattr(Y, "summaries", lambda typed: calls.append(1) or inner(typed))
    df = spark.createDataFrame([(1, "a", 1.5), (2, "7", None), (None, " ", 2.5)], "i int, t string, r double")
    stored = profile_dataset(df, "d").collect()
    assert len(calls) == 1 and stored == profile_dataset(df, "d", store=False).collect()
