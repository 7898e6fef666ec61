import gzip
import json

from colprism.sources import labels as M, results
from colprism.sources.listing import list_datasets
from colprism.sources.tsv import date_like_sample, has_multiline_fields, parse_column_list, read_tsv, read_value_files, write_value_files
from pyspark.sql import functions as F


def test_tsv(spark, tmp_path):
    path = tmp_path / "aaaa-bbbb.tsv"
    path.write_text(
        "id\tname\tamount\tday\twhen\topen\n1\ta\t1.50\t2017-01-02\t2017-01-02 03:04:05\ttrue\n"
        '007\t"x\ny"\t10000000.0\t2017-01-03\t2017-01-02T03:04:05.000\tfalse\n\t" b "\t2\t\t\t\n'
    )
    assert has_multiline_fields(spark, str(path))
    frame = read_tsv(spark, str(path))
    assert [f.dataType.simpleString() for f in frame.schema] == ["int", "string", "double", "timestamp", "timestamp", "boolean"]
    assert [r.name for r in frame.collect()] == ["a", "x\ny", " b "]
    assert dict(read_tsv(spark, str(path), raw=True).dtypes)["id"] == "string"
    got = [(r.column_name, r.value) for r in date_like_sample(frame).orderBy("column_name", "rank").collect()]
    assert got[:3] == [("day", ""), ("day", "2017-01-02 00:00:00"), ("day", "2017-01-03 00:00:00")]


def test_quotes_in_one_line_stay_splittable(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text('a\tb\n"p\tq"\t1\n"r"\t"s"\n')
    assert not has_multiline_fields(spark, str(path))
    assert [tuple(r) for r in read_tsv(spark, str(path), raw=True).collect()] == [("p\tq", "1"), ("r", "s")]


def test_doubled_quotes_stay_splittable(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text('a\tb\n"say ""hi"""\t1\n"r"\t"s""t"\n')
    assert not has_multiline_fields(spark, str(path))
    (tmp_path / "y.tsv").write_text('a\tb\n"p\nq"\t1\n')
    assert has_multiline_fields(spark, str(tmp_path / "y.tsv"))


def test_listing(spark, tmp_path):
    for name, size in [("datasets.tsv", 1), ("bbbb-cccc.tsv", 9), ("aaaa-bbbb.tsv", 4)]:
        (tmp_path / name).write_text("x" * size)
    got = [(r.dataset_name, r.dataset_id, r.length) for r in list_datasets(spark, str(tmp_path)).collect()]
    assert got == [("aaaa-bbbb.tsv", "aaaa-bbbb", 4), ("bbbb-cccc.tsv", "bbbb-cccc", 9)]


def test_value_files(spark, tmp_path):
    with gzip.open(tmp_path / "x.Color.txt.gz", "wt") as out:
        out.write("red\t3\nblue\tmany\n\t2\n")
    with gzip.open(tmp_path / "y.Zip.txt.gz", "wt") as out:
        out.write("10001\n")
    got = {(r.column_name, r.value, r.freq) for r in read_value_files(spark, str(tmp_path)).collect()}
    assert got == {("x.Color", "red", 3), ("x.Color", "blue", 1), ("x.Color", None, 2), ("y.Zip", "10001", 1)}


def test_value_files_in_parts(spark, tmp_path):
    """A large column is written and read by several tasks, under the column's own name."""
    rows = [("Big", f"v {i}", i % 7 + 1) for i in range(1000)] + [("Big", None, 2), ("Small", "x", 3), ("Site", "a+b", 250), ("Site", "c", 1)]
    values = spark.createDataFrame(rows, "column_name string, value string, freq bigint")
    out = tmp_path / "a b+c"
    write_value_files(values, str(out), "abcd-1234", without_counts=["Site"], file_rows=100)
    assert len(list((out / "abcd-1234.Big.txt.gz").glob("part-*.gz"))) == 11
    assert (out / "abcd-1234.Small.txt.gz").is_file()
    back = read_value_files(spark, str(out)).groupBy("column_name", "value").agg(F.sum("freq").alias("freq"))
    assert {tuple(r) for r in back.collect()} == {(f"abcd-1234.{c}", v, n) for c, v, n in rows}
    assert back.where("column_name LIKE '%Site'").count() == 2 and read_value_files(spark, str(out / "abcd-1234.Big.txt.gz")).count() == 1001


def test_column_list(spark):
    lines = spark.createDataFrame([("['a.x.txt.gz', 'b.y.txt.gz', 'a.x.txt.gz']",)], "value string")
    assert sorted(r.file_name for r in parse_column_list(lines).collect()) == ["a.x.txt.gz", "b.y.txt.gz"]


def test_manual_labels(spark, tmp_path):
    document = {"actual_types": [{"column_name": "a", "manual_labels": [{"semantic_type": "City"}, {"semantic_type": "Other"}]}]}
    path = tmp_path / "labels.json"
    path.write_text(json.dumps(document, indent=1))
    assert sorted(tuple(r) for r in M.read_manual_labels(spark, str(path)).collect()) == [("a", "City"), ("a", "Other")]


def test_label_results(spark, tmp_path):
    nested = spark.createDataFrame([("a.b", [("City", 2)]), ("c.d", [("Other", 1)])], results.LABELS_SCHEMA)
    results.write_labels(nested, str(tmp_path / "out"))
    back = results.read_labels(spark, str(tmp_path / "out")).collect()
    assert sorted((r.column_name, [tuple(e) for e in r.semantic_types]) for r in back) == [("a.b", [("City", 2)]), ("c.d", [("Other", 1)])]


def test_manual_label_documents(spark, tmp_path):
    from colprism.sources.labels import read_manual_labels

    (tmp_path / "a.json").write_text("""{
      "actual_types": [
        {"column_name": "x", "manual_labels": [{"semantic_type": "City"}, {"semantic_type": "Other", "sure": {"by": ["me"]}}]},
        {"column_name": "y"}, {"manual_labels": [{"semantic_type": "Color"}]}, {"column_name": "z", "manual_labels": ["Zip_code", {}, 3]}
      ], "more": 1
    }""")
    (tmp_path / "b.json").write_text('{"actual_types": [{"column_name": "w", "manual_labels": []}]}')
    (tmp_path / "c.json").write_text("no json")
    assert sorted(map(tuple, read_manual_labels(spark, str(tmp_path)).collect())) == [("x", "City"), ("x", "Other"), ("z", "Zip_code")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "list.json").write_text('[{"column_name": "v", "manual_labels": [{"semantic_type": "City"}]}]')
    assert [tuple(r) for r in read_manual_labels(spark, str(tmp_path / "d"), "$").collect()] == [("v", "City")]


def test_stored_results_follow_their_tables(spark, tmp_path):
    from colprism.catalog.registry import stored_once

    calls = []
    for rows in (3, 3, 4):
        if not calls or rows == 4:
            spark.range(rows).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
        stored_once(spark, str(tmp_path), "test", ["t"], calls.append)
    assert len(calls) == 2
