"""Many datasets in one job: the documents of one plan per dataset, and failures kept apart."""

import collections
import gzip
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from colprism.plans.folder import file_name, profile_files, profile_folder, read_records, read_tsv_records
from colprism.plans.profile import profile_dataset
from colprism.sources import results
from colprism.sources.records import split_records
from colprism.sources.tsv import read_tsv

FILES = {
    "plain.tsv": "id\tname\tprice\n1\ta\t1.5\n2\tb\t\n3\ta\t-0.0\n4\t\t0.0\n",
    "zeros.tsv": "code\tbig\tflag\n007\t12345678901234567890\ttrue\n7\t1\tFALSE\n+7\t2\t\n",
    "dates.tsv": "day\tmixed\tclock\n2017-01-02\t2017-01-02\t0830A\n2017-01-02 03:04:05\tx\t0930P\n\t5\t\n",
    "quoted.tsv": 'a\tb\n"one\ttab"\t"two\nlines"\n"say ""hi"""\t"back\\"slash"\nhalf"quote\t" \n"\n',
    "names.tsv": "x\tX\t\ty\n1\t2\t3\t4\n5\t6\n7\t8\t9\t10\t11\n",
    "header.tsv": "only\ta header\n",
    "spaces.tsv": "v\tw\n 5\t1e5\n6 \t2\n  \t.5\n",
    "windows.tsv": "a\tb\r\n1\t2\r\n\r\n3\t4\r\n",
    "umlaute.tsv": "größe\tort\n1,5\tÄ\n1,500\tß\n2.5\t€\n",
}


@pytest.fixture()
def folder(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    for name, text in FILES.items():
        (path / name).write_bytes(text.encode())
    return path


def plain(profile):
    return json.loads(json.dumps(profile.asDict(recursive=True), default=str, sort_keys=True))


def test_documents_are_those_of_single_plans(spark, folder):
    got = {r["dataset_name"]: plain(r) for r in profile_files(spark, str(folder)).collect()}
    assert set(got) == set(FILES)
    for name in FILES:
        [want] = profile_dataset(read_tsv(spark, str(folder / name)), name).collect()
        assert got[name] == plain(want), name


def test_failures_stay_apart(spark, folder, tmp_path):
    (folder / "blank.tsv").write_bytes(b"\n\n")
    (folder / "empty.tsv").write_bytes(b"")  # no bytes: not listed
    (folder / "broken.tsv.gz").write_bytes(gzip.compress(b"a\tb\n1\t2\n" * 1000)[:40])
    (folder / "good.tsv.gz").write_bytes(gzip.compress(b"a\tb\n1\t2\n"))
    (folder / "large.tsv").write_bytes(b"n\n" + b"12345\n" * 400)
    out = str(tmp_path / "out")
    status = {r["dataset_name"]: (r["status"], (r["error"] or "")[:9]) for r in profile_folder(spark, str(folder), out, largest=2000).collect()}  # large.tsv is split
    failed = {"blank.tsv": ("failed", "NoRecords"), "broken.tsv.gz": ("failed", "NoRecords")}
    assert status == {**{n: ("finished", "") for n in [*FILES, "good.tsv.gz", "large.tsv"]}, **failed}
    stored = {r["dataset_name"]: r for r in results.read_profiles(spark, out).collect()}
    assert set(stored) == set(status) - set(failed)
    assert stored["large.tsv"]["columns"][0]["data_types"][0]["count"] == 400


def test_records_run_over_line_ends(spark, folder):
    records = read_records(spark, str(folder)).where("dataset_name = 'quoted.tsv'").orderBy("place")
    assert [r["record"] for r in records.collect()] == ["a\tb", '"one\ttab"\t"two\nlines"', '"say ""hi"""\t"back\\"slash"', 'half"quote\t" \n"']


def test_nothing_to_profile(spark, tmp_path):
    (tmp_path / "empty.tsv").write_bytes(b"")
    assert profile_files(spark, str(tmp_path)).count() == 0


def test_five_hundred_datasets_in_one_job(spark, tmp_path):
    path = tmp_path / "many"
    path.mkdir()
    for i in range(500):
        (path / f"set-{i:03}.tsv").write_text("id\tv\n" + "".join(f"{j}\t{i * j}.5\n" for j in range(i % 20 + 1)))
    begin = time.time()
    profiles = profile_files(spark, str(path))
    planned = profiles._jdf.queryExecution().executedPlan().toString()
    got = {r["dataset_name"]: r for r in profiles.collect()}
    assert len(got) == 500 and time.time() - begin < 120
    assert len(planned) < 100_000  # the plan does not grow with the datasets
    for i in (0, 19, 123, 499):
        row = got[f"set-{i:03}.tsv"]
        assert row["columns"][0]["data_types"][0]["count"] == i % 20 + 1 and row["columns"][1]["data_types"][0]["max_value"] == f"{i * (i % 20)}.5"


def test_one_document_of_all_profiles(spark, folder, tmp_path):
    profiles = profile_files(spark, str(folder))
    out = tmp_path / "combined"
    results.write_combined(profiles, "dataset_name", "datasets", str(out))
    document = json.loads("".join(p.read_text() for p in sorted(out.glob("part-*"))))
    assert list(document) == ["datasets"] and [d["dataset_name"] for d in document["datasets"]] == sorted(FILES)
    back = {r["dataset_name"]: plain(r) for r in results.read_combined(spark, str(out), "datasets").drop("dataset_id").collect()}
    assert back == {r["dataset_name"]: plain(r) for r in profiles.collect()}
    results.write_combined(profiles.limit(0), "dataset_name", "datasets", str(out))
    assert json.loads("".join(p.read_text() for p in sorted(out.glob("part-*")))) == {"datasets": []}


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def quoted_file(random_, records):
    def field():
        text = "".join(random_.choices(["a", "b ", "\t", "\n", '\\"', "", "é"], k=random_.randint(0, 6)))
        return f'"{text}"' if random_.random() < 0.4 or "\t" in text or "\n" in text or '"' in text else text
    return "k\tt\n" + "".join(f"{i}\t{field()}\n" for i in range(records))


def test_split_files_have_the_same_records(spark, tmp_path, small_splits):
    random_ = random.Random(6)
    for i in range(6):
        (tmp_path / f"f{i}.tsv").write_bytes(quoted_file(random_, 40 * i + 1).encode())
    (tmp_path / "g.tsv").write_bytes(("h\n" + '"' + "line\n" * 300 + '"\n' + "end\n" * 100).encode())  # one record over many splits
    whole, split = (collections.Counter((r["dataset_name"], min(r["place"], 1), r["record"].rstrip("\n")) for r in f.collect())
                    for f in (read_records(spark, str(tmp_path)), split_records(spark, str(tmp_path), file_name)))
    assert split == whole and sum(n for (f, p, _), n in split.items() if p == 0) == 7
    (tmp_path / "f5.tsv").write_bytes(quoted_file(random_, 200).encode() + b'7\t"never closed\nto the end')
    lines = spark.read.text(str(tmp_path / "f5.tsv"))
    assert lines.rdd.getNumPartitions() > 5
    last = [f(spark, str(tmp_path), file_name).where("record LIKE '7\\t\"never%'").first()["record"] for f in (read_records, split_records)]
    assert last == ['7\t"never closed\nto the end'] * 2


def test_tsv_by_records_is_the_multi_line_read(spark, tmp_path, small_splits):
    path = tmp_path / "a.tsv"
    path.write_bytes(quoted_file(random.Random(9), 150).encode())
    (tmp_path / "typed.tsv").write_text('n\tr\td\tb\tbig\ts\n1\t1.5\t2017-01-02 03:04:05\ttrue\t12345678901234567890\t"x\ny"\n\t\t\tfalse\t1\t\n')
    for file in (path, tmp_path / "typed.tsv"):
        want, got = read_tsv(spark, str(file), multi_line=True), read_tsv_records(spark, str(file))
        assert got.columns == want.columns
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))
        raw = read_tsv(spark, str(file), raw=True, multi_line=True)
        assert collections.Counter(map(tuple, read_tsv_records(spark, str(file), raw=True).collect())) == collections.Counter(map(tuple, raw.collect()))
