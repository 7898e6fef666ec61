"""Queries of the generic profile."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from ..operators import cells as L, counts as C, typing as Y, wide as W
from ..plans.folder import profile_files, read_tsv_records
from ..plans.profile import profile_dataset, profile_datasets
from ..sources import results
from ..sources.listing import list_datasets
from ..sources.tsv import date_like_sample, name_files, parse_column_list, read_tsv
from . import inputs as I
from .registry import query, table

CELLS = I.cells_sql(I.GENERIC)
TYPED = I.typed_sql(I.cells_sql({"orders": I.MIXED_DUCK}))
COUNTS = f"SELECT dataset_name, column_name, value, count(*) AS cnt FROM ({CELLS}) GROUP BY ALL"


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union(L.value_counts(I.generic(spark, sf_dir, name), name) for name in I.GENERIC)


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.typed(L.value_counts(I.mixed(spark, sf_dir), "orders"))


@query("""SELECT *, CAST(row_number() OVER (ORDER BY length, dataset_name) AS INTEGER) AS place FROM (
    SELECT rpad(c_mktsegment, CAST(greatest(9, length(c_mktsegment)) AS INTEGER), '-') || '.tsv' AS dataset_name, rpad(c_mktsegment, 9, '-') AS dataset_id,
        CAST(sum(strlen(CAST(c_custkey AS VARCHAR)) + strlen(c_name) + 2) AS BIGINT) AS length FROM customer GROUP BY c_mktsegment)""")
def dataset_listing(spark, sf_dir):
    """Files of the customers of each market segment, written first, next to a catalogue file that the listing skips."""
    folder = os.path.join(results.scratch_folder(spark), f"listing-{os.urandom(8).hex()}")
    customers = table(spark, sf_dir, "customer")
    lines = customers.select("c_mktsegment", F.concat_ws("\t", "c_custkey", "c_name").alias("line"))
    segments = lines.select("c_mktsegment").distinct()
    listed = segments.select(F.lit("datasets").alias("c_mktsegment"), F.col("c_mktsegment").alias("line"))
    lines.unionByName(listed).repartition("c_mktsegment").write.partitionBy("c_mktsegment").text(f"{folder}/parts")
    names = {f"c_mktsegment={r[0]}": f"{r[0]:-<9}.tsv" for r in segments.collect()} | {"c_mktsegment=datasets": "datasets.tsv"}
    name_files(spark, f"{folder}/parts", names, f"{folder}/files")
    files = list_datasets(spark, f"{folder}/files").select("dataset_name", "dataset_id", "length")
    return files.withColumn("place", F.row_number().over(Window.orderBy("length", "dataset_name")))


@query(f"SELECT dataset_name, column_name, value FROM ({CELLS})")
def cells_long(spark, sf_dir):
    united = _union(L.cells(I.generic(spark, sf_dir, name), name) for name in I.GENERIC)
    return united.select("dataset_name", "column_name", "value")


@query(COUNTS)
def value_counts(spark, sf_dir):
    return _counts(spark, sf_dir).select("dataset_name", "column_name", "value", "cnt")


COLUMN_COUNTS = rf"""
    SELECT dataset_name, column_name, CAST(sum(cnt) AS BIGINT) AS n_rows,
        CAST(sum(CASE WHEN regexp_matches(value, '^\s*$') THEN 0 ELSE cnt END) AS BIGINT) AS n_non_empty,
        CAST(sum(CASE WHEN regexp_matches(value, '^\s*$') THEN cnt ELSE 0 END) AS BIGINT) AS n_empty,
        count(*) AS n_distinct
    FROM ({COUNTS}) GROUP BY ALL"""


@query(COLUMN_COUNTS)
def column_counts(spark, sf_dir):
    return C.column_counts(_counts(spark, sf_dir)).drop("column_pos")


@query(f"SELECT dataset_name, column_name FROM ({COLUMN_COUNTS}) WHERE n_rows = n_distinct")
def key_candidates(spark, sf_dir):
    return C.key_candidates(C.column_counts(_counts(spark, sf_dir))).select("dataset_name", "column_name")


@query(f"""
    SELECT * FROM (SELECT dataset_name, column_name, value, cnt,
        CAST(row_number() OVER (PARTITION BY dataset_name, column_name ORDER BY cnt DESC, value) AS INTEGER) AS rank
        FROM ({COUNTS})) WHERE rank <= 5""")
def top5_frequent(spark, sf_dir):
    return C.top_frequent(_counts(spark, sf_dir)).drop("column_pos")


@query(f"""SELECT column_name, value, type, CASE WHEN type IN ('INTEGER(LONG)', 'REAL') THEN round(number, 4) END AS number,
    CASE WHEN type = 'DATE/TIME' THEN strftime(moment, '%Y-%m-%d %H:%M:%S') END AS moment, CAST(length AS INTEGER) AS length
    FROM ({TYPED})""")
def typed_cells(spark, sf_dir):
    typed = Y.typed(L.cells(I.mixed(spark, sf_dir)))
    return typed.select(
        "column_name", "value", "type", F.round("number", 4).alias("number"),
        F.date_format("moment", "yyyy-MM-dd HH:mm:ss").alias("moment"), "length",
    )


@query(f"SELECT column_name, type, count(*) AS count FROM ({TYPED}) GROUP BY ALL")
def type_counts(spark, sf_dir):
    return Y.type_counts(_typed(spark, sf_dir)).select("column_name", "type", "count")


@query(f"""SELECT column_name, type, count(*) AS count, arg_max(value, ROW(number, value)) AS max_value,
    arg_min(value, ROW(number, value)) AS min_value, round(avg(number), 4) AS mean, round(stddev_pop(number), 4) AS stddev
    FROM ({TYPED}) WHERE type IN ('INTEGER(LONG)', 'REAL') GROUP BY ALL""")
def numeric_stats(spark, sf_dir):
    return Y.numeric_stats(_typed(spark, sf_dir)).select(
        "column_name", "type", "count", "max_value", "min_value",
        F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"),
    )


@query(f"""SELECT column_name, type, count(*) AS count, arg_max(value, ROW(moment, value)) AS max_value,
    arg_min(value, ROW(moment, value)) AS min_value FROM ({TYPED}) WHERE type = 'DATE/TIME' GROUP BY ALL""")
def datetime_stats(spark, sf_dir):
    return Y.datetime_stats(_typed(spark, sf_dir)).select("column_name", "type", "count", "max_value", "min_value")


@query(f"""SELECT column_name, count(*) AS count, round(avg(length), 4) AS average_length FROM ({TYPED})
    WHERE type = 'TEXT' GROUP BY ALL""")
def text_stats(spark, sf_dir):
    stats = Y.text_stats(_typed(spark, sf_dir))
    return stats.select("column_name", "count", F.round("average_length", 4).alias("average_length"))


def _by_length_sql(direction: str) -> str:
    return f"""SELECT * FROM (SELECT column_name, value, CAST(length AS INTEGER) AS length,
        CAST(row_number() OVER (PARTITION BY column_name ORDER BY length {direction}, value) AS INTEGER) AS rank
        FROM ({TYPED}) WHERE type = 'TEXT') WHERE rank <= 5"""


@query(_by_length_sql("DESC"))
def text_longest(spark, sf_dir):
    return Y.text_by_length(_typed(spark, sf_dir), longest=True).select("column_name", "value", "length", "rank")


@query(_by_length_sql("ASC"))
def text_shortest(spark, sf_dir):
    return Y.text_by_length(_typed(spark, sf_dir), longest=False).select("column_name", "value", "length", "rank")


CLOCK = "strftime(ts, '%I%M') || substr(strftime(ts, '%p'), 1, 1)"


@query(f"""SELECT value, strftime(strptime('1900-01-01 ' || value || 'M', '%Y-%m-%d %I%M%p'), '%Y-%m-%d %H:%M') AS moment,
    count(*) AS count FROM (SELECT {CLOCK} AS value FROM events) GROUP BY ALL""")
def clock_values(spark, sf_dir):
    code = F.concat(F.date_format("ts", "hhmm"), F.left(F.date_format("ts", "a"), F.lit(1)))
    clocks = table(spark, sf_dir, "events").select(code.alias("value"))
    typed = Y.typed(L.value_counts(clocks))
    return typed.select("value", F.date_format("moment", "yyyy-MM-dd HH:mm").alias("moment"), F.col("cnt").alias("count"))


# A nested profile, unnested again so that both sides compare as scalars.
def _flat(profile: DataFrame) -> DataFrame:
    column = profile.select(
        "dataset_name", F.explode("columns").alias("c"), F.col("key_column_candidates").alias("keys")
    )
    entry = column.select(
        "dataset_name", "c.column_name",
        F.col("c.number_non_empty_cells").alias("n_non_empty"),
        F.col("c.number_empty_cells").alias("n_empty"),
        F.col("c.number_distinct_values").alias("n_distinct"),
        F.array_join("c.frequent_values", "|").alias("frequent_values"),
        F.array_contains("keys", F.col("c.column_name")).alias("is_key"),
        F.explode("c.data_types").alias("t"),
    )
    return entry.select(
        *entry.columns[:-1],
        F.col("t.type").alias("type"), F.col("t.count").alias("count"),
        F.col("t.max_value").alias("max_value"), F.col("t.min_value").alias("min_value"),
        F.round("t.mean", 4).alias("mean"), F.round("t.stddev", 4).alias("stddev"),
        F.array_join("t.shortest_values", "|").alias("shortest_values"),
        F.array_join("t.longest_values", "|").alias("longest_values"),
        F.round("t.average_length", 4).alias("average_length"),
    )


def _flat_sql(name: str, columns) -> str:
    cells = I.cells_sql({name: columns})
    counts = f"SELECT column_name, value, count(*) AS cnt FROM ({cells}) GROUP BY ALL"
    ranked = lambda order: f"row_number() OVER (PARTITION BY column_name, type ORDER BY length {order}, value)"
    return rf"""
        WITH cell AS MATERIALIZED ({I.typed_sql(cells)}),
        per_column AS (
            SELECT column_name, CAST(sum(CASE WHEN regexp_matches(value, '^\s*$') THEN 0 ELSE cnt END) AS BIGINT) AS n_non_empty,
                CAST(sum(CASE WHEN regexp_matches(value, '^\s*$') THEN cnt ELSE 0 END) AS BIGINT) AS n_empty,
                count(*) AS n_distinct, sum(cnt) = count(*) AS is_key FROM ({counts}) GROUP BY ALL),
        frequent AS (
            SELECT column_name, string_agg(value, '|' ORDER BY place) AS frequent_values FROM (
                SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS place FROM ({counts}))
            WHERE place <= 5 GROUP BY ALL),
        stats AS (
            SELECT column_name, type, count(*) AS count,
                CASE type WHEN 'TEXT' THEN NULL WHEN 'DATE/TIME' THEN arg_max(value, ROW(moment, value))
                    ELSE arg_max(value, ROW(number, value)) END AS max_value,
                CASE type WHEN 'TEXT' THEN NULL WHEN 'DATE/TIME' THEN arg_min(value, ROW(moment, value))
                    ELSE arg_min(value, ROW(number, value)) END AS min_value,
                CASE WHEN type IN ('INTEGER(LONG)', 'REAL') THEN round(avg(number), 4) END AS mean,
                CASE WHEN type IN ('INTEGER(LONG)', 'REAL') THEN round(stddev_pop(number), 4) END AS stddev,
                CASE WHEN type = 'TEXT' THEN round(avg(length), 4) END AS average_length
            FROM cell GROUP BY column_name, type),
        texts AS (
            SELECT column_name, type,
                string_agg(value, '|' ORDER BY short) FILTER (WHERE short <= 5) AS shortest_values,
                string_agg(value, '|' ORDER BY long) FILTER (WHERE long <= 5) AS longest_values
            FROM (SELECT *, {ranked('ASC')} AS short, {ranked('DESC')} AS long FROM cell WHERE type = 'TEXT') GROUP BY ALL)
        SELECT '{name}' AS dataset_name, p.column_name, n_non_empty, n_empty, n_distinct, frequent_values, is_key,
            s.type, s.count, max_value, min_value, mean, stddev, shortest_values, longest_values, average_length
        FROM per_column p JOIN frequent f USING (column_name) JOIN stats s USING (column_name)
        LEFT JOIN texts t ON t.column_name = s.column_name AND t.type = s.type"""


@query(_flat_sql("orders", I.MIXED_DUCK))
def profile_nested(spark, sf_dir):
    return _flat(profile_dataset(I.mixed(spark, sf_dir), "orders"))


@query(_flat_sql("customer", I.GENERIC["customer"]))
def profile_tsv_roundtrip(spark, sf_dir):
    """A TSV dataset written and read back, its profile written as JSON and read back."""
    folder = os.path.join(results.scratch_folder(spark), f"roundtrip-{os.urandom(8).hex()}")
    source = I.generic(spark, sf_dir, "customer")
    source.write.csv(f"{folder}/tsv", sep="\t", header=True)
    status = profile_datasets(spark, {"customer": lambda: read_tsv(spark, f"{folder}/tsv")}, f"{folder}/profiles")
    if status.filter("status <> 'finished'").count():
        raise RuntimeError("the profile of the TSV dataset failed")
    return _flat(results.read_profiles(spark, f"{folder}/profiles"))


_MANY = """SELECT dataset_name, column_name, schema_type, value FROM (
    SELECT c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS dataset_name, * FROM customer),
    LATERAL (VALUES ('c_custkey', 'INTEGER(LONG)', CAST(c_custkey AS VARCHAR)), ('c_name', 'TEXT', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END),
        ('c_acctbal', 'REAL', CAST(c_acctbal AS VARCHAR)), ('c_mktsegment', 'TEXT', c_mktsegment)) AS t(column_name, schema_type, value)"""


MANY = f"""SELECT dataset_name, column_name, count(*) FILTER (WHERE value <> '') AS n_non_empty, count(*) FILTER (WHERE value = '') AS n_empty,
    count(DISTINCT value) AS n_distinct, count(DISTINCT value) = count(*) AS is_key,
    string_agg(DISTINCT CASE WHEN value = '' THEN 'TEXT' ELSE schema_type END, '|') AS types,
    CASE WHEN min(schema_type) <> 'TEXT' THEN round(avg(TRY_CAST(value AS DOUBLE)), 4) END AS mean,
    CASE WHEN min(schema_type) <> 'TEXT' THEN round(stddev_pop(TRY_CAST(value AS DOUBLE)), 4) END AS stddev,
    CASE WHEN min(schema_type) <> 'TEXT' THEN arg_max(value, ROW(TRY_CAST(value AS DOUBLE), value)) END AS max_value
    FROM ({_MANY}) GROUP BY ALL"""


def _many(spark, sf_dir) -> DataFrame:
    """A TSV dataset for the customers of each segment and nation, all profiled in one job."""
    folder = os.path.join(results.scratch_folder(spark), f"many-{os.urandom(8).hex()}")
    customers = table(spark, sf_dir, "customer").selectExpr(
        "concat(c_mktsegment, '-', CAST(c_nationkey AS STRING)) AS dataset", "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS c_name", "c_acctbal", "c_mktsegment")
    customers.write.partitionBy("dataset").csv(folder, sep="\t", header=True, emptyValue="")
    return profile_files(spark, folder, lambda path: F.regexp_extract(path, "dataset=([^/]+)", 1))


def _many_flat(profiles: DataFrame) -> DataFrame:
    flat = profiles.select("dataset_name", F.explode("columns").alias("c"), "key_column_candidates")
    entry = F.get(F.filter("c.data_types", lambda t: t["mean"].isNotNull()), F.lit(0))
    return flat.select(
        "dataset_name", "c.column_name", F.col("c.number_non_empty_cells").alias("n_non_empty"), F.col("c.number_empty_cells").alias("n_empty"),
        F.col("c.number_distinct_values").alias("n_distinct"), F.array_contains("key_column_candidates", F.col("c.column_name")).alias("is_key"),
        F.array_join(F.transform("c.data_types", lambda t: t["type"]), "|").alias("types"),
        F.round(entry["mean"], 4).alias("mean"), F.round(entry["stddev"], 4).alias("stddev"), entry["max_value"].alias("max_value"))


@query(MANY)
def profile_many(spark, sf_dir):
    return _many_flat(_many(spark, sf_dir))


@query(MANY)
def combined_profiles(spark, sf_dir):
    """The nested profiles of many datasets written as one document under ``datasets``, in order over several files, and read back."""
    folder = os.path.join(results.scratch_folder(spark), f"combined-{os.urandom(8).hex()}")
    results.write_combined(_many(spark, sf_dir), "dataset_name", "datasets", folder)
    return _many_flat(results.read_combined(spark, folder, "datasets"))


@query("SELECT doc_id, source, length(text) AS length, md5(text) AS digest FROM documents")
def tsv_records(spark, sf_dir):
    """The documents written as TSV, their line breaks inside quotes, and read back by all tasks."""
    folder = os.path.join(results.scratch_folder(spark), f"records-{os.urandom(8).hex()}")
    table(spark, sf_dir, "documents").select("doc_id", "source", "text").write.csv(folder, sep="\t", header=True, quoteAll=True)
    back = read_tsv_records(spark, folder)
    return back.select("doc_id", "source", F.length("text").alias("length"), F.md5(F.col("text").cast("binary")).alias("digest"))


ALL_TABLES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5,
    "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS dataset_name, 'finished' AS status, NULL AS error, {n} AS n_columns, {n} * count(*) AS n_cells FROM {name}"
    for name, n in ALL_TABLES.items()) + " UNION ALL SELECT 'embeddings', 'failed', 'UnsupportedColumnType', NULL, NULL"
    " UNION ALL SELECT 'missing', 'failed', 'AnalysisException', NULL, NULL")
def dataset_status(spark, sf_dir):
    """All tables and one that is missing, with what their stored profiles count; an array column cannot be profiled."""
    readers = {name: (lambda name=name: table(spark, sf_dir, name)) for name in [*ALL_TABLES, "embeddings", "missing"]}
    folder = os.path.join(results.scratch_folder(spark), f"status-{os.urandom(8).hex()}")
    status = profile_datasets(spark, readers, folder).withColumn("error", F.split_part("error", F.lit(":"), F.lit(1)))
    cells_of = F.aggregate("columns", F.lit(0).cast("long"), lambda n, c: n + c["number_non_empty_cells"] + c["number_empty_cells"])
    stored = results.read_profiles(spark, folder).select("dataset_name", F.size("columns").alias("n_columns"), cells_of.alias("n_cells"))
    return status.join(stored, "dataset_name", "left")


def _sample_sql() -> str:
    parts = []
    for name, column in [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]:
        value = I.as_text("moment", column)
        parts.append(f"""SELECT '{name}' AS dataset_name, '{column}' AS column_name, value,
            CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS rank FROM (SELECT DISTINCT {value} AS value FROM {name})""")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE rank <= 5"


@query(_sample_sql())
def datelike_sample(spark, sf_dir):
    frames = [
        date_like_sample(table(spark, sf_dir, name)).select(F.lit(name).alias("dataset_name"), "*")
        for name in ("orders", "lineitem", "events")
    ]
    return _union(frames)


@query("""SELECT DISTINCT event_type || '-' || CAST(user_id AS VARCHAR) || '.' || event_type || '_name.txt.gz' AS file_name
    FROM events""")
def column_list_parse(spark, sf_dir):
    """Lists of file names as they stand in a list file, one per event type; names repeat."""
    events = table(spark, sf_dir, "events")
    name = F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"), F.lit("."), "event_type", F.lit("_name.txt.gz"))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    lines = events.select(F.concat(F.lit("["), quoted(name), F.lit(", "), quoted(name), F.lit("]")).alias("value"))
    return parse_column_list(lines)


@query("SELECT value, lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) AS normalized FROM "
       "(SELECT '  ' || c_mktsegment || chr(9) || c_name || chr(10) AS value FROM customer)")
def value_normalize(spark, sf_dir):
    values = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("  "), "c_mktsegment", F.lit("\t"), "c_name", F.lit("\n")).alias("value")
    )
    return values.withColumn("normalized", X.normalize_value(F.col("value")))


@query(r"""SELECT value, upper(substr(a, 1, 1)) || lower(substr(a, 2)) || ' ' || upper(substr(b, 1, 1)) || lower(substr(b, 2)) AS cased
    FROM (SELECT value, split_part(p, ' ', 1) AS a, split_part(p, ' ', 2) AS b FROM (
        SELECT ' ' || replace(p_name, ' ', '   ') || ' ' AS value, p_name AS p FROM part))""")
def normal_case(spark, sf_dir):
    values = table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" ")).alias("value")
    )
    return values.withColumn("cased", X.normal_case(F.col("value")))


@query("""SELECT url, regexp_matches(lower(url), '[|^&+%*#=!>]') AS is_junk FROM pages
    UNION ALL SELECT c_name, regexp_matches(c_name, '[|^&+%*#=!>]') FROM customer
    UNION ALL SELECT CASE WHEN event_type = 'view' THEN 'N/A' ELSE event_type END, event_type = 'view' FROM events""")
def junk_values(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("url")
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("url"))
    types = table(spark, sf_dir, "events").selectExpr("CASE WHEN event_type = 'view' THEN 'N/A' ELSE event_type END AS url")
    return urls.unionByName(names).unionByName(types).withColumn("is_junk", X.is_junk(X.normalize_value(F.col("url"))))


@query("""SELECT p_partkey, p_name, p_type, round(1 - levenshtein(p_name, lower(p_type)) / greatest(length(p_name), length(p_type)), 6)
    AS score FROM part""")
def similarity_score(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select(
        "p_partkey", "p_name", "p_type", F.round(X.similarity(F.col("p_name"), F.lower("p_type")), 6).alias("score")
    )


# Whole texts of two tables, which stay where they are until five of them are shown.
WIDE = {"documents": "text", "pages": "html"}
WIDE_COUNTS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, coalesce({c}, '') AS value, count(*) AS cnt FROM {t} GROUP BY ALL" for t, c in WIDE.items())


def _wide(spark, sf_dir, operator) -> DataFrame:
    frames = [table(spark, sf_dir, t).select(c) for t, c in WIDE.items()]
    return _union(operator(W.value_counts(df), df) for df in frames)


@query(rf"""SELECT column_name, CAST(sum(cnt) AS BIGINT) AS n_rows,
    CAST(sum(CASE WHEN regexp_matches(value, '^\s*$') THEN 0 ELSE cnt END) AS BIGINT) AS n_non_empty,
    CAST(sum(CASE WHEN regexp_matches(value, '^\s*$') THEN cnt ELSE 0 END) AS BIGINT) AS n_empty,
    count(*) AS n_distinct FROM ({WIDE_COUNTS}) GROUP BY ALL""")
def wide_column_counts(spark, sf_dir):
    return _wide(spark, sf_dir, lambda counts, df: C.column_counts(counts).drop("column_pos"))


@query(f"""SELECT * FROM (SELECT column_name, value, cnt,
    CAST(row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS INTEGER) AS rank FROM ({WIDE_COUNTS})) WHERE rank <= 5""")
def wide_top5_frequent(spark, sf_dir):
    return _wide(spark, sf_dir, lambda counts, df: W.top_frequent(counts, df).drop("column_pos"))


@query(rf"""SELECT * FROM (SELECT column_name, value, length,
    CAST(row_number() OVER (PARTITION BY column_name ORDER BY length DESC, value) AS INTEGER) AS rank FROM (
        SELECT column_name, value, CAST(CASE WHEN regexp_matches(value, '^\s*$') THEN 0 ELSE length(value) END AS INTEGER) AS length
        FROM ({WIDE_COUNTS}), range(cnt))) WHERE rank <= 5""")
def wide_text_longest(spark, sf_dir):
    longest = lambda counts, df: W.text_by_length(W.typed(counts), df, longest=True)
    return _wide(spark, sf_dir, longest).select("column_name", "value", "length", "rank")
