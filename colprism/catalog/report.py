"""Queries of the report over all tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import report as Q, typing as Y
from ..operators.cells import type_cells
from ..sources import results
from . import inputs as I
from .registry import query, stored_once, table

# All tables with the kinds of their columns. The array column of embeddings has no profile type: profiles refuse it.
TABLES = {
    "region": {"r_regionkey": "whole", "r_name": "text"},
    "nation": {"n_nationkey": "whole", "n_name": "text", "n_regionkey": "whole"},
    "customer": {"c_custkey": "whole", "c_name": "text", "c_nationkey": "whole", "c_acctbal": "real", "c_mktsegment": "text"},
    "supplier": {"s_suppkey": "whole", "s_name": "text", "s_nationkey": "whole", "s_acctbal": "real"},
    "part": {"p_partkey": "whole", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "whole", "p_retailprice": "real"},
    "orders": {"o_orderkey": "whole", "o_custkey": "whole", "o_orderstatus": "text", "o_totalprice": "real", "o_orderdate": "moment",
               "o_orderpriority": "text"},
    "lineitem": {"l_orderkey": "whole", "l_partkey": "whole", "l_suppkey": "whole", "l_linenumber": "whole", "l_quantity": "real",
                 "l_extendedprice": "real", "l_discount": "real", "l_tax": "real", "l_returnflag": "text", "l_linestatus": "text",
                 "l_shipdate": "moment"},
    "events": {"event_id": "whole", "ts": "moment", "user_id": "whole", "event_type": "text", "value": "real", "props": "text"},
    "documents": {"doc_id": "whole", "text": "text", "lang": "text", "source": "text", "n_chars": "whole"},
    "embeddings": {"vec_id": "whole", "label": "whole"},
    "pages": {"page_id": "whole", "url": "text", "html": "text"},
    "benchmark": {"item_id": "whole", "text": "text"},
    "labels": {"doc_id": "whole", "quality": "whole", "toxic": "whole"},
    "conversations": {"conv_id": "whole", "turn": "whole", "role": "text", "text": "text"},
}
# Columns that mix types or hold blanks only, on top of the stored ones.
EXTRA = {
    "customer": {"c_code": ("text", "CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_custkey AS STRING) ELSE c_mktsegment END"),
                 "c_blank": ("text", "substr('    ', 1, c_nationkey % 4)")},
    "orders": {"o_mark": ("text", "CASE o_orderstatus WHEN 'O' THEN '12.5' WHEN 'F' THEN CAST(o_custkey AS STRING) ELSE '' END"),
               "o_blank": ("text", "nullif(o_orderstatus, o_orderstatus)")},
}
COLUMNS = {
    name: {**{c: (kind, c) for c, kind in columns.items()}, **EXTRA.get(name, {})} for name, columns in TABLES.items()
}


def column_types(spark, sf_dir, empty_as_text: bool = True) -> DataFrame:
    """Types of every column of every table in one job, without a shuffle of values."""
    frames = [
        type_cells(table(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for c, (_, e) in columns.items()]), name)
        for name, columns in COLUMNS.items()
    ]
    typed = Y.typed(reduce(DataFrame.unionByName, frames), empty_as_text=empty_as_text)
    return Y.types_per_column(typed)


def stored_types(spark, sf_dir, empty_as_text: bool = True) -> DataFrame:
    """The types of all columns, from stored result documents: one JSON document per table, written anew when a table has changed."""
    def store(folder: str) -> None:
        entry = F.struct("column_name", F.transform("types", lambda t: F.struct(t.alias("type"))).alias("data_types"))
        nested = column_types(spark, sf_dir, empty_as_text).groupBy("dataset_name").agg(F.array_sort(F.collect_list(entry)).alias("columns"))
        nested.write.json(folder)

    return Q.column_types(results.read_profiles(spark, stored_once(spark, sf_dir, f"types-{empty_as_text}", COLUMNS, store)))


def _types_sql() -> str:
    return f"SELECT DISTINCT dataset_name, column_name, type FROM ({I.typed_sql(I.cells_sql(COLUMNS))})"


BY_DATASET = f"""SELECT dataset_name, count(*) FILTER (WHERE type = 'INTEGER(LONG)') AS n_integer,
    count(*) FILTER (WHERE type = 'REAL') AS n_real, count(*) FILTER (WHERE type = 'DATE/TIME') AS n_datetime,
    count(*) FILTER (WHERE type = 'TEXT') AS n_text FROM ({_types_sql()}) GROUP BY ALL"""


@query(BY_DATASET)
def type_counts_by_dataset(spark, sf_dir):
    return Q.type_counts_by_dataset(stored_types(spark, sf_dir))


@query(f"""SELECT CAST(sum(n_integer) AS BIGINT) AS n_integer, CAST(sum(n_real) AS BIGINT) AS n_real,
    CAST(sum(n_datetime) AS BIGINT) AS n_datetime, CAST(sum(n_text) AS BIGINT) AS n_text FROM ({BY_DATASET})""")
def type_totals(spark, sf_dir):
    return Q.type_totals(Q.type_counts_by_dataset(stored_types(spark, sf_dir)))


@query(f"""SELECT code, count(*) AS n_columns FROM (
    SELECT dataset_name, column_name, CASE WHEN bool_or(type = 'INTEGER(LONG)') THEN 'I' ELSE '' END
        || CASE WHEN bool_or(type = 'REAL') THEN 'R' ELSE '' END || CASE WHEN bool_or(type = 'DATE/TIME') THEN 'D' ELSE '' END
        || CASE WHEN bool_or(type = 'TEXT') THEN 'T' ELSE '' END AS code
    FROM ({_types_sql()}) GROUP BY dataset_name, column_name) GROUP BY code""")
def type_set_frequency(spark, sf_dir):
    return Q.type_set_frequency(stored_types(spark, sf_dir))


@query(rf"""SELECT dataset_name, column_name FROM ({I.cells_sql(COLUMNS)}) GROUP BY ALL
    HAVING bool_and(regexp_matches(value, '^\s*$'))""")
def untyped_columns(spark, sf_dir):
    return Q.untyped_columns(stored_types(spark, sf_dir, empty_as_text=False))


def _equal_width_sql(tab: str, column: str, bins: int = 50) -> str:
    return f"""
        WITH x AS (SELECT CAST({column} AS DOUBLE) AS x FROM {tab}), span AS (SELECT min(x) AS low, max(x) AS high FROM x),
        placed AS (SELECT least(CAST(floor((x - low) / (high - low) * {bins}) AS INTEGER), {bins - 1}) AS bin FROM x, span)
        SELECT CAST(b.bin AS INTEGER) AS bin, round(low + b.bin * ((high - low) / {bins}), 6) AS low,
            round(low + (b.bin + 1) * ((high - low) / {bins}), 6) AS high, count(p.bin) AS n
        FROM span, (SELECT unnest(range({bins})) AS bin) b LEFT JOIN placed p ON p.bin = b.bin GROUP BY ALL"""


def _rounded(histogram: DataFrame) -> DataFrame:
    return histogram.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query(_equal_width_sql("lineitem", "l_extendedprice"))
def histogram_equal_width(spark, sf_dir):
    return _rounded(Q.histogram_equal_width(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query("""
    WITH placed AS (SELECT CASE WHEN x = 100 THEN 19 ELSE CAST(floor(x / 5) AS INTEGER) END AS bin
        FROM (SELECT CAST(value AS DOUBLE) AS x FROM events) WHERE x BETWEEN 0 AND 100)
    SELECT CAST(b.bin AS INTEGER) AS bin, CAST(b.bin * 5 AS DOUBLE) AS low, CAST(b.bin * 5 + 5 AS DOUBLE) AS high, count(p.bin) AS n
    FROM (SELECT unnest(range(20)) AS bin) b LEFT JOIN placed p ON p.bin = b.bin GROUP BY ALL""")
def histogram_fixed_edges(spark, sf_dir):
    return Q.histogram_fixed_edges(table(spark, sf_dir, "events"), "value")
