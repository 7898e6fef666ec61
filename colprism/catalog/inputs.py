"""Derived input tables, spelled once in SQL that Spark and DuckDB both read.

Tables have no nulls, so empty cells are made by expressions over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table

# table -> {column: (kind, expression)}; kind says how the oracle writes the value as text
GENERIC = {
    "orders": {
        "o_orderkey": ("whole", "o_orderkey"),
        "o_custkey": ("whole", "o_custkey"),
        "o_orderstatus": ("text", "nullif(o_orderstatus, 'F')"),
        "o_totalprice": ("real", "o_totalprice"),
        "o_orderdate": ("moment", "o_orderdate"),
        "o_orderpriority": ("text", "CASE WHEN o_orderpriority = '3-MEDIUM' THEN '  ' ELSE o_orderpriority END"),
    },
    "customer": {
        "c_custkey": ("whole", "c_custkey"),
        "c_name": ("text", "c_name"),
        "c_nationkey": ("whole", "nullif(c_nationkey, 3)"),
        "c_acctbal": ("real", "c_acctbal"),
        "c_mktsegment": ("text", "nullif(c_mktsegment, 'BUILDING')"),
    },
    "part": {
        "p_partkey": ("whole", "p_partkey"),
        "p_name": ("text", "p_name"),
        "p_brand": ("text", "p_brand"),
        "p_type": ("text", "nullif(p_type, 'PROMO')"),
        "p_size": ("whole", "p_size"),
        "p_retailprice": ("real", "p_retailprice"),
    },
}


def generic(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for c, (_, e) in GENERIC[name].items()])


def as_text(kind: str, column: str) -> str:
    """DuckDB: text of a cell as the profile prints it."""
    whole_second = f"date_trunc('second', {column}) = {column}"
    return {
        "whole": f"coalesce(CAST({column} AS VARCHAR), '')",
        "real": f"coalesce(CAST({column} AS VARCHAR), '')",
        "text": f"coalesce({column}, '')",
        "moment": f"coalesce(CASE WHEN {whole_second} THEN strftime({column}, '%Y-%m-%d %H:%M:%S')"
                  f" ELSE strftime({column}, '%Y-%m-%d %H:%M:%S.%f') END, '')",
    }[kind]


SCHEMA_TYPE = {"whole": "INTEGER(LONG)", "real": "REAL", "moment": "DATE/TIME", "text": "TEXT"}


def cells_sql(tables: dict[str, dict[str, tuple[str, str]]]) -> str:
    """DuckDB: (dataset_name, column_name, schema_type, value) of all cells."""
    parts = []
    for name, columns in tables.items():
        for column, (kind, expression) in columns.items():
            parts.append(
                f"SELECT '{name}' AS dataset_name, '{column}' AS column_name, '{SCHEMA_TYPE[kind]}' AS schema_type, "
                f"{as_text(kind, f'({expression})')} AS value FROM {name}"
            )
    return " UNION ALL ".join(parts)


# Text columns that mix types; Spark and DuckDB format numbers and dates in different words.
MIXED_SPARK = {
    "amount": """CASE o_orderstatus WHEN 'O' THEN format_number(o_totalprice, 2) WHEN 'F' THEN CAST(o_totalprice AS STRING)
        ELSE format_number(o_orderkey * 37 - 20000, 0) END""",
    "moment": """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN date_format(o_orderdate, 'MM/dd/yyyy')
        WHEN '2' THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), repeat(' ', CAST(o_orderkey % 90 AS INT))) WHEN '3' THEN date_format(o_orderdate, 'MMM dd, yyyy')
        WHEN '4' THEN '  ' ELSE o_orderpriority END""",
    "note": """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN CAST(o_custkey AS STRING) WHEN '2' THEN ''
        ELSE o_orderpriority END""",
    "price": "nullif(o_totalprice, 0.0)",
    "ordered": "o_orderdate",
}
MIXED_DUCK = {
    "amount": ("text", """CASE o_orderstatus WHEN 'O' THEN format('{:,.2f}', o_totalprice)
        WHEN 'F' THEN CAST(o_totalprice AS VARCHAR) ELSE format('{:,}', CAST(o_orderkey * 37 - 20000 AS BIGINT)) END"""),
    "moment": ("text", """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN strftime(o_orderdate, '%m/%d/%Y')
        WHEN '2' THEN strftime(o_orderdate, '%Y-%m-%d') || repeat(' ', CAST(o_orderkey % 90 AS BIGINT)) WHEN '3' THEN strftime(o_orderdate, '%b %d, %Y')
        WHEN '4' THEN '  ' ELSE o_orderpriority END"""),
    "note": ("text", """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN CAST(o_custkey AS VARCHAR) WHEN '2' THEN ''
        ELSE o_orderpriority END"""),
    "price": ("real", "nullif(o_totalprice, 0.0)"),
    "ordered": ("moment", "o_orderdate"),
}


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in MIXED_SPARK.items()])


def typed_sql(cells: str) -> str:
    """DuckDB: cells with type, number, moment and length, from (…, schema_type, value)."""
    # The number shapes.
    number = r"^[+-]?([1-9]\d*|0)$", r"^[+-]?[1-9]\d{0,2}(,\d{3})*$", r"^[+-]?(\d+\.\d*|\d*\.\d+)$", r"^[+-]?[1-9]\d{0,2}(,\d{3})*\.\d*$"
    formats = ["%m/%d/%Y", "%Y-%m-%d", "%b %d, %Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f"]
    parsed = "coalesce(" + ", ".join(f"try_strptime(trim(value), '{f}')" for f in formats) + ")"
    clock = r"regexp_matches(value, '^(1[0-2]|0[1-9])[0-5]\d[AaPp]$')"
    return rf"""
        SELECT dataset_name, column_name, value,
            CASE WHEN regexp_matches(value, '^\s*$') THEN 'TEXT'
                 WHEN schema_type <> 'TEXT' THEN schema_type
                 WHEN regexp_matches(value, '{number[0]}') OR regexp_matches(value, '{number[1]}') THEN 'INTEGER(LONG)'
                 WHEN regexp_matches(value, '{number[2]}') OR regexp_matches(value, '{number[3]}') THEN 'REAL'
                 WHEN {parsed} IS NOT NULL THEN 'DATE/TIME'
                 WHEN {clock} THEN 'DATE/TIME' ELSE 'TEXT' END AS type,
            TRY_CAST(replace(value, ',', '') AS DOUBLE) AS number,
            coalesce({parsed}, CASE WHEN {clock} THEN try_strptime('1900-01-01 ' || value || 'M', '%Y-%m-%d %I%M%p') END) AS moment,
            CASE WHEN regexp_matches(value, '^\s*$') THEN 0 ELSE length(value) END AS length
        FROM ({cells})"""
