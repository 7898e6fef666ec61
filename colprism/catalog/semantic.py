"""Queries of the semantic profile, the dictionaries, the evaluation and the combined document.

Column values are composed from whole tables by expressions both engines
read, so each route sees values that fit, that nearly fit and that do not.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import predicates as P, routing as R, terms as W
from ..operators import dictionaries as D, evaluation as E, report as Q, semantic as S
from ..sources import labels as M, results
from ..sources.tsv import read_value_files, write_value_files
from .registry import QUERIES, ORACLES, query, stored_once, table

# table -> {column: expression}
_n = lambda expression: f"CAST({expression} AS STRING)"
VALUES = {
    "customer": {
        "Owner_First_Name": "CASE WHEN c_nationkey < 20 THEN replace(c_name, '#', ' ') ELSE c_name END",
        "StreetName": f"""CASE c_nationkey % 6 WHEN 0 THEN {_n('c_custkey % 9000 + 1')} || ' ' || c_mktsegment || ' Street'
            WHEN 1 THEN c_mktsegment || ' Avenue.' WHEN 2 THEN 'P.O. Box ' || {_n('c_custkey')}
            WHEN 3 THEN {_n('c_custkey % 100')} || ' ave ' || c_mktsegment WHEN 4 THEN 'place ' || {_n('c_custkey')}
            ELSE c_mktsegment END""",
        "Borough": """CASE c_nationkey % 8 WHEN 0 THEN 'New  York' WHEN 1 THEN ' bay ridge ' WHEN 2 THEN 'Brooklin'
            WHEN 3 THEN 'Q' WHEN 4 THEN 'FLORAL PARK' WHEN 5 THEN 'Croton-on-Hudson' WHEN 6 THEN 'Mariner''s Harbor'
            ELSE c_mktsegment END""",
        "Address": f"""CASE c_nationkey % 6 WHEN 0 THEN {_n('c_custkey % 9000 + 1')} || ' ' || c_mktsegment || ' road'
            WHEN 1 THEN c_mktsegment || ' court' WHEN 2 THEN c_mktsegment || ' university'
            WHEN 3 THEN 'the garden of ' || c_mktsegment WHEN 4 THEN '' ELSE c_mktsegment END""",
    },
    "supplier": {"DBA": "CASE WHEN s_nationkey < 12 THEN replace(s_name, '#', ' ') ELSE s_name END"},
    "orders": {
        "Phone_Number": f"""CASE o_orderstatus WHEN 'O' THEN '(' || lpad({_n('o_custkey % 1000')}, 3, '0') || ') '
                || lpad({_n('o_orderkey % 997')}, 3, '0') || '-' || lpad({_n('o_orderkey % 9973')}, 4, '0')
            WHEN 'F' THEN lpad({_n('o_orderkey')}, 10, '2') ELSE '1 ' || lpad({_n('o_orderkey')}, 10, '2') END""",
        "Incident_Zip": f"""CASE o_orderstatus WHEN 'O' THEN lpad({_n('o_custkey')}, 5, '1')
            WHEN 'F' THEN lpad({_n('o_custkey')}, 5, '1') || '-' || lpad({_n('o_orderkey % 10000')}, 4, '0')
            ELSE {_n('o_custkey')} END""",
        "Location": f"""CASE o_orderstatus WHEN 'O' THEN '(40.' || {_n('o_custkey')} || ', -73.' || {_n('o_orderkey')} || ')'
            WHEN 'F' THEN '(40.' || {_n('o_custkey')} || ')' ELSE '40.7, -73.' || {_n('o_orderkey')} END""",
    },
    "events": {
        "Agency": """CASE event_type WHEN 'view' THEN 'NYPD' WHEN 'click' THEN 'Dept of ' || event_type WHEN 'error' THEN 'dot'
            ELSE event_type END""",
        "PREM_TYP_DESC": "CASE event_type WHEN 'view' THEN 'book store' WHEN 'click' THEN 'BUS STOP' ELSE event_type END",
    },
    "part": {
        "SCHOOL_LEVEL_": f"""CASE p_type WHEN 'ECONOMY' THEN 'Elementary' WHEN 'SMALL' THEN 'K-8' WHEN 'MEDIUM' THEN 'High ' || p_name
            WHEN 'PROMO' THEN 'Middle ' || {_n('p_size')} ELSE p_type END""",
        "School_Name": f"""CASE p_type WHEN 'ECONOMY' THEN p_name || ' academy' WHEN 'SMALL' THEN 'hs ' || {_n('p_size')}
            WHEN 'MEDIUM' THEN p_name || ' scholl' WHEN 'PROMO' THEN 'junior high' ELSE p_name END""",
        "Vehicle_Color": "split_part(p_name, ' ', 1)",
        "Vehicle_Make": """CASE p_type WHEN 'ECONOMY' THEN 'TOYT' WHEN 'SMALL' THEN substr(p_name, 1, 4) WHEN 'MEDIUM' THEN 'sedn'
            WHEN 'PROMO' THEN 'h/wh' ELSE p_name END""",
        "CORE_SUBJECT": f"""CASE p_type WHEN 'ECONOMY' THEN 'Math ' || {_n('p_size')} WHEN 'SMALL' THEN 'Applied Science'
            WHEN 'MEDIUM' THEN p_name WHEN 'PROMO' THEN 'Social Studies' ELSE p_type END""",
        "Building_Classification": f"""CASE p_type WHEN 'ECONOMY' THEN 'R4-' || p_name WHEN 'SMALL' THEN 'aM-' || {_n('p_size')}
            WHEN 'MEDIUM' THEN 'X4-' || p_name ELSE p_brand END""",
        "Park_Name": """CASE p_type WHEN 'ECONOMY' THEN p_name || ' Park' WHEN 'SMALL' THEN p_name || ' school'
            WHEN 'MEDIUM' THEN 'playground ' || p_name ELSE p_name END""",
        "Upcoming_Project_Name": "p_name",
    },
    "pages": {"WEBSITE": "url"},
    "documents": {"Contact_Phone": "phone"},
}

# Tables that are prepared in each engine's own words: every phone number of a text is a row, a text without one an empty row.
_PHONES = "'[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}'"
DUCK_TABLES = {
    "documents": f"""(SELECT unnest(CASE WHEN len(p) = 0 THEN [''] ELSE p END) AS phone
        FROM (SELECT regexp_extract_all(text, {_PHONES}) AS p FROM documents))""",
}
SPARK_TABLES = {
    "documents": lambda df: df.selectExpr(f"regexp_extract_all(text, {_PHONES}, 0) AS p").selectExpr(
        "explode(CASE WHEN size(p) = 0 THEN array('') ELSE p END) AS phone"),
}

# The semantic types each column tries, spelled out for the oracle.
TRIES = {
    "Owner_First_Name": ["Person_name"], "DBA": ["Business_name"], "Phone_Number": ["Phone_Number"],
    "Contact_Phone": ["Phone_Number"], "StreetName": ["Address", "Street_name"], "Agency": ["City_agency"],
    "Borough": ["City", "Neighborhood", "Borough"], "Incident_Zip": ["Zip_code"], "SCHOOL_LEVEL_": ["School_Levels"],
    "School_Name": ["School_name", "School_Levels"], "Vehicle_Color": ["Color"],
    "Vehicle_Make": ["Car_make", "Vehicle_Type"], "CORE_SUBJECT": ["Areas_of_study", "Subjects_in_school"],
    "WEBSITE": ["Websites"], "Building_Classification": ["Building_Classification"],
    "PREM_TYP_DESC": ["Type_of_location"], "Park_Name": ["Parks_Playgrounds", "School_name"],
    "Location": ["LAT_LON_coordinates"],
    "Address": ["Address", "Street_name", "College_University_names", "Parks_Playgrounds"],
    "Upcoming_Project_Name": [],
}


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _rows(words) -> str:
    return "(VALUES " + ", ".join("('" + w.replace("'", "''") + "')" for w in words) + ") AS d(term)"


def _similar(words, value="v") -> str:
    return (f"EXISTS (SELECT 1 FROM {_rows(words)} WHERE 2 * levenshtein(d.term, {value}) "
            f"<= greatest(length(d.term), length({value})))")


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(v, '{w}')" for w in words) + ")"


# Street words and patterns that the predicates must match.
_STREETS = "street|st|avenue|ave|road|rd|highway|hwy|square|sq|trail|trl|drive|dr|court|ct|park|parkway|pkwy|circle|cir|boulevard|blvd"
_SPACED = "trim(regexp_replace(v, '\\s+', ' ', 'g'))"
PREDICATES_SQL = {
    "Person_name": "TRUE",
    "Business_name": "TRUE",
    "Phone_Number": r"regexp_matches(v, '^[^0-9]?[0-9]{3}[^0-9]?[^0-9]?[0-9]{3}[^0-9]?[0-9]{4}$')",
    "Address": rf"(regexp_matches(v, '^[0-9]{{1,4}} [\w\s]{{1,20}}({_STREETS})\W?(\s|$)')"
               rf" OR regexp_matches(v, '^[0-9]{{1,4}} ({_STREETS})\s\w+') OR regexp_matches(v, '^p\.? ?o\.? box [0-9]+'))",
    "Street_name": rf"(regexp_matches(v, '^[\w\s]{{1,20}}({_STREETS}|place)\W?(\s|$)')"
                   rf" OR regexp_matches(v, '^({_STREETS}|place)[\s\w]'))",
    "City_agency": f"(v IN {_list(W.AGENCY_CODES)} OR {_has(W.AGENCY_WORDS)})",
    "City": f"{_SPACED} IN {_list(W.CITIES)}",
    "Neighborhood": f"{_SPACED} IN {_list(W.neighborhoods())}",
    "Borough": _similar(W.BOROUGHS + W.BOROUGH_LETTERS),
    "Zip_code": r"regexp_matches(v, '^[0-9]{5}([-\s][0-9]{4})?$')",
    "School_name": f"EXISTS (SELECT 1 FROM (SELECT unnest(string_split_regex(v, '\\s+')) AS w) WHERE {_similar(W.SCHOOL_WORDS, 'w')})",
    "School_Levels": _has(W.SCHOOL_LEVELS),
    "Color": f"(v IN {_list(W.COLOR_CODES)} OR {_similar(W.COLORS)})",
    "Car_make": _similar(W.CAR_MAKES),
    "Vehicle_Type": _similar(W.VEHICLE_TYPES),
    "Areas_of_study": _has(W.STUDY_AREAS),
    "Subjects_in_school": r"regexp_matches(v, '^[a-z]+ ')",
    "Websites": r"regexp_matches(v, '^(https?://)?(www\.)?([a-z0-9]+(-?[a-z0-9])*\.)+\w{2,}(/\S*)?$')",
    "Building_Classification": "regexp_matches(v, '^[a-wyz][0-9|muwbhrs]-')",
    "Type_of_location": _has(W.LOCATION_WORDS),
    "Parks_Playgrounds": _has(W.PARK_WORDS),
    "LAT_LON_coordinates": r"regexp_matches(v, '^\([+-]?[0-9]+(\.[0-9]*)?, [+-]?[0-9]+(\.[0-9]*)?\)$')",
    "College_University_names": "contains(v, 'university')",
}


def _values_sql(columns) -> str:
    """DuckDB: (column_name, value, v, freq) over distinct values."""
    parts = []
    for name, expressions in VALUES.items():
        for column, expression in expressions.items():
            if column in columns:
                parts.append(f"SELECT '{column}' AS column_name, {expression} AS value, count(*) AS freq FROM {DUCK_TABLES.get(name, name)} GROUP BY ALL")
    return f"""SELECT *, lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) AS v FROM ({' UNION ALL '.join(parts)})"""


def _labels_sql(columns) -> str:
    """DuckDB: (column_name, value, semantic_type, freq)."""
    parts = []
    for column in columns:
        tries = " ".join(f"WHEN {PREDICATES_SQL[kind]} THEN '{kind}'" for kind in TRIES[column])
        parts.append(f"""SELECT column_name, value, freq, CASE WHEN v IN ('', 'na', 'n/a') OR regexp_matches(v, '[|^&+%*#=!>]')
            THEN 'Other' {tries} ELSE 'Other' END AS semantic_type FROM ({_values_sql([column])})""")
    return f"SELECT column_name, value, semantic_type, freq FROM ({' UNION ALL '.join(parts)})"


def column_values(spark, sf_dir, columns=None) -> DataFrame:
    """Distinct values of the composed columns with their frequency, each table read once."""
    frames = []
    for name, expressions in VALUES.items():
        chosen = {c: e for c, e in expressions.items() if columns is None or c in columns}
        if chosen:
            wide = SPARK_TABLES.get(name, lambda df: df)(table(spark, sf_dir, name)).selectExpr(*[f"{e} AS {c}" for c, e in chosen.items()])
            frames.append(wide.unpivot([], list(chosen), "column_name", "value"))
    united = reduce(DataFrame.unionByName, frames)
    return united.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("freq"))


def labelled(spark, sf_dir, columns=None) -> DataFrame:
    """Values are counted first, so a predicate runs once per distinct value."""
    return S.label_values(column_values(spark, sf_dir, columns))


def _register_route(name, *columns):
    def run(spark, sf_dir):
        return labelled(spark, sf_dir, columns)

    run.__doc__ = f"Labels of the distinct values of {', '.join(columns)}."
    QUERIES[name] = run
    ORACLES[name] = _labels_sql(columns)


for _name, _columns in {
    "semantic_person": ["Owner_First_Name"],
    "semantic_business": ["DBA"],
    "semantic_phone": ["Phone_Number", "Contact_Phone"],
    "semantic_street": ["StreetName"],
    "semantic_agency": ["Agency"],
    "semantic_place": ["Borough"],
    "semantic_zip": ["Incident_Zip"],
    "semantic_school": ["SCHOOL_LEVEL_", "School_Name"],
    "semantic_color": ["Vehicle_Color"],
    "semantic_vehicle": ["Vehicle_Make"],
    "semantic_study": ["CORE_SUBJECT"],
    "semantic_website": ["WEBSITE"],
    "semantic_building": ["Building_Classification"],
    "semantic_location_type": ["PREM_TYP_DESC"],
    "semantic_park": ["Park_Name"],
    "semantic_latlon": ["Location"],
    "semantic_address": ["Address"],
}.items():
    _register_route(_name, *_columns)

LABEL_COUNTS = f"""SELECT column_name, semantic_type, CAST(sum(freq) AS BIGINT) AS count FROM ({_labels_sql(TRIES)}) GROUP BY ALL"""
NESTED = f"""SELECT column_name, string_agg(semantic_type || '=' || CAST(count AS VARCHAR), '|' ORDER BY semantic_type) AS semantic_types
    FROM ({LABEL_COUNTS}) GROUP BY ALL"""


@query(LABEL_COUNTS)
def semantic_labels(spark, sf_dir):
    return S.label_counts(labelled(spark, sf_dir))


def stored_labels(spark, sf_dir) -> DataFrame:
    """The label documents of all columns: value files written, read by their names, labelled, nested and stored as JSON.

    Empty values stand in the files as nulls; one file has no counts. Written anew when a table has changed.
    """
    def store(folder: str) -> None:
        values = column_values(spark, sf_dir).withColumn("value", F.nullif("value", F.lit("")))
        write_value_files(values, f"{folder}/values", "abcd-1234", without_counts=["WEBSITE"])
        counted = S.label_counts(S.label_values(read_value_files(spark, f"{folder}/values")))
        results.write_labels(S.nest_labels(counted), f"{folder}/labels")

    folder = stored_once(spark, sf_dir, "semantic", VALUES, store)
    stored = results.read_labels(spark, f"{folder}/labels")
    return stored.withColumn("column_name", F.split_part("column_name", F.lit("."), F.lit(2)))


def stored_label_counts(spark, sf_dir) -> DataFrame:
    return stored_labels(spark, sf_dir).select("column_name", F.inline("semantic_types"))


@query(NESTED)
def semantic_nested(spark, sf_dir):
    entry = lambda e: F.concat(e["semantic_type"], F.lit("="), e["count"].cast("string"))
    back = stored_labels(spark, sf_dir)
    return back.select("column_name", F.array_join(F.transform("semantic_types", entry), "|").alias("semantic_types"))


@query(f"""
    WITH item AS (SELECT column_name AS key, '{{"column_name":"' || column_name || '","semantic_types":['
            || string_agg('{{"semantic_type":"' || semantic_type || '","count":' || CAST(count AS VARCHAR) || '}}', ',' ORDER BY semantic_type)
            || ']}}' AS line FROM ({LABEL_COUNTS}) GROUP BY column_name)
    SELECT 1 AS section, key, CASE WHEN key = (SELECT min(key) FROM item) THEN '' ELSE ',' END || line AS line FROM item
    UNION ALL SELECT 0, '', '{{"predicted_types":[' UNION ALL SELECT 2, '', ']}}'""")
def combined_document(spark, sf_dir):
    """The stored label documents, in full, as the lines of one document."""
    return results.combined_document(stored_labels(spark, sf_dir), "column_name", "predicted_types")


def _route_sql(key: str) -> str:
    tests = [
        ("person", "first last person".split(), ["mi"]), ("business", "dba businessname".split(), []),
        ("phone", "number phone".split(), []), ("street", ["street"], []), ("agency", ["agency"], []),
        ("place", "city neighborhood boro".split(), []), ("zip", ["zip"], []), ("school_level", ["schoollevel"], []),
        ("school", ["school"], []), ("color", ["color"], []), ("vehicle", "make vehicle".split(), []),
        ("study", "core interest".split(), []), ("website", ["website"], []), ("building", ["classification"], []),
        ("location_type", ["typdesc"], []), ("park", "park orgname".split(), []), ("latlon", "location latlon".split(), []),
        ("address", ["address"], []),
    ]
    when = " ".join(
        "WHEN " + " OR ".join([f"{key} LIKE '%{p}%'" for p in parts] + [f"{key} = '{e}'" for e in exact]) + f" THEN '{name}'"
        for name, parts, exact in tests
    )
    return f"CASE {when} ELSE 'other' END"


# File names made of ids and words of the part table, one column name per route and size.
ROUTE_NAMES = [
    "Owner_First_Name", "MI", "CAND_MI", "DBA", "House_Number", "Cross_Street_1", "Agency_ID", "BORO", "Incident_Zip", "SCHOOL_LEVEL_",
    "School_Type", "Vehicle_Color", "DVC_MAKE", "CORE_SUBJECT", "interest4", "Org_Website", "Building_Classification",
    "PREM_TYP_DESC", "Park_Site_Name", "Org_Name", "Location_1", "Lat_Lon", "Vendor_Address", "Landmark",
]
_FILE = (
    "lpad(CAST(p_partkey AS STRING), 9, '0') || '.' || split_part(p_name, ' ', 1) || '_' || CASE p_size % 24 "
    + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(ROUTE_NAMES)) + " END || '.txt.gz'"
)


@query(f"""SELECT file_name, column_name, key, {_route_sql('key')} AS route FROM (
    SELECT *, lower(replace(split_part(column_name, '.', 2), '_', '')) AS key FROM (
        SELECT *, replace(file_name, '.txt.gz', '') AS column_name FROM (SELECT {_FILE} AS file_name FROM part)))""")
def column_route(spark, sf_dir):
    files = table(spark, sf_dir, "part").selectExpr(f"{_FILE} AS file_name")
    named = files.withColumn("column_name", R.column_of_file(F.col("file_name")))
    keyed = named.withColumn("key", R.route_key(F.col("column_name")))
    return keyed.withColumn("route", R.route_of(F.col("key")))


# Dictionaries as tables: the words the part table shares, and the literal lists.
@query("SELECT DISTINCT p_partkey, word AS value FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) "
       "WHERE word IN (SELECT DISTINCT split_part(p_name, ' ', 1) FROM part WHERE p_size < 25)")
def dict_exact_match(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    words = parts.select("p_partkey", F.explode(F.split("p_name", " ")).alias("value")).distinct()
    terms = parts.filter("p_size < 25").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term"))
    return D.match_exact(words, terms)


@query(f"SELECT value, freq, {_similar(W.COLORS, 'value')} AS is_color, {_similar(W.CAR_MAKES, 'value')} AS is_make FROM ("
       "SELECT value, count(*) AS freq FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY ALL)")
def dict_fuzzy_match(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("value"))
    counted = words.groupBy("value").agg(F.count(F.lit(1)).alias("freq"))
    return counted.withColumn("is_color", P.similar_to(W.COLORS)(F.col("value"))).withColumn(
        "is_make", P.similar_to(W.CAR_MAKES)(F.col("value")))


@query(f"SELECT doc_id, {_has(W.LOCATION_WORDS)} AS has_location, {_has(W.STUDY_AREAS)} AS has_study FROM "
       "(SELECT doc_id, lower(text) AS v FROM documents)")
def dict_keyword_match(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("v"))
    return texts.select(
        "doc_id", P.contains_any(W.LOCATION_WORDS)(F.col("v")).alias("has_location"),
        P.contains_any(W.STUDY_AREAS)(F.col("v")).alias("has_study"),
    )


# Dictionaries of any size, as tables: words of other tables.
_WORDS_OF = "SELECT DISTINCT unnest(regexp_extract_all(lower({1}), '[a-z]{{{2},}}')) AS term FROM {0}"
KEYWORDS = [("benchmark", "text", 5), ("conversations", "text", 7), ("part", "p_name", 3), ("events", "event_type", 4)]


def _words(spark, sf_dir, name, column, least) -> DataFrame:
    found = F.regexp_extract_all(F.lower(column), F.lit(f"[a-z]{{{least},}}"), 0)
    return table(spark, sf_dir, name).select(F.explode(found).alias("term")).distinct()


@query(f"""SELECT doc_id, count(term) AS n_terms, min(term) AS first_term FROM documents LEFT JOIN (
    {' UNION '.join(_WORDS_OF.format(*k) for k in KEYWORDS)}) ON contains(lower(text), term) GROUP BY doc_id""")
def dict_keyword_table(spark, sf_dir):
    """How many terms of a dictionary that is a table each document contains."""
    terms = reduce(DataFrame.unionByName, [_words(spark, sf_dir, *k) for k in KEYWORDS])
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("value"))
    hits = D.keyword_hits(texts, terms, key="doc_id")
    every = texts.select("doc_id", F.lit(None).cast("string").alias("term")).unionByName(hits)
    return every.groupBy("doc_id").agg(F.count("term").alias("n_terms"), F.min("term").alias("first_term"))


@query(f"""
    WITH words AS ({_WORDS_OF.format('benchmark', 'text', 1)}), talk AS ({_WORDS_OF.format('conversations', 'text', 4)}),
    names AS ({_WORDS_OF.format('part', 'p_name', 1)}),
    close AS (SELECT w.term AS value, count(*) AS n_close, min(t.term) AS first_close FROM words w JOIN talk t
        ON abs(length(w.term) - length(t.term)) <= 4 AND 1 - levenshtein(w.term, t.term) / greatest(length(w.term), length(t.term)) >= 0.8 - 1e-9 GROUP BY ALL)
    SELECT w.term AS value, coalesce(n_close, 0) AS n_close, first_close,
        EXISTS (SELECT 1 FROM names n WHERE 2 * levenshtein(w.term, n.term) <= greatest(length(w.term), length(n.term))) AS like_name
    FROM words w LEFT JOIN close c ON c.value = w.term""")
def dict_fuzzy_table(spark, sf_dir):
    """The benchmark's words against two dictionaries that are tables: how many terms are 0.8 similar, and whether one is 0.5 similar."""
    words = _words(spark, sf_dir, "benchmark", "text", 1).withColumnRenamed("term", "value")
    close = D.similar_terms(words, _words(spark, sf_dir, "conversations", "text", 4), 0.8)
    close = close.groupBy("value").agg(F.count(F.lit(1)).alias("n_close"), F.min("term").alias("first_close"))
    like = D.match_similar(words, _words(spark, sf_dir, "part", "p_name", 1), 0.5).select("value", F.lit(True).alias("like_name"))
    found = words.join(close, "value", "left").join(like, "value", "left")
    return found.select("value", F.coalesce("n_close", F.lit(0)).alias("n_close"), "first_close", F.coalesce("like_name", F.lit(False)).alias("like_name"))


@query("SELECT DISTINCT lower(term) AS term FROM (SELECT c_mktsegment AS term FROM customer UNION ALL SELECT p_type FROM part "
       "UNION ALL SELECT p_name FROM part UNION ALL SELECT event_type FROM events UNION ALL SELECT o_orderpriority FROM orders)")
def dictionary_union(spark, sf_dir):
    sources = [("customer", "c_mktsegment"), ("part", "p_type"), ("part", "p_name"), ("events", "event_type"),
               ("orders", "o_orderpriority")]
    return D.dictionary_union(*[table(spark, sf_dir, t).select(F.col(c).alias("term")) for t, c in sources])


# Evaluation: manual labels from the labels table, predictions by two rules on document length.
MANUAL = """SELECT CAST(doc_id AS VARCHAR) AS column_name, 'good' AS semantic_type FROM labels WHERE quality = 1
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'toxic' FROM labels WHERE toxic = 1
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'Other' FROM labels WHERE quality = 0 AND toxic = 0"""
EVALUATED = ["good", "toxic", "Other", "unseen"]
RULES = {"first": (900, 2500), "second": (1500, 1800)}


def _predicted_sql(rule: str) -> str:
    short, long = RULES[rule]
    return f"""SELECT CAST(doc_id AS VARCHAR) AS column_name, CASE WHEN n_chars > {long} THEN 'good' WHEN n_chars < {short} THEN 'toxic'
        ELSE 'Other' END AS semantic_type FROM documents
        UNION ALL SELECT CAST(doc_id AS VARCHAR), 'toxic' FROM documents WHERE lang <> 'en' AND n_chars >= {short}"""


def _predicted(spark, sf_dir, rule) -> DataFrame:
    short, long = RULES[rule]
    kinds = F.array(
        F.when(F.col("n_chars") > long, "good").when(F.col("n_chars") < short, "toxic").otherwise("Other"),
        F.when((F.col("lang") != "en") & (F.col("n_chars") >= short), "toxic"),
    )
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("column_name"), F.explode(kinds).alias("semantic_type")
    )
    return documents.filter("semantic_type IS NOT NULL")


def _manual_documents(spark, sf_dir) -> DataFrame:
    """The labels table as manual-label records, one per document."""
    label = lambda test, name: F.when(test, F.struct(F.lit(name).alias("semantic_type")))
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    found = F.array_compact(F.array(label(good, "good"), label(toxic, "toxic"), label(~good & ~toxic, "Other")))
    return table(spark, sf_dir, "labels").select(
        F.array(F.struct(F.col("doc_id").cast("string").alias("column_name"), found.alias("manual_labels"))).alias("actual_types")
    )


def _manual(spark, sf_dir) -> DataFrame:
    return M.flatten_manual_labels(_manual_documents(spark, sf_dir))


def _rates_sql_of(predicted: str, manual: str, types) -> str:
    listed = ", ".join(f"({i}, '{t}')" for i, t in enumerate(types))
    return f"""
        SELECT t.type_pos, t.semantic_type, coalesce(m.n, 0) AS match, coalesce(p.n, 0) AS pred, coalesce(h.n, 0) AS manual,
            coalesce(m.n / p.n, 0.0) AS precision, coalesce(m.n / h.n, 0.0) AS recall
        FROM (VALUES {listed}) AS t(type_pos, semantic_type)
        LEFT JOIN (SELECT semantic_type, count(*) AS n FROM (SELECT DISTINCT * FROM ({predicted})) p
            WHERE EXISTS (SELECT 1 FROM ({manual}) h WHERE h.column_name = p.column_name AND h.semantic_type = p.semantic_type)
            GROUP BY ALL) m USING (semantic_type)
        LEFT JOIN (SELECT semantic_type, count(*) AS n FROM (SELECT DISTINCT * FROM ({predicted}))
            WHERE column_name IN (SELECT column_name FROM ({manual})) GROUP BY ALL) p USING (semantic_type)
        LEFT JOIN (SELECT semantic_type, count(*) AS n FROM ({manual}) GROUP BY ALL) h USING (semantic_type)"""


def _rates_sql(rule: str) -> str:
    return _rates_sql_of(_predicted_sql(rule), MANUAL, EVALUATED)


def _rates(spark, sf_dir, rule) -> DataFrame:
    return E.precision_recall(_predicted(spark, sf_dir, rule), _manual(spark, sf_dir), EVALUATED)


@query(MANUAL)
def manual_labels_flat(spark, sf_dir):
    """The labels written as manual-label documents of many lines, some thousand columns each, and read back."""
    folder = os.path.join(results.scratch_folder(spark), f"manual-{os.urandom(8).hex()}")
    single = _manual_documents(spark, sf_dir)
    number = F.pmod(F.xxhash64(F.col("actual_types")[0]["column_name"]), F.lit(max(1, -(-single.count() // 2000))))
    documents = single.groupBy(number.alias("document")).agg(F.flatten(F.collect_list("actual_types")).alias("actual_types"))
    text = F.to_json(F.struct("actual_types"), {"pretty": "true"})
    documents.select("document", text.alias("text")).repartition("document").write.partitionBy("document").text(folder)
    return M.read_manual_labels(spark, f"{folder}/*")


@query(f"""SELECT DISTINCT p.column_name, p.semantic_type FROM ({_predicted_sql('first')}) p JOIN ({MANUAL}) h
    ON h.column_name = p.column_name AND h.semantic_type = p.semantic_type""")
def label_matches(spark, sf_dir):
    return E.label_matches(_predicted(spark, sf_dir, "first"), _manual(spark, sf_dir))


@query(f"SELECT DISTINCT column_name FROM ({_predicted_sql('first')}) WHERE column_name NOT IN (SELECT column_name FROM ({MANUAL}))")
def unlabelled_columns(spark, sf_dir):
    return E.unlabelled_columns(_predicted(spark, sf_dir, "first"), _manual(spark, sf_dir))


@query(f"SELECT semantic_type, match, pred, manual, round(precision, 6) AS precision, round(recall, 6) AS recall FROM ({_rates_sql('first')})")
def precision_recall(spark, sf_dir):
    rates = _rates(spark, sf_dir, "first").drop("type_pos")
    return rates.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


# Manual labels of the composed columns: the first type that each tries, and Other where a table has many odd values.
CASCADE_MANUAL = [(c, kinds[0] if kinds else "Other") for c, kinds in TRIES.items()] + [("Borough", "Other"), ("Address", "Other")]
_CASCADE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in CASCADE_MANUAL) + ") AS m(column_name, semantic_type)"


@query("SELECT semantic_type, match, pred, manual, round(precision, 6) AS precision, round(recall, 6) AS recall FROM ("
       + _rates_sql_of(f"SELECT column_name, semantic_type FROM ({LABEL_COUNTS})", _CASCADE_SQL, R.SEMANTIC_TYPES) + ")")
def cascade_precision_recall(spark, sf_dir):
    """Precision and recall of the stored labels of all columns, for the whole list of types."""
    manual = spark.createDataFrame(CASCADE_MANUAL, "column_name string, semantic_type string")
    predicted = stored_label_counts(spark, sf_dir).select("column_name", "semantic_type")
    rates = E.precision_recall(predicted, manual, R.SEMANTIC_TYPES).drop("type_pos")
    return rates.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


def _macro(measure: str) -> str:
    return f"""SELECT '{measure}' AS measure, round(avg(a.{measure}), 6) AS first, round(avg(b.{measure}), 6) AS second,
        round(avg(b.{measure} - a.{measure}), 6) AS change FROM ({_rates_sql('first')}) a JOIN ({_rates_sql('second')}) b USING (semantic_type)"""


@query(_macro("precision") + " UNION ALL " + _macro("recall"))
def macro_average_delta(spark, sf_dir):
    delta = E.macro_average_delta(_rates(spark, sf_dir, "first"), _rates(spark, sf_dir, "second"))
    return delta.select("measure", *[F.round(c, 6).alias(c) for c in ("first", "second", "change")])


@query(" UNION ALL ".join(
    f"""SELECT a.type_pos, a.semantic_type, '{m}' AS measure, round(a.{m}, 6) AS first, round(b.{m}, 6) AS second
    FROM ({_rates_sql('first')}) a JOIN ({_rates_sql('second')}) b USING (semantic_type)""" for m in ("precision", "recall")))
def run_comparison(spark, sf_dir):
    series = E.run_comparison(_rates(spark, sf_dir, "first"), _rates(spark, sf_dir, "second"))
    return series.select("type_pos", "semantic_type", "measure", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"))


LABELS_PER_COLUMN = f"SELECT column_name, count(*) AS n_types FROM ({LABEL_COUNTS}) GROUP BY ALL"


@query(LABELS_PER_COLUMN)
def labels_per_column(spark, sf_dir):
    return Q.labels_per_column(stored_label_counts(spark, sf_dir))


@query(f"SELECT n_types, count(*) AS n_columns FROM ({LABELS_PER_COLUMN}) GROUP BY ALL")
def heterogeneity(spark, sf_dir):
    return Q.heterogeneity(Q.labels_per_column(stored_label_counts(spark, sf_dir)))
