import os
import re

import pytest
from pyspark.sql import functions as F

from colprism.functions import predicates as P, routing as R, terms as W
from colprism.functions.text import collapse_spaces, is_junk, normal_case, normalize_value, similarity
from colprism.operators import dictionaries as D, semantic as S

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

TRUE_FALSE = {
    "Phone_Number": (["212-555-0100", "(212) 555-0100", "2125550100", "212.555.0100"], ["1 212 555 0100", "555-0100"]),
    "Address": (["12 main street", "55 ave b", "p.o. box 12", "po box 7", "7 elm st."], ["123 broadway", "main street", "12345 main street"]),
    "Street_name": (["main street", "avenue of x", "place des x", "street "], ["st. mark's place", "broadway", "5th"]),
    "Zip_code": (["10001", "10001-1234", "10001 1234"], ["1000", "100011"]),
    "Websites": (["http://a.com", "www.a-b.com/x", "foo.bar", "nyc.gov/"], ["a..b", "a", "-a.com", "http://a b.com"]),
    "Building_Classification": (["r4-x", "a|-z", "d3-elevator"], ["x4-a", "r4", "rz-x"]),
    "Subjects_in_school": (["english 10", "math a"], ["math", "10 english"]),
    "LAT_LON_coordinates": (["(40.7, -73.9)", "(1e2, .5)", "(inf, nan)"], ["40.7, -73.9", "(40.7)", "(1, 2, 3)", "()", "(40.7,-73.9)"]),
    "City": (["new   york", "croton-on-hudson", "floral park"], ["brooklyn", "new yorkk"]),
    "Neighborhood": (["bay ridge", "soho", "mariner's harbor", "harlem (central)"], ["harlem"]),
    "Borough": (["brooklin", "brooklyn", "q", "manhatan"], ["new jersey", "the bronx river parkway"]),
    "School_name": (["ps 1 academy", "hs 5", "john scholl"], ["playground"]),
    "School_Levels": (["k-3", "elementary", "senior high"], ["adult"]),
    "Color": (["bk", "red", "gren", "grey"], ["transparent", "xyz"]),
    "Car_make": (["toyt", "ford", "toyo"], ["bicycle company"]),
    "Vehicle_Type": (["sedn", "h/wh", "4dsd"], ["wheelbarrows"]),
    "City_agency": (["311", "nypd", "dept of x", "city hall"], ["police"]),
    "Areas_of_study": (["applied science", "martial arts"], ["law"]),
    "Type_of_location": (["book store", "bus stop"], ["field"]),
    "Parks_Playgrounds": (["central park", "garden"], ["school"]),
    "College_University_names": (["new york university"], ["college"]),
    "Person_name": (["x"], []),
    "Business_name": (["x"], []),
}


@pytest.mark.parametrize("kind", sorted(TRUE_FALSE))
def test_predicate(spark, kind):
    good, bad = TRUE_FALSE[kind]
    frame = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
    got = frame.withColumn("got", P.build()[kind](F.col("v"))).filter("got <> want").collect()
    assert got == []


def test_every_type_has_a_predicate():
    assert set(P.build()) | {R.OTHER} == set(R.SEMANTIC_TYPES)


def test_sizes_of_the_word_lists():
    assert len(set(W.CITIES)) == 200 and len(W.neighborhoods()) == 324 and len(W.CAR_MAKES) == 119
    assert [len(v) for v in W.NEIGHBORHOODS_BY_BOROUGH.values()] == [77, 56, 45, 85, 66]
    assert (len(W.VEHICLE_TYPES), len(W.AGENCY_CODES), len(W.STUDY_AREAS), len(W.LOCATION_WORDS)) == (58, 46, 18, 22)


def test_own_lists_and_threshold(spark):
    own = P.build(threshold=0.8, cities=["Paris"])
    row = spark.range(1).select(
        own["City"](F.lit("paris")), own["City"](F.lit("new york")), own["Borough"](F.lit("brooklin")), own["Borough"](F.lit("brook")),
    ).first()
    assert tuple(row) == (True, False, True, False)
    with pytest.raises(ValueError):
        P.build(towns=["x"])


def test_junk(spark):
    frame = spark.createDataFrame([("",), ("na",), ("n/a",), ("a&b",), ("a,b",), ("a=b",), ("x\ny=z",)], "v string")
    got = {r.v: r.j for r in frame.select("v", is_junk(F.col("v")).alias("j")).collect()}
    assert got == {"": True, "na": True, "n/a": True, "a&b": True, "a,b": False, "a=b": True, "x\ny=z": False}


def test_text_helpers(spark):
    row = spark.range(1).select(
        normalize_value(F.lit("\t  AbC\n")), normal_case(F.lit("  nEW   yORK ")), collapse_spaces(F.lit(" a \t b ")),
        similarity(F.lit("brooklin"), F.lit("brooklyn")),
    ).first()
    assert tuple(row) == ("abc", "New York", "a b", 0.875)


def golden_routes():
    """route number -> keys, from the table in FIXTURES.md."""
    text = open(os.path.join(ROOT, "FIXTURES.md")).read()
    for number, keys in re.findall(r"^\| RT-(\d+) \| \d+ \| (.*) \|$", text, re.M):
        for key in re.findall(r"`([^`]+)`", keys):
            yield int(number), key


def test_routes(spark):
    names = [r.name for r in R.ROUTES] + [R.NO_ROUTE]
    golden = [(key, names[number - 1]) for number, key in golden_routes()]
    golden = [(key, "latlon" if key == "latlon" else route) for key, route in golden]
    assert len(golden) == 133
    frame = spark.createDataFrame(golden, "key string, want string")
    assert frame.withColumn("got", R.route_of(F.col("key"))).filter("got <> want").collect() == []


def test_route_key(spark):
    frame = spark.createDataFrame([("5694-9szk.Business_Website.txt.gz",), ("Lat_Lon",)], "f string")
    got = frame.select(R.route_key(R.column_of_file(F.col("f"))).alias("k")).collect()
    assert [r.k for r in got] == ["businesswebsite", "latlon"]


def test_labels(spark):
    rows = [
        ("a.Color", "RED", 3), ("a.Color", None, 2), ("a.Color", "a=b", 1), ("a.Color", "zzzzzz", 4),
        ("b.BORO", " new  york ", 1), ("b.BORO", "Floral Park", 1), ("b.BORO", "Bay Ridge", 5), ("c.Unknown", "red", 7),
    ]
    frame = spark.createDataFrame(rows, "column_name string, value string, freq long")
    counts = S.label_counts(S.label_values(frame))
    assert {(r.column_name, r.semantic_type): r["count"] for r in counts.collect()} == {
        ("a.Color", "Color"): 3, ("a.Color", "Other"): 7, ("b.BORO", "City"): 2, ("b.BORO", "Neighborhood"): 5, ("c.Unknown", "Other"): 7}
    nested = {r.column_name: [tuple(e) for e in r.semantic_types] for r in S.nest_labels(counts).collect()}
    assert nested["a.Color"] == [("Color", 3), ("Other", 7)]


def test_own_type(spark):
    predicates = P.build() | {"Even": lambda value: value.rlike("[02468]$")}
    routes = [R.Route("even", ("Even",), ("num",))] + R.ROUTES
    frame = spark.createDataFrame([("x.num", "12"), ("x.num", "13")], "column_name string, value string")
    got = {r.value: r.semantic_type for r in S.label_values(frame, routes, predicates).collect()}
    assert got == {"12": "Even", "13": "Other"}


def test_dictionaries(spark):
    values = spark.createDataFrame([("a",), ("b",), ("a",)], "value string")
    terms = spark.createDataFrame([("a",), ("a",)], "term string")
    assert [r.value for r in D.match_exact(values, terms).collect()] == ["a", "a"]
    union = D.dictionary_union(terms, spark.createDataFrame([(" A ",), ("B  c",)], "term string"))
    assert sorted(r.term for r in union.collect()) == ["a", "b c"]


def test_many_terms(spark):
    """Any number of literal terms: exact, keyword and fuzzy."""
    terms = [f"term{i:05d}" for i in range(2500)]
    values = spark.createDataFrame([("term02400",), ("has term01234 inside",), ("term99x99",), ("zzz",)], "v string")
    v = F.col("v")
    got = values.select("v", P.one_of(terms)(v), P.contains_any(terms)(v), P.contains_any(terms[:40] + ["term01234"])(v), P.similar_to(terms)(v)).collect()
    assert [tuple(r) for r in got] == [
        ("term02400", True, True, False, True), ("has term01234 inside", False, True, True, False),
        ("term99x99", False, False, False, True), ("zzz", False, False, False, False)]
