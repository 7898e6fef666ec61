from colprism.functions.detect import DATETIME, INTEGER, REAL, TEXT
from colprism.operators import typing as Y
from colprism.operators.cells import cells

# text, type
CASES = [
    ("0", INTEGER), ("123", INTEGER), ("+12", INTEGER), ("-5", INTEGER),
    ("1,234", INTEGER), ("12,34", TEXT), (".5", REAL), ("5.", REAL), ("00.5", REAL),
    ("1,234.56", REAL), ("1e5", TEXT), ("10001-1234", TEXT), ("212-555-0100", TEXT),
    ("00", TEXT), ("N", TEXT), ("007", TEXT), ("0123", TEXT), ("May", TEXT),
    ("Friday", TEXT), ("3 PM", TEXT), ("5-10", TEXT), ("1.5.6", TEXT),
    (" 123", TEXT), ("01/02/2017", DATETIME), ("2017-01-02T03:04:05.000Z", DATETIME),
    ("12:30", DATETIME), ("Jan 2016", DATETIME), ("13/13/2013", TEXT), ("2016-17", TEXT),
    ("0830A", DATETIME), ("1235P", DATETIME), ("0030A", TEXT), ("", TEXT), ("  ", TEXT),
    ("Jan 5, 2017 3:04 PM", DATETIME), ("5-Jan-99", DATETIME), ("2017-02-30", TEXT),
    ("13:04 PM", TEXT), (" \t", TEXT),
]


def detected(spark, texts, **options):
    rows = Y.typed(cells(spark.createDataFrame([(t,) for t in texts], "v string")), **options).collect()
    return {row["value"]: row for row in rows}


def test_strict(spark):
    found = detected(spark, [c[0] for c in CASES])
    assert {t: found[t]["type"] for t, _ in CASES} == dict(CASES)


def test_moments(spark):
    want = {
        "01/02/2017": "2017-01-02 00:00:00", "13/01/2017": "2017-01-13 00:00:00", "12:30": "1900-01-01 12:30:00",
        "0830A": "1900-01-01 08:30:00", "1235P": "1900-01-01 12:35:00", "Jan 5, 2017 3:04 PM": "2017-01-05 15:04:00",
        "2017-01-02T03:04:05.250Z": "2017-01-02 03:04:05.250000", "2017-01-02 03:04:05 +02:00": "2017-01-02 03:04:05",
        "5-Jan-99": "1999-01-05 00:00:00", "12:00 AM": "1900-01-01 00:00:00", "2017-01-02T03:04:59.9999999": "2017-01-02 03:04:59.999999",
    }
    found = detected(spark, list(want))
    assert {t: str(found[t]["moment"]) for t in want} == want


def test_numbers(spark):
    found = detected(spark, ["1,234.56", "-1,000", "5.", "+.5"])
    assert {t: r["number"] for t, r in found.items()} == {"1,234.56": 1234.56, "-1,000": -1000.0, "5.": 5.0, "+.5": 0.5}


def test_blank_cells(spark):
    assert detected(spark, ["  "])["  "]["length"] == 0
    assert detected(spark, ["  "], empty_as_text=False)["  "]["type"] == Y.UNTYPED
