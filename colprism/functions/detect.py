"""Detection of the data type of one cell text.

Order: integer, integer with thousands commas, real, real with commas,
date or time, clock (``0830A``), text.  Texts are not trimmed for numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import strip

INTEGER, REAL, DATETIME, TEXT = "INTEGER(LONG)", "REAL", "DATE/TIME", "TEXT"
TYPES = [INTEGER, REAL, DATETIME, TEXT]

# The number shapes, without and with thousands commas.
INTEGER_SHAPE = r"^[+-]?(?:[1-9]\d*|0|[1-9]\d{0,2}(?:,\d{3})*)$"
REAL_SHAPE = r"^[+-]?(?:\d+\.\d*|\d*\.\d+|[1-9]\d{0,2}(?:,\d{3})*\.\d*)$"

# Date and time shapes of the strict mode.
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,9})?))? ?([ap]m)?"
_WEEKDAY = r"(?:(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? +)?"
_ZONE = r"(?: ?(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?"
_TAIL = rf"(?:(?: +|t){_CLOCK}{_ZONE})?$"
# shape -> replacement that spells year|month|day|hour|minute|second|half
_DATE_SHAPES = [
    (rf"(?i)^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}}){_TAIL}", "$1|$2|$3|$4|$5|$6|$7"),
    (rf"(?i)^(\d{{1,2}})[-/](\d{{1,2}})[-/](\d{{4}}|\d{{2}}){_TAIL}", "$3|$1|$2|$4|$5|$6|$7"),
    (rf"(?i)^{_WEEKDAY}{_MONTH}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_TAIL}", "$3|$1|$2|$4|$5|$6|$7"),
    (rf"(?i)^{_WEEKDAY}(\d{{1,2}})[ -]{_MONTH}\.?[ ,-]+(\d{{4}}|\d{{2}}){_TAIL}", "$3|$2|$1|$4|$5|$6|$7"),
    (rf"(?i)^{_MONTH}\.?,? (\d{{4}})$", "$2|$1|1||||"),
    (rf"(?i)^{_CLOCK}{_ZONE}$", "1900|1|1|$1|$2|$3|$4"),
]
_CLOCK_CODE = (r"(?i)^(1[0-2]|0[1-9]|[1-9])([0-5]\d|\d)([ap])$", "1900|1|1|$1|$2||$3")
TWO_DIGIT_YEAR_PIVOT = 69


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value bound to a name; null for a null value.

    For rare and bulky expressions: they occur once in the plan and stay out
    of the code generated for every row.
    """
    return F.get(F.transform(F.when(value.isNotNull(), F.array(value)), body), F.lit(0))


def _spelled(text: Column, shapes) -> Column:
    """year|month|day|hour|minute|second|half by the first shape that fits, else null."""
    return reduce(
        lambda rest, shape: F.when(text.rlike(shape[0]), F.regexp_replace(text, *shape)).otherwise(rest),
        reversed(shapes),
        F.lit(None).cast("string"),
    )


def shaped_timestamp(value: Column) -> Column:
    """Timestamp of a text in one of the listed shapes, else null.

    A cheap gate keeps words and prose away from the shapes.
    """
    date_like = value.rlike(r"\d[-/: ,]|\d[a-zA-Z]|[a-zA-Z] \d")
    spell = lambda text: F.coalesce(_let(strip(text), lambda t: _spelled(t, _DATE_SHAPES)), _spelled(text, [_CLOCK_CODE]))
    return F.when(date_like, _let(value, lambda text: _let(F.split(spell(text), r"\|"), _timestamp)))


def _timestamp(parts: Column) -> Column:
    piece = lambda i: F.get(parts, F.lit(i))
    number = lambda i: piece(i).try_cast("int")
    or_zero = lambda i, kind: F.when(piece(i) == "", F.lit(0).cast(kind)).otherwise(piece(i).try_cast(kind))
    century = F.when(F.length(piece(0)) > 2, 0).when(number(0) < TWO_DIGIT_YEAR_PIVOT, 2000).otherwise(1900)
    year = number(0) + century
    named = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.left(piece(1), F.lit(3))))
    month, day = F.coalesce(number(1), named.cast("int")), number(2)
    # Month first, unless only the other order makes a date.
    swap = (month > 12) & (day <= 12)
    half, hour = F.lower(F.left(piece(6), F.lit(1))), or_zero(3, "int")
    hour = (
        F.when(half == "", hour)
        .when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    )
    return F.try_make_timestamp_ntz(
        year,
        F.when(swap, day).otherwise(month),
        F.when(swap, month).otherwise(day),
        hour,
        or_zero(4, "int"),
        # Microseconds: further digits are cut off.
        F.when(piece(5) == "", F.lit(0).cast("decimal(16,6)")).otherwise(F.left(piece(5), F.lit(9)).try_cast("decimal(16,6)")),
    )


def without_commas(value: Column) -> Column:
    return F.translate(value, ",", "")


def number_tag(value: Column) -> Column:
    """INTEGER or REAL for a number text, else null; the shapes begin with a digit, a sign or a point, all between + and 9."""
    shaped = F.when(value.rlike(INTEGER_SHAPE), F.lit(INTEGER)).when(value.rlike(REAL_SHAPE), F.lit(REAL))
    return F.when((value >= "+") & (value < ":"), shaped)
