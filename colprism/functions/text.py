"""Text helpers as native column expressions.

White space means what a Unicode-aware ``strip`` removes, not only the blank.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"[\s\x1c-\x1f]"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(value: Column) -> Column:
    """True for a text that is empty or holds only white space; one that begins with a visible character of ASCII is not searched."""
    return F.when((value >= "!") & (value < "\x7f"), F.lit(False)).otherwise(~value.rlike(r"(?U)[^\s\x1c-\x1f]"))


def collapse_spaces(value: Column) -> Column:
    return F.regexp_replace(strip(value), rf"(?U){SPACE}+", " ")


def normalize_value(value: Column) -> Column:
    """Stripped and lower-cased: the form all semantic predicates work on."""
    return F.lower(strip(value))


def normal_case(value: Column) -> Column:
    """Every word capitalised, words separated by one blank."""
    return F.initcap(collapse_spaces(value))


def similarity(left: Column, right: Column, most: int | None = None) -> Column:
    """1 - edit distance / length of the longer text; null where the distance is over ``most``."""
    distance = F.levenshtein(left, right) if most is None else F.nullif(F.levenshtein(left, right, most), F.lit(-1))
    return 1 - distance / F.greatest(F.length(left), F.length(right))


# Texts and characters that mark a value as junk.
JUNK_VALUES = ["", "na", "n/a"]
JUNK_CHARACTERS = "|^&+%*#=!>"


def is_junk(value: Column) -> Column:
    """Junk guard on a normalised value; the characters count on its first line."""
    characters = "".join("\\" + c for c in JUNK_CHARACTERS)
    return value.isin(JUNK_VALUES) | value.rlike(rf"\A[^\n]*[{characters}]")
