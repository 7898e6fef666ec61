"""Value predicates of the semantic types, as ``Column -> Column`` functions.

They expect a normalised value (stripped, lower case).  Dictionaries are
literal arrays, so nothing is joined; a fuzzy test first compares lengths, as 1 - d/max cannot reach the
threshold when the lengths are too far apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from . import terms as T
from .text import SPACE, collapse_spaces, similarity

Predicate = Callable[[Column], Column]

# Up to so many words a search is compiled, word by word; more are searched in a list. The answers are the same.
_COMPILED_WORDS = 60

# The patterns, matched from the start of the value.
PHONE = r"\D?(\d{3})\D?\D?(\d{3})\D?(\d{4})$"
PO_BOX = r"p\.? ?o\.? box \d+"
ZIP = r"\d{5}(?:[-\s]\d{4})?$"
SUBJECT = r"[a-z]+ (\d{1,2}|[a-z])?"
BUILDING_CLASS = r"[a-wyz][0-9|muwbhrs]-"
# Host labels are spelled without nested repeats, so matching stays linear.
WEBSITE = r"(?:https?://)?(?:www\.)?(?:[a-z0-9]+(?:-[a-z0-9]+)*\.)+\w{2,}(?:/\S*)?$"
_FLOAT = r"\s*[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+)?|inf|infinity|nan)\s*"
LAT_LON = rf"\({_FLOAT}, {_FLOAT}\)$"


def _words(words: Sequence[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def address_patterns(words: Sequence[str]) -> list[str]:
    return [
        rf"\d{{1,4}} [\w\s]{{1,20}}{_words(words)}\W?(?:\s|$)",
        rf"\d{{1,4}} {_words(words)}\s\w+",
        PO_BOX,
    ]


def street_patterns(words: Sequence[str], compat: bool = False) -> list[str]:
    """``compat`` leaves out the second form, which never matches in the original."""
    patterns = [rf"[\w\s]{{1,20}}{_words(words)}\W?(?:\s|$)", rf"{_words(words)}[\s\w]{{1,20}}"]
    return patterns[:1] if compat else patterns


def matches(*patterns: str) -> Predicate:
    """True if one of the patterns matches at the start (Unicode classes, any case)."""

    def test(value: Column) -> Column:
        hits = [value.rlike(rf"(?iU)^(?:{p})") for p in patterns]
        result = hits[0]
        for hit in hits[1:]:
            result = result | hit
        return result

    return test


def constant(answer: bool) -> Predicate:
    return lambda value: F.lit(answer)


def _distinct(words: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(words))


def _literal_array(words: Sequence[str]) -> Column:
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"array({quoted})")


def one_of(words: Sequence[str]) -> Predicate:
    words = _distinct(words)
    return lambda value: value.isin(words)


def dictionary_term(words: Sequence[str]) -> Predicate:
    """Membership with runs of white space counted as one blank."""
    words = _distinct(words)
    return lambda value: collapse_spaces(value).isin(words)


def contains_any(words: Sequence[str]) -> Predicate:
    words = _distinct(words)
    if len(words) > _COMPILED_WORDS:
        return lambda value: F.exists(_literal_array(words), lambda word: F.contains(value, word))
    return lambda value: reduce(lambda found, word: found | value.contains(word), words, F.lit(False))


def similar_to(words: Sequence[str], threshold: float = 0.5) -> Predicate:
    """Some term is at least ``threshold`` similar; terms are tried by length."""
    by_length: dict[int, list[str]] = {}
    for word in _distinct(words):
        by_length.setdefault(len(word), []).append(word)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")

    def test(value: Column) -> Column:
        result = F.lit(False)
        for length, group in sorted(by_length.items()):
            low, high = math.floor(length * threshold), math.ceil(length / threshold)
            # The distance stops at the most that any value of these lengths may have.
            most = math.ceil((1 - threshold) * max(length, high))
            result = result | (
                F.length(value).between(max(low, 1), high)
                & F.exists(_literal_array(group), lambda term: F.coalesce(similarity(term, value, most) >= threshold, F.lit(False)))
            )
        return result

    return test


def any_word(test: Predicate) -> Predicate:
    return lambda value: F.exists(F.split(value, rf"(?U){SPACE}+"), test)


def either(*tests: Predicate) -> Predicate:
    def test(value: Column) -> Column:
        result = tests[0](value)
        for other in tests[1:]:
            result = result | other(value)
        return result

    return test


def build(threshold: float = 0.5, compat: bool = False, **lists: Sequence[str]) -> dict[str, Predicate]:
    """Registry semantic type -> predicate.

    ``lists`` replaces word lists by name (``cities=[...]``); the result is an
    ordinary dict, so further types are added by assignment.
    """
    defaults = {
        "cities": T.CITIES,
        "neighborhoods": T.neighborhoods(),
        "boroughs": T.BOROUGHS,
        "borough_letters": T.BOROUGH_LETTERS,
        "school_words": T.SCHOOL_WORDS,
        "school_levels": T.SCHOOL_LEVELS,
        "color_codes": T.COLOR_CODES,
        "colors": T.COLORS,
        "car_makes": T.CAR_MAKES,
        "vehicle_types": T.VEHICLE_TYPES,
        "agency_codes": T.AGENCY_CODES,
        "agency_words": T.AGENCY_WORDS,
        "study_areas": T.STUDY_AREAS,
        "location_words": T.LOCATION_WORDS,
        "park_words": T.PARK_WORDS,
        "university_words": T.UNIVERSITY_WORDS,
        "address_street_words": T.ADDRESS_STREET_WORDS,
        "street_words": T.STREET_WORDS,
    }
    unknown = set(lists) - set(defaults)
    if unknown:
        raise ValueError(f"unknown word lists: {sorted(unknown)}")
    w = {name: [t.lower() for t in lists.get(name, words)] for name, words in defaults.items()}
    fuzzy = lambda words: similar_to(words, threshold)
    return {
        "Person_name": constant(True),
        "Business_name": constant(True),
        "Phone_Number": matches(PHONE),
        "Address": matches(*address_patterns(w["address_street_words"])),
        "Street_name": matches(*street_patterns(w["street_words"], compat)),
        "City_agency": either(one_of(w["agency_codes"]), contains_any(w["agency_words"])),
        "City": dictionary_term(w["cities"]),
        "Neighborhood": dictionary_term(w["neighborhoods"]),
        "Borough": either(one_of(w["boroughs"] + w["borough_letters"]), fuzzy(w["boroughs"] + w["borough_letters"])),
        "Zip_code": matches(ZIP),
        "School_name": any_word(either(one_of(w["school_words"]), fuzzy(w["school_words"]))),
        "School_Levels": contains_any(w["school_levels"]),
        "Color": either(one_of(w["color_codes"] + w["colors"]), fuzzy(w["colors"])),
        "Car_make": either(one_of(w["car_makes"]), fuzzy(w["car_makes"])),
        "Vehicle_Type": either(one_of(w["vehicle_types"]), fuzzy(w["vehicle_types"])),
        "Areas_of_study": contains_any(w["study_areas"]),
        "Subjects_in_school": matches(SUBJECT),
        "Websites": matches(WEBSITE),
        "Building_Classification": matches(BUILDING_CLASS),
        "Type_of_location": contains_any(w["location_words"]),
        "Parks_Playgrounds": contains_any(w["park_words"]),
        "LAT_LON_coordinates": matches(LAT_LON),
        "College_University_names": contains_any(w["university_words"]),
    }
