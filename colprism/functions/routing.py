"""Choice of the semantic types to try, by column name.

The first route whose test holds is the only one used; inside it the types are
tried in order and what fits none is ``Other``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

OTHER = "Other"


@dataclass(frozen=True)
class Route:
    name: str
    types: tuple[str, ...]
    parts: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()

    def accepts(self, key: Column) -> Column:
        tests = [key.contains(p) for p in self.parts] + [key == e for e in self.exact]
        result = tests[0]
        for test in tests[1:]:
            result = result | test
        return result


# Routes in order, with the column-name parts and the types tried.
ROUTES = [
    Route("person", ("Person_name",), ("first", "last", "person"), ("mi",)),
    Route("business", ("Business_name",), ("dba", "businessname")),
    Route("phone", ("Phone_Number",), ("number", "phone")),
    Route("street", ("Address", "Street_name"), ("street",)),
    Route("agency", ("City_agency",), ("agency",)),
    Route("place", ("City", "Neighborhood", "Borough"), ("city", "neighborhood", "boro")),
    Route("zip", ("Zip_code",), ("zip",)),
    Route("school_level", ("School_Levels",), ("schoollevel",)),
    Route("school", ("School_name", "School_Levels"), ("school",)),
    Route("color", ("Color",), ("color",)),
    Route("vehicle", ("Car_make", "Vehicle_Type"), ("make", "vehicle")),
    Route("study", ("Areas_of_study", "Subjects_in_school"), ("core", "interest")),
    Route("website", ("Websites",), ("website",)),
    Route("building", ("Building_Classification",), ("classification",)),
    Route("location_type", ("Type_of_location",), ("typdesc",)),
    Route("park", ("Parks_Playgrounds", "School_name"), ("park", "orgname")),
    Route("latlon", ("LAT_LON_coordinates",), ("location", "latlon")),
    Route(
        "address",
        ("Address", "Street_name", "College_University_names", "Parks_Playgrounds"),
        ("address",),
    ),
]
NO_ROUTE = "other"

# The order of the types in the evaluation.
SEMANTIC_TYPES = [
    "Person_name", "Business_name", "City_agency", "Neighborhood", "Building_Classification", "Areas_of_study",
    "School_Levels", "Borough", "Subjects_in_school", "Parks_Playgrounds", "Zip_code", "Address", "Street_name",
    "Phone_Number", "City", "LAT_LON_coordinates", "School_name", "Car_make", "Vehicle_Type", "Type_of_location",
    "Websites", "Color", "College_University_names", "Other",
]


def column_of_file(file_name: Column) -> Column:
    """``5694-9szk.WEBSITE.txt.gz`` -> ``5694-9szk.WEBSITE``."""
    return F.replace(file_name, F.lit(".txt.gz"), F.lit(""))


def route_key(column_name: Column) -> Column:
    """Name after the dataset id, in lower case without underscores."""
    after_id = F.when(column_name.contains("."), F.split_part(column_name, F.lit("."), F.lit(2))).otherwise(column_name)
    return F.translate(F.lower(after_id), "_", "")


def route_of(key: Column, routes=ROUTES) -> Column:
    chosen = None
    for route in routes:
        test = route.accepts(key)
        chosen = F.when(test, route.name) if chosen is None else chosen.when(test, route.name)
    return chosen.otherwise(NO_ROUTE)
