"""Type names of dynamic attributes, and attribute maps (MAP<STRING, STRUCT<type, value>>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The registered names, with what Spark holds them as (geometries as WKT).
GEOMETRIES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "Geometry", "GeometryCollection")
OTHERS = {
    "RoadSegment": T.StringType(), "RoadNetwork": T.StringType(), "Trajectory": T.StringType(), "Integer": T.IntegerType(), "Long": T.LongType(), "Float": T.FloatType(),
    "Double": T.DoubleType(), "String": T.StringType(), "Boolean": T.BooleanType(), "Binary": T.BinaryType(), "Timestamp": T.TimestampType(), "Datetime": T.TimestampType(),
}
TYPES: dict[str, T.DataType] = {g: T.StringType() for g in GEOMETRIES} | OTHERS
ALIASES = {"int": "Integer", "bool": "Boolean"}
_BY_LOWER = {name.lower(): name for name in TYPES} | ALIASES
ATTRIBUTES = "map<string, struct<type: string, value: string>>"


def normalize(name: str) -> str:
    """The registered spelling; ValueError for names that aren't registered."""
    try:
        return _BY_LOWER[name.lower()]
    except KeyError:
        raise ValueError(f"not a data type: {name}") from None


def is_geometry(name: str) -> bool:
    return normalize(name) in GEOMETRIES


def is_point(name: str) -> bool:
    return normalize(name) == "Point"


def is_date(name: str) -> bool:
    return normalize(name) in ("Timestamp", "Datetime")


def attribute(attributes: Column | str, name: str, kind: str) -> Column:
    """A typed attribute; null where it is missing or doesn't parse."""
    value = F.try_element_at(F.col(attributes) if isinstance(attributes, str) else attributes, F.lit(name))["value"]
    target = TYPES[normalize(kind)]
    return value if isinstance(target, T.StringType) else F.encode(value, "UTF-8") if isinstance(target, T.BinaryType) else value.try_cast(target)


def with_attribute(attributes: Column | str, name: str, kind: str, value: Column) -> Column:
    """The map with one attribute set anew."""
    given = F.col(attributes) if isinstance(attributes, str) else attributes
    rest = F.map_filter(given, lambda k, _: k != name)
    return F.map_concat(rest, F.create_map(F.lit(name), F.struct(F.lit(normalize(kind)).alias("type"), value.cast("string").alias("value"))))


def attributes_equal(a: Column, b: Column) -> Column:
    """Equal as sets of entries; null equals null."""
    entries = lambda m: F.sort_array(F.map_entries(m))
    return entries(a).eqNullSafe(entries(b))
