"""Declared schemas of the staging tables and of what is derived from them."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType()}
_ENTITY = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_TYPES |= {"ids": T.ArrayType(T.LongType()), "entities": T.ArrayType(_ENTITY)}


def struct(spec: str) -> T.StructType:
    """A schema of 'name type' pairs; unlike a DDL string it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in spec.split(","))])


GEONAMES = struct(
    "geonameid bigint, name string, asciiname string, feature_class string, feature_code string, country_code string, admin1_code string, admin2_code string, "
    "population bigint, latitude double, longitude double, timezone string, modification_date date"
)
ALTERNATE_NAMES = struct("alternate_name_id bigint, geonameid bigint, isolanguage string, alternate_name string, is_preferred_name boolean, is_short_name boolean, is_colloquial boolean, is_historic boolean")
ADMIN1 = struct("country_code string, admin1_code string, admin1_name string")
ENTITIES = "array<struct<text:string,label:string,start:bigint,end:bigint>>"
CHECKPOINT = struct(
    "request_id bigint, name string, isolanguage string, geonameid ids, sample_source string, pool string, admin1_name string, country_name string, style string, topic string, "
    "query string, entities entities, confidence double, prompt_version string, valid boolean, invalid_reason string, attempts int"
)
PLACES = ["geonameid", "asciiname", "country_code", "population", "feature_code", "latitude", "longitude"]

# The scope of the gazetteer.
COUNTRIES = ["RU", "US", "TR", "CN"]
LANGUAGES = ["ru", "en", "tr", "zh"]
EXCLUDED_FEATURE_CODES = ["PPLH", "PPLQ", "PPLW", "PPLX"]
