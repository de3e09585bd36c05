"""Projections of the staging tables: places in scope, their spellings, one group per spelling, descriptions.

Defined cases: a null country or feature code is out of scope; null names make no spelling; repeated spellings of a place
in a language count once; a region without a name is an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom import schemas as S
from placeloom.functions.text import strip

SEPARATOR = " | "


def in_scope(places: DataFrame, countries: list[str] = S.COUNTRIES, excluded: list[str] = S.EXCLUDED_FEATURE_CODES) -> DataFrame:
    return places.filter(F.col("country_code").isin(countries) & ~F.col("feature_code").isin(excluded))


def name_rows(places: DataFrame, alternates: DataFrame, languages: list[str] = S.LANGUAGES) -> DataFrame:
    """A row for each spelling of a place: its name and ASCII form as English, the others in their language.

    ``places`` is in scope already. One pass over the places gives both own spellings.
    """
    base = ["geonameid", "country_code", "admin1_code", "population", "asciiname"]
    own = places.select(*base, F.explode(F.array_distinct(F.array("name", "asciiname"))).alias("name"), F.lit("en").alias("isolanguage"))
    other = alternates.filter(F.col("isolanguage").isin(languages)).select("geonameid", F.col("alternate_name").alias("name"), "isolanguage").join(places.select(*base), "geonameid").select(*base, "name", "isolanguage")
    return own.unionByName(other).filter("name is not null").distinct()


def name_places(rows: DataFrame) -> DataFrame:
    """Distinct (name, geonameid, population): the places of each spelling, a row each; null population is 0."""
    return rows.select("name", "geonameid", F.coalesce("population", F.lit(0)).alias("population")).distinct()


def name_groups(rows: DataFrame) -> DataFrame:
    """One document per spelling: name and its places (geonameid, population), sorted by id; null population is 0."""
    return name_places(rows).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("geonameid", "population"))).alias("places"))


def places_projection(places: DataFrame) -> DataFrame:
    """What a search result carries; ``places`` is in scope."""
    return places.select(*S.PLACES)


def with_region(rows: DataFrame, admin1: DataFrame) -> DataFrame:
    """Adds admin1_name, empty where there is none. The region table is small and fixed by the scope's countries."""
    regions = admin1.dropDuplicates(["country_code", "admin1_code"])
    return rows.join(regions, ["country_code", "admin1_code"], "left").withColumn("admin1_name", F.coalesce("admin1_name", F.lit("")))


def descriptions(rows: DataFrame, admin1: DataFrame, country_names: DataFrame) -> DataFrame:
    """geonameid, description: the sorted spellings, the English country name (else its code) and the region, a line each."""
    grouped = rows.groupBy("geonameid", "country_code", "admin1_code").agg(F.array_join(F.array_sort(F.collect_set("name")), SEPARATOR).alias("names"))
    full = with_region(grouped, admin1).join(country_names.filter("language = 'en'").select("country_code", "country_name"), "country_code", "left")
    text = F.concat_ws("\n", "names", F.coalesce("country_name", "country_code", F.lit("")), "admin1_name")
    return full.select("geonameid", strip(text).alias("description"))


def distinct_tuples(*columns: str) -> Column:
    """Aggregate: how many different tuples occur; a null is a value like any other."""
    return F.count_distinct(F.struct(*columns))
