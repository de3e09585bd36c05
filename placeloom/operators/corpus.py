"""Staging tables kept current: first or last row per key, deletes, cascades, upserts, and a whole delta.

Defined cases: an empty delta leaves a table as it is; a null key is never deleted and never matched; repeated rows of a
delta count once, the last by ``order`` winning; further columns of the incoming rows are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should identify a row of the key."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def latest(df: DataFrame, key: str, *by: str) -> DataFrame:
    """The last version of each key by the columns ``by``, nulls first in time."""
    return keep_one(df, [key], [F.col(c).desc_nulls_last() for c in by])


def current_places(geonames: DataFrame) -> DataFrame:
    return latest(geonames, "geonameid", "loaded_at", "modification_date", "population")


def current_names(alternates: DataFrame) -> DataFrame:
    return latest(alternates, "alternate_name_id", "loaded_at", "alternate_name")


def apply_deletes(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def cascade_orphans(children: DataFrame, parents: DataFrame, key: str = "geonameid") -> DataFrame:
    return children.join(parents.select(key), key, "left_semi")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Incoming rows win; inside incoming, the first by ``order`` of each key does. No sort: a table has no order."""
    new = keep_one(incoming, [key], order) if order else incoming.dropDuplicates([key])
    return existing.join(new.select(key), key, "left_anti").unionByName(new.select(existing.columns))


def apply_delta(places: DataFrame, names: DataFrame, *, deletes: DataFrame | None = None, name_deletes: DataFrame | None = None, changes: DataFrame | None = None, name_changes: DataFrame | None = None, order: list[Column] | None = None, name_order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Place deletes with their cascade, name deletes, place upserts, then name upserts for places that now exist.

    The sequence is the meaning: a place deleted and changed in one delta survives, and loses its earlier names.
    """
    if deletes is not None:
        places = apply_deletes(places, deletes, "geonameid")
        names = cascade_orphans(names, places)
    if name_deletes is not None:
        names = apply_deletes(names, name_deletes, "alternate_name_id")
    if changes is not None:
        places = upsert(places, changes, "geonameid", order)
    if name_changes is not None:
        names = upsert(names, cascade_orphans(name_changes, places), "alternate_name_id", name_order)
    return places, names
