"""Whole batches of text queries against the name index: names, their places, the cut, hydration, optional re-ranking.

Defined cases: a query whose spans give a blank text has no results; a place reached by several names keeps the best
score; places without a row in the hydration table are left out; ties go to the larger population, then the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions.text import strip
from placeloom.operators import bm25


#: Results that a query may ask for.
MOST_RESULTS = 100


def expand(ranked: DataFrame, named: DataFrame, key: str = "q") -> DataFrame:
    """(key, geonameid, score): every place of every ranked name with the best of its names' scores.

    ``named`` has a row for each name and place, so a name of very many places is no single value.
    """
    hit = ranked.select(key, F.col("doc").alias("name"), "score").join(named.select("name", "geonameid"), "name")
    return hit.groupBy(key, "geonameid").agg(F.max("score").alias("score"))


def hydrate(ids: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of the wanted places, once each; unknown ids are left out."""
    return places.join(ids.select("geonameid").distinct(), "geonameid", "left_semi")


def cut(candidates: DataFrame, places: DataFrame, k: int, key: str = "q") -> DataFrame:
    full = candidates.join(places, "geonameid")
    order = W.partitionBy(key).orderBy(F.desc("score"), F.desc(F.coalesce("population", F.lit(0))), F.asc("geonameid"))
    return full.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_batch(queries: DataFrame, named: DataFrame, places: DataFrame, k: int = 50, key: str = "q", rerank: Callable[[DataFrame], DataFrame] | None = None, index: DataFrame | None = None) -> DataFrame:
    """(key, rank, geonameid, score, hydrated columns) for a table of query texts.

    ``index`` is the stored forward index of the names of ``named``; without one it is made for this call.

    ``rerank`` maps the result to one with a column ``rerank_score``; it changes the order of a query's places, never the
    set. Ties of that score go to the larger population, then the smaller id.
    """
    if not 1 <= k <= MOST_RESULTS:
        raise ValueError(f"k must be from 1 to {MOST_RESULTS}")
    asked = queries.select(key).filter(strip(key) != "").distinct()
    ranked = bm25.top_names(asked, bm25.forward_index(named) if index is None else index, k, key)
    out = cut(expand(ranked, named, key), places, k, key)
    if rerank is None:
        return out
    scored = rerank(out)
    order = W.partitionBy(key).orderBy(F.desc_nulls_last("rerank_score"), F.desc(F.coalesce("population", F.lit(0))), F.asc("geonameid"))
    return scored.withColumn("rank", F.row_number().over(order))
