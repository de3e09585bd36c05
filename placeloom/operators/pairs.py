"""Labelled candidate pairs for a re-ranker, and splits by whole queries.

Defined cases: queries without spans give no pairs; the rank counts places that lack a description, so it may have gaps;
candidates without a description are left out; a null query is its own group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.operators.features import MATCH_FEATURES, build_features

OUTPUT = ["city_entities", "country_entities", "admin1_entities", "document", "log_population", "retriever_score", "retriever_rank", *MATCH_FEATURES, "query", "label"]


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the least ``order`` that each has: where it was seen first. A null value is one of them."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def with_documents(results: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Results with their place's description as ``document``; a place without one keeps its row with an empty text."""
    return results.join(descriptions.select("geonameid", F.col("description").alias("document")), "geonameid", "left").withColumn("document", F.coalesce("document", F.lit("")))


def build_pairs(results: DataFrame, queries: DataFrame, descriptions: DataFrame, lookup: list[tuple[str, str]]) -> DataFrame:
    """results: request_id, rank (from 1), geonameid, score, population; queries: request_id, query, three span texts, gold ids."""
    asked = queries.select("request_id", "query", "city_entities", "country_entities", "admin1_entities", F.col("geonameid").alias("gold"))
    shown = results.select("request_id", "geonameid", "population", F.col("score").cast("double").alias("retriever_score"), (F.col("rank") - 1).cast("double").alias("retriever_rank"))
    full = build_features(shown, asked, descriptions.withColumnRenamed("description", "document"), lookup)
    return full.withColumn("label", F.coalesce(F.array_contains("gold", F.col("geonameid")), F.lit(False)).cast("int")).select("request_id", "geonameid", *OUTPUT)


def held_out(query: Column, share: float, seed: str = "42") -> Column:
    """Whether a query is in the test part: by md5, so any engine splits alike and no query is on both sides."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), query)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) < share


def split_by_query(pairs: DataFrame, share: float = 0.2, seed: str = "42", query: str = "query") -> DataFrame:
    return pairs.withColumn("split", F.when(held_out(F.col(query), share, seed), "test").otherwise("train"))
