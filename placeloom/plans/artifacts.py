"""The serving set: name groups, index, places and descriptions, valid only together under one manifest.

Each table is written by Spark; the manifest (a few hundred bytes) is written last, so a set without a manifest was never
finished. Defined cases: an empty scope gives empty tables and a valid manifest; scope lists are compared without order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom import schemas as S
from placeloom.operators import bm25, names
from placeloom.operators.features import country_names
from placeloom.operators.ner import gazetteer_spans
from placeloom.operators.pairs import with_documents
from placeloom.operators.search import search_batch
from placeloom.runtime import cut
from placeloom.sources.dumps import NotBuiltError, build_id, get_text, put_text, read_table, table_path, write_table

FORMAT = 2
TABLES = ("name_groups", "index", "places", "descriptions")


class StaleSetError(RuntimeError):
    """A set of another format, scope or build."""


def missing_places(groups: DataFrame, places: DataFrame) -> DataFrame:
    """Ids that a name leads to and the hydration table lacks; must be empty."""
    return groups.select(F.explode("places.geonameid").alias("geonameid")).distinct().join(places.select("geonameid"), "geonameid", "left_anti")


def _digest(spark: SparkSession, path: str) -> str:
    """sha256 over the sorted sha256 of the table's files, computed where the files are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(table_path(spark, path)).select(F.sha2("content", 256).alias("h"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n").cast("binary"), 256)).first()[0]


def build(places: DataFrame, alternates: DataFrame, admin1: DataFrame, path: str, countries: list[str] = S.COUNTRIES, languages: list[str] = S.LANGUAGES) -> dict:
    """Writes the set and returns its manifest."""
    spark = places.sparkSession
    scope = names.in_scope(places, countries)
    rows = names.name_rows(scope, alternates, languages)
    groups, table = names.name_groups(rows), names.places_projection(scope)
    lost = missing_places(groups, table).limit(5).collect()
    if lost:
        raise ValueError(f"names lead to places that the places table lacks, such as {[r[0] for r in lost]}")
    ident = uuid.uuid4().hex
    made = {"name_groups": groups, "index": bm25.forward_index(groups), "places": table, "descriptions": names.descriptions(rows, admin1, country_names(spark, countries, languages))}
    for name, df in made.items():
        write_table(df, f"{path}/{name}", ident)
    read = {name: read_table(spark, f"{path}/{name}") for name in TABLES}
    manifest = {
        "format": FORMAT, "build_id": ident, "built_at": datetime.now(UTC).isoformat(), "countries": countries, "languages": languages, "excluded_feature_codes": S.EXCLUDED_FEATURE_CODES,
        "n_documents": read["name_groups"].count(), "n_places": read["places"].count(), "n_descriptions": read["descriptions"].count(),
        "sha256": {name: _digest(spark, f"{path}/{name}") for name in TABLES},
    }
    put_text(spark, f"{path}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=1))
    return manifest


def load(spark: SparkSession, path: str, countries: list[str] = S.COUNTRIES, languages: list[str] = S.LANGUAGES) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and tables, after checks of format, scope and build."""
    text = get_text(spark, f"{path}/manifest.json")
    if text is None:
        raise NotBuiltError(f"{path} has no manifest: build the serving set first")
    manifest = json.loads(text)
    if manifest.get("format") != FORMAT:
        raise StaleSetError(f"format {manifest.get('format')}, not {FORMAT}")
    for key, want in (("countries", countries), ("languages", languages), ("excluded_feature_codes", S.EXCLUDED_FEATURE_CODES)):
        if sorted(manifest[key]) != sorted(want):
            raise StaleSetError(f"{key} {manifest[key]}, not {want}")
    tables = {name: read_table(spark, f"{path}/{name}") for name in TABLES}
    for name, df in tables.items():
        if build_id(df) != manifest["build_id"]:
            raise StaleSetError(f"{name} is of build {build_id(df)}, not {manifest['build_id']}")
    return manifest, tables


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 50, key: str = "q", rerank=None) -> DataFrame:
    """Results of a table of query texts over a stored set, with the descriptions of the places as ``document``."""
    _, tables = load(spark, path)
    named = tables["name_groups"].select("name", F.explode("places.geonameid").alias("geonameid"))
    found = search_batch(queries, named, tables["places"], k, key, rerank, tables["index"])
    return with_documents(found, tables["descriptions"])


def answer(spark: SparkSession, path: str, texts: DataFrame, tag: Callable[[DataFrame], DataFrame] | None = None, k: int = 50, key: str = "request_id", text: str = "query", rerank=None) -> DataFrame:
    """Results of whole texts: their places are tagged, the spans' texts joined in order, and searched for.

    ``tag`` gives (key, start, end, label) of a table of texts; without one the set's own names are the tagger. Texts
    without a span have no results; equal span texts are searched once.
    """
    if tag is None:
        known = load(spark, path)[1]["name_groups"].select(F.lower("name").alias("name"), F.lit("CITY").alias("label"))
        tag = lambda df: gazetteer_spans(df, known, key, text)
    spans = tag(texts).join(texts.select(key, F.col(text).alias("__t")), key)
    parts = F.array_sort(F.collect_list(F.struct("start", F.substring("__t", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")).alias("s"))))
    asked = cut(spans.groupBy(key).agg(parts.alias("p")).select(key, F.array_join(F.transform("p", lambda x: x["s"]), " ").alias("q")))
    return asked.join(search(spark, path, asked.select("q").distinct(), k, "q", rerank), "q")
