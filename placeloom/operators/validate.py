"""Generated queries checked against their kind's contract; checkpoints of generation turned into a table.

Defined cases: a null query or null entities fail as a missing span or count; blank queries equal a blank name; a line
that is no JSON gives nulls and is skipped; of repeated requests the last by ``order`` counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom import schemas as S
from placeloom.functions.text import buckets, casefold, locate_spans, named, quoted_list, spans_of, strip
from placeloom.operators.corpus import keep_one

# Which kinds of request must name a region or a country; the labels of spans.
NEEDS_REGION = ["city_admin1", "city_admin1_country"]
NEEDS_COUNTRY = ["city_country", "city_admin1_country"]
LABELS = ["CITY", "COUNTRY", "REGION", "STATE"]
REGION_LABELS = ["REGION", "STATE"]


def expected_cities(source: Column, name: Column) -> Column:
    return F.when(source == "multi_city", F.size(F.filter(F.split(name, ","), lambda p: strip(p) != ""))).otherwise(F.lit(1))


def invalid_reason(query: Column, entities: Column, source: Column, name: Column) -> Column:
    """The first broken rule, or null: spans occur verbatim, one span per requested thing, more than the bare name."""
    spans = spans_of(entities)

    def count(labels: list[str]) -> Column:
        return F.size(F.filter(spans, lambda e: e["label"].isin(labels)))

    def expect(kind: str, want: Column, got: Column) -> tuple[Column, Column]:
        return got != want, F.format_string(f"expected %d {kind} span(s), got %d", want, got)

    texts = F.transform(spans, lambda e: e["text"])
    missing = F.filter(texts, lambda t: ~F.coalesce(query.contains(t), F.lit(False)))
    checks = [
        (query.isNull() | locate_spans(query, texts).isNull(), F.concat(F.lit("span not found verbatim in query: "), quoted_list(missing))),
        expect("CITY", F.coalesce(expected_cities(source, name), F.lit(1)), count(["CITY"])),
        expect("admin1", source.isin(NEEDS_REGION).cast("int"), count(REGION_LABELS)),
        expect("COUNTRY", source.isin(NEEDS_COUNTRY).cast("int"), count(["COUNTRY"])),
        (casefold(strip(query)) == casefold(strip(name)), F.lit("query is the bare name")),
    ]
    out = F.lit(None).cast("string")
    for broken, reason in reversed(checks):
        out = F.when(F.coalesce(broken, F.lit(False)), reason).otherwise(out)
    return out


def validated(df: DataFrame) -> DataFrame:
    reason = invalid_reason(F.col("query"), F.col("entities"), F.coalesce("sample_source", F.lit("")), F.coalesce("name", F.lit("")))
    return df.withColumn("invalid_reason", reason).withColumn("valid", F.col("invalid_reason").isNull())


def parse_response(content: Column) -> Column:
    """Struct (query, entities, confidence) of one completion, its code fence removed; null unless all of it is proper."""
    bare = strip(content)
    fenced = strip(F.regexp_replace(F.regexp_replace(bare, r"\A```[^\n]*\n", ""), r"```[^`]*\z", ""))
    parsed = F.from_json(F.when(bare.startswith("```"), fenced).otherwise(bare), f"query string, entities {S.ENTITIES}, confidence double")
    entities = F.transform(spans_of(parsed["entities"]), lambda e: named(text=strip(e["text"]), label=F.upper(strip(e["label"])), start=e["start"], end=e["end"]))
    good = (strip(parsed["query"]) != "") & parsed["confidence"].between(0.0, 1.0) & F.forall(entities, lambda e: (F.coalesce(e["text"], F.lit("")) != "") & F.coalesce(e["label"].isin(LABELS), F.lit(False)))
    return F.when(good, named(query=strip(parsed["query"]), entities=entities, confidence=parsed["confidence"]))


def done_ids(lines: DataFrame, version: str, line: str = "value") -> DataFrame:
    """Distinct request ids finished at a version; lines that are no JSON are skipped."""
    got = F.from_json(line, "request_id bigint, prompt_version string")
    return lines.select(got.alias("r")).filter((F.col("r.prompt_version") == version) & F.col("r.request_id").isNotNull()).select("r.request_id").distinct()


def usage(df: DataFrame, by: list[str], hit: Column, spent: Column) -> DataFrame:
    """Counters of a run by group: rows, hits, their share (0 of no rows), amount spent and the most that one row spent."""
    n, hits = F.count(F.lit(1)), F.count_if(hit)
    return df.groupBy(*by).agg(n.alias("rows"), hits.alias("hits"), F.when(n > 0, F.round(hits / n, 4)).otherwise(0.0).alias("hit_rate"), F.coalesce(F.sum(spent), F.lit(0)).cast("bigint").alias("spent"), F.coalesce(F.max(spent), F.lit(0)).cast("bigint").alias("peak"))


def checkpoint_table(rows: DataFrame, version: str, order: list[Column]) -> DataFrame:
    """Rows of one version, the first by ``order`` of each request, the valid ones, with their span texts by kind."""
    if "prompt_version" not in rows.columns:
        raise ValueError("the checkpoint has no prompt_version: every row is older than the present contract")
    kept = keep_one(rows.filter(F.col("prompt_version") == version), ["request_id"], order).filter("valid").drop("valid", "invalid_reason")
    spans = buckets(F.col("entities"))
    out = kept.withColumns({f"gold_{k}": v for k, v in spans.items()})
    return out.withColumnRenamed("isolanguage", "language") if "isolanguage" in out.columns else out
