"""Queries p1_... to p9_... of the operators in this subpackage, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.runtime import table


def _named(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.lookalike import consistent_names, place_names

    return consistent_names(place_names(table(spark, d, "geonames"), table(spark, d, "alternate_names")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.lookalike import same_looking

    return same_looking(_named(spark, d))


def p1_names(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.lookalike import repair_report

    return repair_report(_named(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_report(spark, d).filter("deficit > 0").select("isolanguage", "sample_source", "pool")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.strata import drawn_report

    return drawn_report(table(spark, d, "query_plan"), table(spark, d, "plan_targets"))


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.strata import sample_to_targets

    return sample_to_targets(table(spark, d, "query_plan"), table(spark, d, "plan_targets"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.overlap import cross_split_pairs

    return cross_split_pairs(table(spark, d, "query_dataset")).select(F.least("eval_id", "train_id").alias("request_id_a"), F.greatest("eval_id", "train_id").alias("request_id_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.overlap import overlap_report

    return overlap_report(table(spark, d, "query_dataset"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.topn import top_items

    return top_items(table(spark, d, "geoname_matches"), "request_id", "geonameid", "retriever_score", "population", 5).select("request_id", "geonameid")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_splits(spark, d).filter("request_id <> group_id").select(F.col("group_id").alias("group_request_id"), "request_id")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.groupsplit import group_splits

    return group_splits(table(spark, d, "query_dataset"), table(spark, d, "split_targets"))


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """Requests that got a split, groups torn between splits, and splits whose size is off their proportion by more than the largest group."""
    got = p5_splits(spark, d)
    groups = got.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("split").alias("splits"))
    whole = groups.agg(F.sum("size").alias("requests"), F.coalesce(F.sum((F.col("splits") > 1).cast("bigint")), F.lit(0)).alias("torn"), F.max("size").alias("largest"))
    sizes = table(spark, d, "split_targets").join(got.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "left").crossJoin(F.broadcast(whole))  # one row
    off = F.abs(F.coalesce("n", F.lit(0)) - F.col("proportion") * F.col("requests")) > F.col("largest")
    return sizes.groupBy("requests", "torn").agg(F.sum(off.cast("bigint")).alias("off"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.tokens import encode_corpus

    return encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).filter("short").select("source")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.mixture import mix

    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.mixture import mix

    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """Of each source: whether a record is used beyond the cap or listed twice, and whether its tokens miss the reachable ones by more than its two largest records."""
    from placeloom.llm.mixture import mix

    used, report = mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    listed = used.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("docs"), F.max("repeats").alias("most"))
    full = report.join(listed, "source", "left")
    reachable = F.least(F.col("wanted_tokens"), F.col("max_repeats") * F.col("own_tokens").cast("double"))
    over = (F.coalesce("most", F.lit(0)) > F.col("max_repeats")) | (F.coalesce("rows", F.lit(0)) != F.coalesce("docs", F.lit(0)))
    return full.select("source", over.alias("misused"), (F.abs(F.col("mix_tokens") - reachable) > 2 * F.col("largest") + 1).alias("off"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.personal import findings

    return findings(table(spark, d, "documents"), table(spark, d, "person_names"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.llm.personal import personal_information

    return personal_information(table(spark, d, "documents"), table(spark, d, "person_names")).select("doc_id", "redacted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_names, p1_report, p2_found, p2_report, p2_sample, p3_found, p3_report, p4_found, p5_found, p5_splits, p5_check, p7_ids, p8_found, p8_mixture, p8_report, p8_check, p9_found, p9_redacted)}

_STRATA = """
WITH size AS (SELECT count(DISTINCT request_id) // 5 AS size FROM query_plan),
seen AS (
  SELECT lower(trim(isolanguage)) AS isolanguage, sample_source, pool, count(DISTINCT request_id) AS observed
  FROM query_plan WHERE isolanguage IS NOT NULL AND sample_source IS NOT NULL AND pool IS NOT NULL GROUP BY 1, 2, 3),
report AS (
  SELECT t.*, s.size, coalesce(o.observed, 0) AS observed, greatest(CAST(t.min_rows AS BIGINT), CAST(floor(t.target_share * s.size) AS BIGINT)) AS quota
  FROM plan_targets t CROSS JOIN size s LEFT JOIN seen o USING (isolanguage, sample_source, pool))
"""

_BLANK = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _compared(c: str) -> str:
    return f"nullif(lower(trim(regexp_replace({c}, '{_BLANK}+', ' ', 'g'))), '')"


# components by the least key that reaches each key, over as many steps as it takes
_GROUPS = f"""
WITH RECURSIVE
  keys AS (SELECT DISTINCT request_id, k FROM (SELECT request_id, 'q:' || {_compared("query")} AS k FROM query_dataset
    UNION ALL SELECT request_id, 'n:' || {_compared("p")} FROM (SELECT request_id, unnest(string_split(name, ',')) AS p FROM query_dataset)) WHERE k IS NOT NULL AND request_id IS NOT NULL),
  hub AS (SELECT request_id, min(k) AS h FROM keys GROUP BY 1),
  links AS (SELECT DISTINCT h AS a, k AS b FROM keys JOIN hub USING (request_id) WHERE h <> k),
  both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  comp(k, root) USING KEY (k) AS (
    SELECT DISTINCT k, k FROM keys
    UNION SELECT l.b, min(c.root) FROM comp c JOIN both_ways l ON l.a = c.k JOIN recurring.comp o ON o.k = l.b WHERE c.root < o.root GROUP BY l.b),
  placed AS (SELECT h.request_id, c.root FROM hub h JOIN comp c ON c.k = h.h),
  least AS (SELECT root, min(request_id) AS g FROM placed GROUP BY 1)
"""

SQL = {
    "p5_found": _GROUPS + "SELECT g AS group_request_id, request_id FROM placed JOIN least USING (root) WHERE g <> request_id",
    "p2_found": _STRATA + "SELECT isolanguage, sample_source, pool FROM report WHERE observed < quota",
    "p2_report": _STRATA + "SELECT isolanguage, sample_source, pool, target_share, min_rows, size, observed, quota, least(quota, observed) AS taken, quota - least(quota, observed) AS deficit FROM report",
    # what the splits and the mixture must keep, whatever was drawn
    "p5_check": "SELECT count(DISTINCT request_id) AS requests, 0 AS torn, 0 AS off FROM query_dataset",
    "p8_check": "SELECT source, false AS misused, false AS off FROM mix_targets",
    "p4_found": """
WITH best AS (
  SELECT request_id, geonameid, retriever_score AS s, coalesce(population, 0) AS p,
         row_number() OVER (PARTITION BY request_id, geonameid ORDER BY retriever_score DESC, coalesce(population, 0) DESC) AS k
  FROM geoname_matches WHERE retriever_score IS NOT NULL AND NOT isnan(retriever_score)),
ranked AS (SELECT request_id, geonameid, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, p DESC, geonameid) AS r FROM best WHERE k = 1)
SELECT request_id, geonameid FROM ranked WHERE r <= 5""",
}
