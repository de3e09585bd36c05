"""Named queries of the core operators over the whole test tables. The same in SQL: ``placeloom.plans.oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom import schemas as S
from placeloom.functions import text as X
from placeloom.operators import badrows, bm25, corpus, features, irmetrics, names, ner, pairs, search, validate
from placeloom.plans import sample_plan as P
from placeloom.plans.oracle import SQL  # noqa: F401
from placeloom.runtime import cut, sorted_rank, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TOP_K = 10


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(c: Column | str, sep: str = ",") -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


# ------------------------------------------------------------------ frames that queries share


def places(spark: SparkSession, d: str) -> DataFrame:
    return corpus.current_places(table(spark, d, "geonames"))


def alternates(spark: SparkSession, d: str) -> DataFrame:
    return corpus.current_names(table(spark, d, "alternate_names"))


def scope(spark: SparkSession, d: str) -> DataFrame:
    return names.in_scope(places(spark, d))


def rows(spark: SparkSession, d: str) -> DataFrame:
    return names.name_rows(scope(spark, d), alternates(spark, d))


def groups(spark: SparkSession, d: str) -> DataFrame:
    return P.place_groups(rows(spark, d), table(spark, d, "admin1"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """query_dataset with the last version of each request."""
    return corpus.latest(table(spark, d, "query_dataset"), "request_id", "generated_at", "attempts", "query")


def search_texts(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select(X.query_text(F.col("entities")).alias("q")).distinct()


def scored_matches(spark: SparkSession, d: str) -> DataFrame:
    """The best row of each place of a request in geoname_matches, by score, then population; rows without a score are no matches."""
    m = table(spark, d, "geoname_matches").filter("retriever_score is not null and not isnan(retriever_score)")
    level = m.groupBy("request_id", "geonameid", F.col("retriever_score").alias("score")).agg(F.max(F.coalesce("population", F.lit(0))).alias("population"))
    return level.groupBy("request_id", "geonameid").agg(F.max("score").alias("score"), F.max_by("population", "score").alias("population"))


def run_of_matches(spark: SparkSession, d: str) -> DataFrame:
    """geoname_matches as a run: the best row of each place, all of them ranked in their request."""
    return sorted_rank(scored_matches(spark, d), ["request_id"], [F.desc("score"), F.desc("population"), F.asc("geonameid")])


def gold_spans(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("request_id", "language", F.explode("entities").alias("e"), "confidence").select("request_id", "language", F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.col("e.label").alias("label"), "confidence")


def name_spans(spark: SparkSession, d: str) -> DataFrame:
    """A plain baseline of predicted spans: where a city of the request's name occurs first in its query."""
    parts = requests(spark, d).select("request_id", "language", "query", "confidence", F.explode(F.array_distinct(F.transform(F.split(F.lower("name"), ","), lambda p: F.trim(p)))).alias("part")).filter("part <> ''")
    at = F.call_function("locate", F.col("part"), F.lower("query"))
    return parts.withColumn("at", at).filter("at > 0").select("request_id", "language", (F.col("at") - 1).cast("bigint").alias("start"), (F.col("at") - 1 + F.length("part")).cast("bigint").alias("end"), F.lit("CITY").alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("score"))


# ------------------------------------------------------------------ rows that fail to parse


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return badrows.parse_cells(table(spark, d, "raw_lines").select("line_id", "file_name", "line"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.violations(_parsed(spark, d))


def _clean(spark: SparkSession, d: str, kind: str) -> DataFrame:
    parsed = _parsed(spark, d).filter(F.col("kind") == kind)
    rows = badrows.clean_rows(parsed, badrows.violations(parsed), kind)
    left = F.transform(F.array_sort(F.map_entries("unparsed")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.withColumn("unparsed", joined(left, "|"))


@query
def p6_places(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d, "place")


@query
def p6_names(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d, "name")


# ------------------------------------------------------------------ staging tables


@query
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return scope(spark, d).select("geonameid", "country_code", "feature_code")


@query
def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).select("geonameid", "name", "population")


@query
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col(c).asc_nulls_last() for c in ("loaded_at", "modification_date", "population")]
    return corpus.keep_one(table(spark, d, "geonames"), ["geonameid"], order).select("geonameid", "population")


def _changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Valid lines of the change files as place and name versions; the later line wins. A population beyond the table's type is null."""

    def rows(files: str, kind: str) -> DataFrame:
        parsed = _parsed(spark, d).filter(F.col("file_name").like(files))
        return badrows.clean_rows(parsed, badrows.violations(parsed), kind)

    p = rows("modifications-%", "place").filter("feature_class = 'P' and geonameid is not null").filter(F.col("country_code").isin(S.COUNTRIES)).withColumn("population", F.col("population").try_cast("bigint"))
    n = rows("alternateNamesModifications%", "name").filter(F.col("isolanguage").isin(S.LANGUAGES)).filter("alternate_name_id is not null")
    return p, n


_PLACE = ["geonameid", "name", "asciiname", "feature_code", "country_code", "admin1_code", "population"]
_NAME = ["alternate_name_id", "geonameid", "isolanguage", "alternate_name"]


@query
def upsert_keep_last(spark: SparkSession, d: str) -> DataFrame:
    p, _ = _changes(spark, d)
    return corpus.upsert(places(spark, d).select(_PLACE), p, "geonameid", [F.desc("line_id")])


@query
def apply_deletes(spark: SparkSession, d: str) -> DataFrame:
    gone = places(spark, d).filter("feature_class <> 'P'")
    return corpus.apply_deletes(places(spark, d), gone, "geonameid").select("geonameid", "feature_class")


@query
def cascade_orphans(spark: SparkSession, d: str) -> DataFrame:
    return corpus.cascade_orphans(alternates(spark, d), scope(spark, d)).select("alternate_name_id", "geonameid")


def _delta(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, n = _changes(spark, d)
    return corpus.apply_delta(
        places(spark, d).select(_PLACE), alternates(spark, d).select(*_NAME), deletes=places(spark, d).filter("feature_class <> 'P'").select("geonameid"), name_deletes=alternates(spark, d).filter("is_historic").select("alternate_name_id"),
        changes=p, name_changes=n, order=[F.desc("line_id")], name_order=[F.desc("line_id")],
    )


@query
def apply_delta(spark: SparkSession, d: str) -> DataFrame:
    return _delta(spark, d)[0].select("geonameid", "name", "population")


@query
def apply_delta_names(spark: SparkSession, d: str) -> DataFrame:
    return _delta(spark, d)[1]


# ------------------------------------------------------------------ projections


@query
def name_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d)


@query
def name_groups(spark: SparkSession, d: str) -> DataFrame:
    g = names.name_groups(rows(spark, d))
    return g.select("name", F.size("places").cast("bigint").alias("n"), joined(F.transform("places", lambda p: F.concat_ws(":", p["geonameid"].cast("string"), p["population"].cast("string")))).alias("places"))


@query
def places_projection(spark: SparkSession, d: str) -> DataFrame:
    return names.places_projection(scope(spark, d))


@query
def admin1_names(spark: SparkSession, d: str) -> DataFrame:
    return names.with_region(scope(spark, d).select("geonameid", "country_code", "admin1_code"), table(spark, d, "admin1")).select("geonameid", "admin1_name")


@query
def descriptions(spark: SparkSession, d: str) -> DataFrame:
    return names.descriptions(rows(spark, d), table(spark, d, "admin1"), features.country_names(spark))


@query
def hydrate_semi(spark: SparkSession, d: str) -> DataFrame:
    return search.hydrate(table(spark, d, "geoname_matches"), names.places_projection(scope(spark, d))).select("geonameid", "asciiname", "population")


@query
def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.plans.artifacts import missing_places

    return missing_places(names.name_groups(rows(spark, d)), names.places_projection(scope(spark, d))).agg(F.count(F.lit(1)).alias("missing"))


# ------------------------------------------------------------------ index and search


@query
def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("name").distinct().select(F.explode(X.char_ngrams("name")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def ngram_df(spark: SparkSession, d: str) -> DataFrame:
    return bm25.postings(rows(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query
def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.doc_stats(rows(spark, d))


@query
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    r = cut(rows(spark, d).select("name").distinct())  # read for the mean length, the count and the shards
    return bm25.scores(cut(search_texts(spark, d)), r.withColumnRenamed("name", "doc"), bm25.average_length(r)).select("q", "doc", bm25.rounded("score").alias("score"))


@query
def bm25_top_names(spark: SparkSession, d: str) -> DataFrame:
    return bm25.top_names(search_texts(spark, d), bm25.forward_index(rows(spark, d)), TOP_K).select("q", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    out = search.search_batch(search_texts(spark, d), names.name_places(rows(spark, d)), names.places_projection(scope(spark, d)), TOP_K)
    return out.select("q", F.col("rank").cast("bigint").alias("rank"), "geonameid", "asciiname", "country_code", "population", F.round("score", 6).alias("score"))


@query
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    """Results with their descriptions; the table of descriptions here lacks the places without a population, whose text is empty."""
    r = rows(spark, d)
    desc = names.descriptions(r.filter("population > 0"), table(spark, d, "admin1"), features.country_names(spark))
    return pairs.with_documents(search_topk(spark, d), desc).select("q", "rank", "geonameid", "document")


@query
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same set in the order of a coarser score, its ties by population."""
    out = search.search_batch(search_texts(spark, d), names.name_places(rows(spark, d)), names.places_projection(scope(spark, d)), TOP_K, rerank=lambda x: x.withColumn("rerank_score", F.floor("score")))
    return out.select("q", F.col("rank").cast("bigint").alias("rank"), "geonameid")


# ------------------------------------------------------------------ plan of requests


@query
def place_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups(spark, d).select("name", "isolanguage", "country_code", "admin1_code", joined("geonameid").alias("ids"), "admin1_name", "max_population", "region_repeats_city")


@query
def name_gold(spark: SparkSession, d: str) -> DataFrame:
    return P.name_gold(rows(spark, d)).select("name", "isolanguage", joined("geonameid").alias("ids"))


@query
def name_pools(spark: SparkSession, d: str) -> DataFrame:
    return P.name_pools(groups(spark, d))


@query
def country_targets(spark: SparkSession, d: str) -> DataFrame:
    return P.country_targets(groups(spark, d)).select("name", "isolanguage", "country_code", joined("geonameid").alias("ids"), "max_population")


@query
def pool_unique(spark: SparkSession, d: str) -> DataFrame:
    return P.name_pools(groups(spark, d)).filter(P.in_pool(P.KINDS[3])).select("name", "isolanguage", "country_code")


@query
def pool_homonym(spark: SparkSession, d: str) -> DataFrame:
    return P.name_pools(groups(spark, d)).filter(P.in_pool(P.KINDS[2])).select("name", "isolanguage", "country_code", "n_admin1_in_country")


@query
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    order = [("pop_in_country", True), ("name", False)]
    return P.bands(P.name_pools(groups(spark, d)), ["isolanguage", "country_code"], order, (2, 2, 2), "42", ["name", "isolanguage", "country_code"]).select("name", "isolanguage", "country_code", "strat_band")


@query
def expand_targets(spark: SparkSession, d: str) -> DataFrame:
    g = groups(spark, d)
    kind = P.KINDS[6]
    picked = P.name_pools(g).filter(P.in_pool(kind) & F.col("has_valid_region")).select("name", "isolanguage").distinct()
    return P.expand_targets(picked, g, kind).select("name", "isolanguage", "country_code", "admin1_code", joined("geonameid").alias("ids"))


@query
def sample_plan(spark: SparkSession, d: str) -> DataFrame:
    return P.build_sample_plan(rows(spark, d), table(spark, d, "admin1"), features.country_names(spark)).withColumn("geonameid", joined("geonameid"))


@query
def plan_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.plan_counts(table(spark, d, "query_plan"))


@query
def limit_per_source(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "query_plan").select("request_id", "sample_source").distinct()
    return P.limit_per_source(plan, 100)


@query
def style_topic(spark: SparkSession, d: str) -> DataFrame:
    return P.style_topic(table(spark, d, "query_plan").select("request_id").distinct())


@query
def plan_provenance(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "query_plan").select("request_id", "strat_band", "group_country").groupBy("request_id").agg(F.min("strat_band").alias("strat_band"), F.min("group_country").alias("group_country"))
    return requests(spark, d).select("request_id", "sample_source").join(plan, "request_id")


@query
def request_messages(spark: SparkSession, d: str) -> DataFrame:
    from placeloom.plans.messages import user_message

    c = [F.col(x) for x in ("sample_source", "isolanguage", "name", "admin1_name", "country_name", "style", "topic")]
    return table(spark, d, "query_plan").select("request_id", user_message(*c).alias("message"))


@query
def result_table(spark: SparkSession, d: str) -> DataFrame:
    p = names.places_projection(scope(spark, d))
    near = lambda c: (F.floor(F.col(c) * 10000.0 + 0.5) / 10000.0).alias(c)
    return p.select("geonameid", X.country_flag(F.col("country_code")).alias("flag"), near("latitude"), near("longitude"), F.greatest(F.coalesce("population", F.lit(0)), F.lit(1)).alias("size"))


# ------------------------------------------------------------------ generated queries


@query
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    return validate.validated(requests(spark, d)).select("request_id", "valid", F.coalesce("invalid_reason", F.lit("")).alias("invalid_reason"))


@query
def checkpoint_latest(spark: SparkSession, d: str) -> DataFrame:
    q = validate.validated(table(spark, d, "query_dataset").drop("gold_city_entities", "gold_country_entities", "gold_admin1_entities"))
    version = table(spark, d, "query_dataset").agg(F.max("prompt_version")).first()[0] or ""
    order = [F.col(c).desc_nulls_last() for c in ("generated_at", "attempts", "query")]
    return validate.checkpoint_table(q, version, order).select("request_id", "query", "gold_city_entities", "gold_country_entities", "gold_admin1_entities")


@query
def entity_buckets(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("request_id", *[c.alias(n) for n, c in X.buckets(F.col("entities")).items()])


@query
def locate_spans(spark: SparkSession, d: str) -> DataFrame:
    at = X.locate_spans(F.col("query"), F.transform("entities", lambda e: e["text"]))
    return requests(spark, d).select("request_id", joined(F.transform(at, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))).alias("spans"))


@query
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


@query
def done_ids(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "query_dataset").select(F.to_json(F.struct("request_id", "prompt_version", "query")).alias("value"))
    version = table(spark, d, "query_dataset").agg(F.max("prompt_version")).first()[0] or ""
    return validate.done_ids(lines, version)


@query
def generate_dataset(spark: SparkSession, d: str) -> DataFrame:
    """The whole loop against a recorded generator: each request's answer comes proper at its recorded attempt and broken before; odd ids of ten were done."""
    from placeloom.plans.generate import generate

    plan = table(spark, d, "query_plan").groupBy("request_id").agg(*[F.min(c).alias(c) for c in ("name", "isolanguage", "sample_source", "admin1_name", "country_name", "style", "topic")])
    spoken = F.to_json(F.struct("query", F.transform("entities", lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"))).alias("entities"), F.coalesce("confidence", F.lit(0.5)).alias("confidence")))
    recorded = requests(spark, d).select("request_id", F.col("attempts").alias("good_at"), spoken.alias("spoken"))
    done = plan.select("request_id").filter("request_id % 10 = 1")

    def ask(pending: DataFrame) -> DataFrame:
        return pending.join(recorded, "request_id", "left").withColumn("response", F.when(F.col("attempt") < F.col("good_at"), F.lit("{")).otherwise(F.col("spoken")))

    out = generate(plan, ask, "v1", done, 3)
    return out.select("request_id", "attempts", "valid", F.coalesce("query", F.lit("")).alias("query"))


@query
def usage_stats(spark: SparkSession, d: str) -> DataFrame:
    return validate.usage(requests(spark, d), ["sample_source"], F.col("attempts") == 1, F.col("attempts"))


@query
def confidence_stats(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence")
    return requests(spark, d).groupBy("language").agg(F.count(c).alias("n"), F.min(c).alias("least"), F.round(F.percentile(c, 0.5), 6).alias("median"), F.round(F.avg(c), 6).alias("mean"), F.count_if(c < 0.8).alias("below"))


# ------------------------------------------------------------------ spans


@query
def cjk_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", joined(X.tokens("text"), " ").alias("tokens"))


@query
def align_span(spark: SparkSession, d: str) -> DataFrame:
    at = requests(spark, d).select("request_id", X.tokens_at("query").alias("tok"), F.posexplode("entities").alias("pos", "e")).select("request_id", "pos", X.align_span(F.col("tok"), F.col("e.start"), F.col("e.end")).alias("a"))
    return at.select("request_id", F.col("pos").cast("bigint").alias("pos"), F.col("a.first").cast("bigint").alias("first"), F.col("a.last").cast("bigint").alias("last"))


@query
def ner_examples(spark: SparkSession, d: str) -> DataFrame:
    e = ner.build_examples(requests(spark, d))
    return e.select("request_id", F.size("tokenized_text").cast("bigint").alias("tokens"), joined(F.transform("ner", lambda s: F.concat_ws(":", s["first"].cast("string"), s["last"].cast("string"), s["label"]))).alias("ner"))


@query
def split_by_name(spark: SparkSession, d: str) -> DataFrame:
    return ner.split_by_name(requests(spark, d).filter("name is not null and language is not null")).select("request_id", "language", "name", "split")


@query
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return gold_spans(spark, d).groupBy("language", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def span_prf(spark: SparkSession, d: str) -> DataFrame:
    return ner.span_scores(gold_spans(spark, d), name_spans(spark, d))


@query
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return ner.threshold_sweep(gold_spans(spark, d), name_spans(spark, d), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])


@query
def span_errors(spark: SparkSession, d: str) -> DataFrame:
    return ner.span_errors(gold_spans(spark, d), name_spans(spark, d))


@query
def gazetteer_spans(spark: SparkSession, d: str) -> DataFrame:
    known = rows(spark, d).select(F.lower("name").alias("name"), F.lit("CITY").alias("label"))
    return ner.gazetteer_spans(requests(spark, d), known)


@query
def highlight_segments(spark: SparkSession, d: str) -> DataFrame:
    parts = X.highlight(F.col("query"), F.col("entities"))
    return requests(spark, d).select("request_id", joined(F.transform(parts, lambda p: F.concat(p["text"], F.lit("/"), F.coalesce(p["label"], F.lit("-")))), "|").alias("segments"))


@query
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("name").distinct().select("name", X.name_norm("name").alias("norm"))


# ------------------------------------------------------------------ pairs and metrics


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    asked = requests(spark, d).select("request_id", "query", "geonameid", *[c.alias(n) for n, c in X.buckets(F.col("entities")).items()])
    desc = names.descriptions(rows(spark, d), table(spark, d, "admin1"), features.country_names(spark))
    return pairs.build_pairs(run_of_matches(spark, d), asked, desc, features.country_lookup(features.country_names(spark)))


@query
def match_features(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("request_id", "geonameid", *pairs.OUTPUT)


@query
def rank_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = run_of_matches(spark, d).join(requests(spark, d).select("request_id", F.col("geonameid").alias("gold")), "request_id")
    return p.select("request_id", "geonameid", F.col("rank").cast("bigint").alias("rank"), F.coalesce(F.array_contains("gold", F.col("geonameid")), F.lit(False)).cast("int").alias("label"))


@query
def log_population(spark: SparkSession, d: str) -> DataFrame:
    return scope(spark, d).select("geonameid", F.round(X.log_population(F.col("population")), 6).alias("log_population"))


@query
def split_by_query(spark: SparkSession, d: str) -> DataFrame:
    return pairs.split_by_query(requests(spark, d).select("request_id", "query")).select("request_id", "split")


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select(F.col("request_id").alias("query"), F.explode("geonameid").alias("id"))


def _run(spark: SparkSession, d: str) -> DataFrame:
    return run_of_matches(spark, d).select(F.col("request_id").alias("query"), F.col("geonameid").alias("id"), F.col("rank").cast("bigint").alias("rank"))


@query
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return irmetrics.metrics(_qrels(spark, d), _run(spark, d))


@query
def oracle_run(spark: SparkSession, d: str) -> DataFrame:
    q = _qrels(spark, d)
    return irmetrics.metrics(q, irmetrics.oracle_run(q, _run(spark, d)))


@query
def empty_accuracy(spark: SparkSession, d: str) -> DataFrame:
    # requests of the plan that were never generated have no answer
    asked = table(spark, d, "query_plan").select(F.col("request_id").alias("query")).distinct().join(requests(spark, d).select(F.col("request_id").alias("query"), F.size("geonameid").alias("gold_size")), "query", "left").na.fill(0, ["gold_size"])
    return irmetrics.empty_accuracy(asked, scored_matches(spark, d).select(F.col("request_id").alias("query")))


@query
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The run as it is, ordered by population, and in its ideal order."""
    run = _run(spark, d)
    by_population = sorted_rank(scored_matches(spark, d), ["request_id"], [F.desc("population"), F.desc("score"), F.asc("geonameid")])
    again = by_population.select(F.col("request_id").alias("query"), F.col("geonameid").alias("id"), F.col("rank").cast("bigint").alias("rank"))
    return irmetrics.evaluation(_qrels(spark, d), {"baseline": run, "population": again}, "baseline")


@query
def first_seen_queries(spark: SparkSession, d: str) -> DataFrame:
    return pairs.first_seen(requests(spark, d), "query", "request_id").select("query", "request_id")


@query
def distinct_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_plan").groupBy("sample_source").agg(names.distinct_tuples("name", "isolanguage").alias("n"))


@query
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return irmetrics.latency_percentiles(table(spark, d, "events"), "value", ["event_type"])
