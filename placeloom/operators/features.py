"""Match features of a query's spans against a place's description.

Spans are brought to normal form once per query and descriptions once per place, as each meets the other many times.
Country names are resolved to codes by whole words through a small table of names.

Defined cases: null texts are empty; an empty description has no names; -1 as country match says that one side names no
known country; a description has one to three lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom import schemas as S
from placeloom.functions.text import containment, gram_set, log_population, name_norm, parts_norm, strip

MATCH_FEATURES = ["city_exact_match", "city_substr_match", "city_ngram_containment", "city_token_cover", "country_match", "has_country_span", "admin1_substr_match", "admin1_ngram_containment", "has_admin1_span"]


def country_names(spark: SparkSession, countries: list[str] = S.COUNTRIES, languages: list[str] = S.LANGUAGES) -> DataFrame:
    """(language, country_code, country_name) from the JVM's locale data: countries times languages rows."""
    locale = spark._jvm.java.util.Locale
    rows = [(lang, cc, locale.forLanguageTag(f"und-{cc}").getDisplayCountry(locale.forLanguageTag(lang))) for lang in dict.fromkeys(["en", *languages]) for cc in countries]
    return spark.createDataFrame(rows, "language string, country_code string, country_name string")


def country_lookup(names: DataFrame) -> list[tuple[str, str]]:
    """(normal name, code), English spellings first, the first of equal spellings wins; codes stand for themselves."""
    from placeloom.functions.text import norm

    rows = sorted(names.collect(), key=lambda r: (r["language"] != "en", r["language"], r["country_code"]))
    out: dict[str, str] = {}
    for r in rows:
        out.setdefault(norm(r["country_name"]), r["country_code"])
    for code in {*out.values()}:
        out.setdefault(norm(code), code)
    return sorted(out.items())


def countries_in(normal: Column, lookup: list[tuple[str, str]]) -> Column:
    """Codes of the countries named as whole words in a text in normal form; the lookup has a few dozen entries."""
    padded = F.concat(F.lit(" "), F.coalesce(normal, F.lit("")), F.lit(" "))
    hits = [F.when(padded.contains(f" {name} "), F.lit(code)) for name, code in lookup if name]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def parsed_queries(queries: DataFrame, lookup: list[tuple[str, str]]) -> DataFrame:
    """The queries' columns (city_entities, country_entities, admin1_entities among them) and q_*: normal forms and codes.

    A normal form is made once for each query; grams are left to where they are used, as they are longer than their text.
    """
    of = ["city_entities", "country_entities", "admin1_entities"]
    own = queries.withColumns({c: F.coalesce(c, F.lit("")) for c in of})
    made = own.select("*", name_norm("city_entities").alias("q_city"), name_norm("country_entities").alias("__country"), name_norm("admin1_entities").alias("q_admin1"))
    return made.select(*queries.columns, "q_city", "q_admin1", countries_in(F.col("__country"), lookup).alias("q_codes"), (strip("country_entities") != "").alias("q_has_country"), (strip("admin1_entities") != "").alias("q_has_admin1"))


def parsed_documents(documents: DataFrame, lookup: list[tuple[str, str]], doc: str = "document", key: str = "geonameid") -> DataFrame:
    """A row for each ``key``: the description and d_*, its names, grams of each name, country codes and region in normal form.

    A place is described once, so its text is brought to normal form once.
    """
    lines = F.split(F.coalesce(F.col(doc), F.lit("")), "\n", -1)
    line = [F.coalesce(F.get(lines, F.lit(i)), F.lit("")) for i in range(3)]
    made = documents.select(key, doc, parts_norm(F.split(line[0], r" \| ")).alias("names"), name_norm(line[1]).alias("country"), name_norm(line[2]).alias("region"))
    made = made.select(key, doc, F.filter("names", lambda n: n != "").alias("d_names"), "country", "region")
    return made.select(key, doc, "d_names", F.transform("d_names", lambda n: gram_set(n)).alias("d_grams"), countries_in(F.col("country"), lookup).alias("d_codes"), F.col("region").alias("d_admin1"), gram_set("region").alias("d_admin1_grams"))


def match_columns() -> dict[str, Column]:
    """The nine features, over the columns of ``parsed_queries`` and ``parsed_documents``."""
    words = F.filter(F.split("q_city", " "), lambda t: t != "")
    city = F.concat(F.lit(" "), F.col("q_city"), F.lit(" "))
    exact = F.exists("d_names", lambda n: city.contains(F.concat(F.lit(" "), n, F.lit(" "))))
    inside = F.exists("d_names", lambda n: (n != "") & F.col("q_city").contains(n))
    best = F.coalesce(F.array_max(F.transform("d_grams", lambda g: containment(g, F.col("q_grams")))), F.lit(0.0))
    covered = F.size(F.filter(words, lambda t: F.exists("d_names", lambda n: n.contains(t))))
    one = lambda c: c.cast("double")
    return {
        "city_exact_match": one(exact),
        "city_substr_match": one(exact | inside),
        "city_ngram_containment": best,
        "city_token_cover": F.when(F.size(words) > 0, covered / F.size(words)).otherwise(F.lit(0.0)),
        "country_match": F.when((F.size("q_codes") > 0) & (F.size("d_codes") > 0), one(F.arrays_overlap("q_codes", "d_codes"))).otherwise(F.lit(-1.0)),
        "has_country_span": one(F.col("q_has_country")),
        "admin1_substr_match": one((F.col("d_admin1") != "") & F.col("q_admin1").contains(F.col("d_admin1"))),
        "admin1_ngram_containment": containment(F.col("d_admin1_grams"), gram_set("q_admin1")),
        "has_admin1_span": one(F.col("q_has_admin1")),
    }


def build_features(results: DataFrame, queries: DataFrame, documents: DataFrame, lookup: list[tuple[str, str]], on: str = "request_id", key: str = "geonameid") -> DataFrame:
    """results (on, key, population and others) with their query's and document's columns and the numeric features.

    Both joins are on ids. Queries come first, as short texts; the places' grams are joined last and are never moved with
    a pair.
    """
    full = results.join(parsed_queries(queries, lookup), on).join(parsed_documents(documents, lookup), key)
    # a generator between the grams and their use, else the optimiser would make them anew for each of a place's names
    full = full.select("*", F.inline(F.array(F.struct(gram_set("q_city").alias("q_grams")))))
    keep = [c for c in dict.fromkeys([*results.columns, *queries.columns, "document"]) if c != "population"]
    return full.select(*keep, log_population(F.col("population")).alias("log_population"), *[c.alias(n) for n, c in match_columns().items()])
