import pytest
from pyspark.sql import functions as F

from placeloom.functions.text import norm
from placeloom.operators import features as X
from placeloom.operators import pairs

LOOKUP = sorted({"russia": "RU", "россия": "RU", "rusya": "RU", "united states": "US", "соединенные штаты": "US", "china": "CN", "中国": "CN", "ru": "RU", "us": "US", "cn": "CN"}.items())
PAIRS = "city_entities string, country_entities string, admin1_entities string, document string, population bigint, retriever_score double, retriever_rank double"


def grams(t):
    return set() if not t else {t} if len(t) <= 3 else {t[i : i + 3] for i in range(len(t) - 2)}


def part(a, b):
    return len(a & b) / len(a) if a else 0.0


def codes(t):
    return {c for n, c in LOOKUP if f" {n} " in f" {t} "}


def brute(city, country, admin1, doc):
    city, country, admin1 = city or "", country or "", admin1 or ""
    lines = (doc or "").split("\n")
    names = [n for n in map(norm, lines[0].split(" | ")) if n]
    q, a, d = norm(city), norm(admin1), norm(lines[2]) if len(lines) > 2 else ""
    exact = any(f" {n} " in f" {q} " for n in names)
    qc, dc = codes(norm(country)), codes(norm(lines[1]) if len(lines) > 1 else "")
    toks = q.split()
    return (
        float(exact), float(exact or any(n in q for n in names)), max([part(grams(n), grams(q)) for n in names], default=0.0), sum(any(t in n for n in names) for t in toks) / len(toks) if toks else 0.0,
        float(bool(qc & dc)) if qc and dc else -1.0, float(bool(country.strip())), float(bool(d) and d in a), part(grams(d), grams(a)), float(bool(admin1.strip())),
    )


CASES = [
    ("Литл Роке", "США", "", "Little Rock | Литл-Рок\nUnited States\nArkansas"), ("Van Gölü", "", "", "Van\nTurkey\nVan"), ("Москва Казань", "Россия", None, "Moscow | Москва\nRussia\nMoscow"),
    ("上海市", "中国", "", "Shanghai | 上海\nChina\nShanghai"), ("Moscow", "china", "Idaho", "Moscow\nUnited States\nIdaho"), ("pınar", "", "", "Pinar"), ("x", "chinatown", " ", "x\nChina"), ("", "", "", ""), (None, None, None, None), ("abc", "RU", "ab", "abcd | ab\nRU\nab"),
    ("a b c", "united states", "new york state", "b | c d\nUnited States\nNew York"), ("York", "", "", " | \n\n"),
]


def test_match_features(spark):
    df = spark.createDataFrame([(*c, i * 10 - 20, 1.5, float(i)) for i, c in enumerate(CASES)], PAIRS).withColumns({"request_id": F.col("retriever_rank").cast("int"), "geonameid": F.col("retriever_rank").cast("int")})
    asked, told = df.select("request_id", "city_entities", "country_entities", "admin1_entities"), df.select("geonameid", "document")
    got = {r["retriever_rank"]: r for r in X.build_features(df.select("request_id", "geonameid", "population", "retriever_rank"), asked, told, LOOKUP).collect()}
    assert len(got) == len(CASES)
    for i, c in enumerate(CASES):
        assert tuple(got[float(i)][n] for n in X.MATCH_FEATURES) == pytest.approx(brute(*c)), c
    assert got[0.0]["log_population"] == 0.0 and got[3.0]["log_population"] > 2


def test_country_names(spark):
    names = X.country_names(spark)
    look = dict(X.country_lookup(names))
    assert look["russia"] == "RU" and look["россия"] == "RU" and look["cn"] == "CN" and look["united states"] == "US"


def test_pairs_and_split(spark):
    results = spark.createDataFrame([(1, 1, 7, 2.0, 5), (1, 2, 8, 1.0, 5), (1, 3, 9, 1.0, None), (2, 1, 7, 1.0, 5)], "request_id bigint, rank int, geonameid bigint, score double, population bigint")
    asked = spark.createDataFrame([(1, "q one", "Van", "", "", [9]), (2, "q two", None, None, None, None)], "request_id bigint, query string, city_entities string, country_entities string, admin1_entities string, geonameid array<bigint>")
    desc = spark.createDataFrame([(7, "Van"), (9, "Van | W")], "geonameid bigint, description string")
    got = sorted((r["request_id"], r["geonameid"], r["retriever_rank"], r["label"]) for r in pairs.build_pairs(results, asked, desc, LOOKUP).collect())
    assert got == [(1, 7, 0.0, 0), (1, 9, 2.0, 1), (2, 7, 0.0, 0)]  # a gap where a description lacks
    shown = {(r["request_id"], r["geonameid"]): r["document"] for r in pairs.with_documents(results, desc).collect()}
    assert shown == {(1, 7): "Van", (1, 8): "", (1, 9): "Van | W", (2, 7): "Van"}
    seen = pairs.first_seen(spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, None)], "i int, q string"), "q", "i")
    assert sorted((r["i"], r["q"]) for r in seen.collect()) == [(1, "b"), (2, "a"), (4, None)]
    many = spark.range(4000).select(F.concat(F.lit("q"), (F.col("id") % 2000).cast("string")).alias("query"))
    split = pairs.split_by_query(many)
    assert split.groupBy("query").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert 600 < split.filter("split = 'test'").count() < 1000
