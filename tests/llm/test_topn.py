import math
import random

import pytest

from placeloom.llm.topn import top_items

SCHEMA = "request_id bigint, geonameid bigint, retriever_score double, population long, rank string"


def brute(rows, n):
    best = {}
    for g, i, s, p, _ in rows:
        if g is None or i is None or s is None or math.isnan(s):
            continue
        k = (-s, -(p or 0), i)
        if (g, i) not in best or k < best[g, i]:
            best[g, i] = k
    out = []
    for g in {g for g, _ in best}:
        out += [(g, i, -k[0], -k[1], r + 1) for r, (k, i) in enumerate(sorted((k, i) for (h, i), k in best.items() if h == g)[:n])]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 5])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*range(9), None]), rng.choice([None, float("nan"), 0.0, 1.0, 2.5, -1.0]), rng.choice([None, 0, 5, 9]), "r") for _ in range(600)]
    rows += rows[:50]
    got = sorted(tuple(r) for r in top_items(spark.createDataFrame(rows, SCHEMA), "request_id", "geonameid", "retriever_score", "population", n).collect())
    assert got == brute(rows, n)


def test_zero_signs_empty_and_bad_n(spark):
    df = spark.createDataFrame([(1, 2, -0.0, 1, ""), (1, 1, 0.0, 1, "")], SCHEMA)
    assert [r["geonameid"] for r in top_items(df, "request_id", "geonameid", "retriever_score", "population", 1).collect()] == [1]
    assert top_items(spark.createDataFrame([], SCHEMA), "request_id", "geonameid", "retriever_score", "population").count() == 0
    with pytest.raises(ValueError):
        top_items(df, "request_id", "geonameid", "retriever_score", "population", 0)


def test_plan_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 2, 1.0, 1, "")], SCHEMA)
    plan = top_items(df, "request_id", "geonameid", "retriever_score", "population")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
