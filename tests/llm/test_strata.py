from collections import Counter

import pytest

from placeloom.llm import strata
from placeloom.llm.strata import drawn_report, quota_report, sample_to_targets

PLAN = "request_id bigint, isolanguage string, sample_source string, pool string, draw string"
TARGETS = "isolanguage string, sample_source string, pool string, target_share double, min_rows int"


@pytest.fixture(scope="module")
def plan(spark):
    rows = [(i, " EN " if i % 2 else "en", "one", "all", "x") for i in range(1000)] + [(2000 + i, "ru", "one", "all", "x") for i in range(30)] + [(5000 + i, None, "one", "all", "x") for i in range(470)]
    return spark.createDataFrame(rows + rows[:200], PLAN)


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("en", "one", "all", 0.7, 2), ("ru", "one", "all", 0.3, 2), ("tr", "one", "all", 0.0, 3)], TARGETS)


def test_report(plan, targets):
    got = {r["isolanguage"]: r for r in quota_report(plan, targets).collect()}
    assert got["en"]["size"] == 300 and got["en"]["quota"] == 210 and got["en"]["deficit"] == 0
    assert (got["ru"]["observed"], got["ru"]["quota"], got["ru"]["deficit"]) == (30, 90, 60)
    assert (got["tr"]["taken"], got["tr"]["deficit"]) == (0, 3)


def test_sample_is_exact_and_repeatable(plan, targets):
    a = sample_to_targets(plan, targets).collect()
    assert Counter(r["isolanguage"] for r in a) == {"en": 210, "ru": 30}
    assert len({r["request_id"] for r in a}) == len(a)
    assert {tuple(r) for r in a} == {tuple(r) for r in sample_to_targets(plan.repartition(7), targets).collect()}
    assert {tuple(r) for r in a} != {tuple(r) for r in sample_to_targets(plan, targets, seed=3).collect()}


def test_empty(spark, targets):
    empty = spark.createDataFrame([], PLAN)
    assert sample_to_targets(empty, targets).count() == 0
    assert {r["isolanguage"]: r["deficit"] for r in quota_report(empty, targets).collect()} == {"en": 2, "ru": 2, "tr": 3}


def test_drawn_report_counts_the_sample(plan, targets):
    got = {r["isolanguage"]: (r["observed"], r["quota"], r["taken"], r["deficit"]) for r in drawn_report(plan, targets).collect()}
    assert got == {"en": (1000, 210, 210, 0), "ru": (30, 90, 30, 60), "tr": (0, 3, 0, 3)}
    with pytest.raises(ValueError):
        sample_to_targets(plan, targets.sparkSession.range(strata.MAX_STRATA + 1).selectExpr("string(id) as isolanguage", "'a' as sample_source", "'b' as pool", "0.0D as target_share", "1 as min_rows"))
