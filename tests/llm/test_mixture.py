import numpy as np
import pytest

from placeloom.llm import mixture as M

TARGETS = "source string, target_weight double, max_repeats int"


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 200, 400).astype(float)
    p = np.full(400, 0.37)
    out = M.flight(p, x, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * x).sum() - (p * x).sum()) < 1e-4
    means = np.mean([M.flight(np.full(12, 0.25), x[:12], np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.abs(means - 0.25).max() < 0.04
    assert M.flight(np.zeros(0), np.zeros(0), rng).size == 0
    equal = M.flight(np.full(9, 1 / 3), np.full(9, 5.0), rng)
    assert abs(equal.sum() - 3) < 1e-9


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "word " * (1 + i % 17), "a", "z") for i in range(600)] + [(1000 + i, "word " * 10, "b", "z") for i in range(20)] + [(2000, None, "a", ""), (2001, "", None, ""), (2002, "x " * 900, "c", "")] + [(3000 + i, "same text", "c", "") for i in range(500)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens string")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("a", 0.5, 3), ("b", 0.2, 2), ("c", 0.25, 4), ("none", 0.05, 3)], TARGETS)


def test_mix(docs, targets):
    used, report = M.mix(docs, targets)
    got = {r["source"]: r for r in report.collect()}
    assert {s for s, r in got.items() if r["short"]} == {"b", "none"}
    for s in ("a", "c"):
        assert abs(got[s]["mix_tokens"] - got[s]["wanted_tokens"]) < 0.02 * got[s]["wanted_tokens"] + 10
    assert got["b"]["mix_tokens"] == 2 * got["b"]["own_tokens"] and got["none"]["mix_tokens"] == 0
    caps = {"a": 3, "b": 2, "c": 4}
    rows = used.collect()
    assert all(1 <= r["repeats"] <= caps[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    assert {tuple(r) for r in rows} == {tuple(r) for r in M.mix(docs.repartition(5), targets)[0].collect()}
    assert abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9


def test_several_levels(docs, targets, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 40)
    got = {r["source"]: r for r in M.mix(docs, targets)[1].collect()}
    assert abs(got["a"]["mix_tokens"] - got["a"]["wanted_tokens"]) < 0.02 * got["a"]["wanted_tokens"] + 10


def test_empty(docs, targets):
    used, report = M.mix(docs.limit(0), targets)
    assert used.count() == 0 and report.count() == 4
    assert M.shortfalls(docs.limit(0), targets).filter("short").count() == 0


def test_lead_flight_keeps_tokens_and_probabilities():
    x, p, rest = [900.0, 500.0, 20.0, 20.0], 0.3, 4000.0
    runs = []
    for s in range(4000):
        out, common = M.lead_flight(x, p, rest, np.random.default_rng(s).random(4).tolist())
        assert abs(sum(a * b for a, b in zip(out, x)) + common * rest - p * (sum(x) + rest)) < 1e-6
        assert all(v in (0.0, 1.0) for v in out) and 0 <= common <= 1
        runs.append([*out, common])
    assert np.abs(np.mean(runs, axis=0) - p).max() < 0.03
    # nothing else to balance with: the record lands
    assert M.lead_flight([5.0], 0.4, 0.0, [0.1])[0] == [1.0] and M.lead_flight([5.0], 0.4, 0.0, [0.5])[0] == [0.0]
    # more than the smaller ones hold: they give all they have
    assert M.lead_flight([900.0], 0.3, 100.0, [0.1]) == ([1.0], 0.0)


def test_one_giant_record(spark, targets):
    rows = [(i, "word " * 5, "a") for i in range(3000)] + [(9999, "word " * 4000, "a"), (5000, "x", None)] + [(4000 + i, "word " * 5, "c") for i in range(300)]
    used, report = M.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), targets)
    got = {r["source"]: r for r in report.collect()}
    assert abs(got["a"]["mix_tokens"] - got["a"]["wanted_tokens"]) < 0.002 * got["a"]["wanted_tokens"] + 20
