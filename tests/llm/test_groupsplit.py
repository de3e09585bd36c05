import random
from collections import Counter, defaultdict

from placeloom.llm import groupsplit as G
from placeloom.operators.components import components

SCHEMA = "request_id bigint, query string, name string, sample_source string, split string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, q, n, "s", "old", "x") for i, q, n in rows], SCHEMA)


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    norm = lambda s: " ".join(s.replace(" ", " ").lower().split())
    for i, q, n in rows:
        find(("i", i))
        keys = [("q", norm(q))] if q and norm(q) else []
        keys += [("n", norm(p)) for p in (n or "").split(",") if norm(p)]
        for k in keys:
            parent[find(k)] = find(("i", i))
    least = defaultdict(lambda: 1 << 60)
    for i, _, _ in rows:
        least[find(("i", i))] = min(least[find(("i", i))], i)
    return {i: least[find(("i", i))] for i, _, _ in rows}


def test_groups_against_union_find(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        n = ", ".join(rng.sample([f"N{k}" for k in range(150)], rng.choice([1, 1, 1, 2]))) if rng.random() < 0.7 else rng.choice([None, "", " , "])
        rows.append((i, rng.choice([f"q {rng.randint(0, 250)}", f"Q {rng.randint(0, 250)} ", None, ""]), n))
    rows += [rows[5], (7, "q 1", "N3"), (7, "q 2", None)]
    got = {r["id"]: r["group_id"] for r in G.related_groups(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (None, 3), (1000, 1001)], "a int, b int")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 303


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(4)
    rows = [(i, f"q{i}", f"n{rng.randint(0, 700)}") for i in range(3000)]
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split string, proportion double")
    got = G.group_splits(frame(spark, rows), targets).collect()
    assert len(got) == 3000
    sides = defaultdict(set)
    for r in got:
        sides[r["group_id"]].add(r["split"])
    assert all(len(s) == 1 for s in sides.values())
    n = Counter(r["split"] for r in got)
    assert abs(n["train"] - 2400) < 20 and abs(n["test"] - 300) < 20
    assert G.group_splits(frame(spark, []), targets).count() == 0


def test_allocation():
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    bundles = [(500, "a", 1), (1, "a", 300), (2, "b", 100)]
    got = G.allocate(bundles, shares)
    assert [sum(r) for r in got] == [1, 300, 100] and got[0] == [1, 0, 0]
    totals = [sum(r[j] * b[0] for r, b in zip(got, bundles)) for j in range(3)]
    assert totals == [800, 100, 100]


def test_min_cost_flow():
    flow = G.min_cost_flow(4, [(0, 1, 2, 1), (0, 2, 2, 0), (1, 3, 2, 0), (2, 3, 1, 0), (2, 1, 2, 0)], 0, 3)
    assert flow[2] + flow[3] == 3 and flow[0] == 1
