import random

from placeloom.llm import overlap as O

SCHEMA = "request_id bigint, query string, name string, geonameid array<bigint>, split string, sample_source string, place string, train string"


def frame(spark, rows):
    return spark.createDataFrame([(i, q, n, g, s, "one", "p", "t") for i, q, n, g, s in rows], SCHEMA)


def pairs(spark, rows):
    return {tuple(r) for r in O.cross_split_pairs(frame(spark, rows)).collect()}


def osa(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def case(e, t):
    a, b = e.replace(" ", ""), t.replace(" ", "")
    if a == b or osa(a, b) <= O.slips(len(a)) or O.one_moved(e.split(), t.split()):
        return True
    x, y = e.split(), t.split()
    drop = lambda w: {"".join(w[:i] + w[i + 1 :]) for i in range(len(w)) if len(w) > 1}
    return a in drop(y) or b in drop(x)


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choices("abc", k=rng.randint(0, 9)))
        b = "".join(rng.choices("abc", k=rng.randint(0, 9)))
        k = rng.randint(0, 4)
        assert O.within(a, b, k) == (osa(a, b) <= k)


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = "markets open late near the old mill Hehele Falls by slow train on a budget 天海梅瀑布這週下雨嗎".split()

    def slip(s):
        i = rng.randrange(len(s))
        k = rng.randrange(4)
        return s[:i] + s[i + 1 :] if k == 0 else s[:i] + rng.choice("abх海 ") + s[i + (k == 2) :] if k < 3 else s[:i] + s[i : i + 2][::-1] + s[i + 2 :]

    rows = []
    for i in range(500):
        if i < 60 or rng.random() < 0.2:
            q = " ".join(rng.sample(words, rng.randint(1, 9)))
        else:
            q = rng.choice(rows)[1]
            for _ in range(rng.randint(0, 4)):
                q = slip(q) if q.strip() else "x"
            if rng.random() < 0.3:
                w = q.split()
                rng.random() < 0.5 and w.insert(rng.randint(0, len(w)), w.pop(rng.randrange(len(w)))) if w else None
                q = " ".join(w if rng.random() < 0.5 else [*w, "today"])
        rows.append((i, q, rng.choice(["A", None]), [rng.choice([1, 1, 2])], rng.choice(["train", "train", "test", "validation"])))
    df = frame(spark, rows + rows[:20])
    folded = {r["id"]: r["q"] for r in df.select(df.request_id.alias("id"), O.folded(df.query).alias("q")).collect()}
    got = {tuple(r) for r in O.cross_split_pairs(df).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[4] != "train" and b[4] == "train" and a[3] == b[3] and folded[a[0]] and folded[b[0]] and case(folded[a[0]], folded[b[0]])}
    assert got == want and len(want) > 100


def test_places_names_and_nulls(spark):
    q = "two quiet days around bibehaton with a tent"
    rows = [(1, q, "X", [7], "train"), (2, q.upper() + "!", None, [7], "test"), (3, q, "X", [8], "test"), (4, None, "X", [7], "test"), (5, "  ", "X", [7], "test"), (6, q, "X", [7], None), (7, q, " x ", None, "train"), (8, q, "X", [], "validation"), (9, q, None, None, "test"), (10, q, None, None, "train")]
    assert pairs(spark, rows) == {(2, 1), (8, 7), (9, 10)}


def test_report_and_empty(spark):
    rows = [(1, "abc def ghi", "X", [7], "train"), (2, "abc def ghi", "X", [7], "test"), (3, "other words here", "X", [7], "test")]
    assert [tuple(r) for r in O.overlap_report(frame(spark, rows)).collect()] == [("test", "one", 2, 1, 1)]
    assert pairs(spark, []) == set()


def test_very_long_queries(spark):
    q = "word " * 3000
    assert pairs(spark, [(1, q, "X", [7], "train"), (2, q[:-3], "X", [7], "test")]) == {(2, 1)}


def test_report_counts_the_pairs(spark):
    rng = random.Random(6)
    texts = ["abc def ghi", "abc def ghj", "other words here", "other words"]
    # some records come with several texts, in one split or in both
    rows = [(rng.randint(1, 40), rng.choice(texts), "X", [7], rng.choice(["train", "test", "validation"])) for _ in range(90)]
    df = frame(spark, rows)
    found = {tuple(r) for r in O.cross_split_pairs(df).collect()}
    want = {}
    for s in ("test", "validation"):
        ids = {i for i, _, _, _, x in rows if x == s}
        want[s] = (len(ids), len({e for e, _ in found if e in ids}), sum(e in ids for e, _ in found))
    assert {r["split"]: (r["records"], r["overlapping"], r["pairs"]) for r in O.overlap_report(df).collect()} == want
    classes, members = O.cross_split_classes(df)
    rows_of = {}
    for r in members.collect():
        rows_of.setdefault((r["place"], r["q"], r["train"]), set()).add(r["id"])
    assert {(e, t) for r in classes.collect() for e in rows_of[r["place"], r["eq"], False] for t in rows_of[r["place"], r["tq"], True]} == found


def test_steps_are_a_parameter(spark):
    rows = [(1, "abcdefgh", "X", [7], "train"), (2, "abcdefxx", "X", [7], "test"), (3, "abcdefgx", "X", [7], "test")]
    df = frame(spark, rows)
    assert {tuple(r) for r in O.cross_split_pairs(df).collect()} == {(2, 1), (3, 1)}
    assert {tuple(r) for r in O.cross_split_pairs(df, steps=((4, 1),)).collect()} == {(3, 1)}
