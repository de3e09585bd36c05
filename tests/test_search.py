import random
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from placeloom.operators import bm25, names, search

NAMES = ["Moscow", "Moskva", "Москва", "莫斯科", "New York", "New York City", "Kazan", "Казань", "Rostov-na-Donu", "ab", "a", "İzmir", "York", "Newark"]
QUERIES = ["moscow", "new york", "york york", "zzz", "莫斯科", "ab", "москва казань", "rostov", ""]


def grams(t):
    return [w[i : i + 3] for w in t.lower().strip().split() for i in range(max(len(w) - 2, 1))]


def brute(q):
    docs = {n: grams(n) for n in NAMES}
    avg = sum(map(len, docs.values())) / len(docs)
    out = {}
    for n, g in docs.items():
        tf, s = Counter(g), 0
        for t in grams(q):
            if tf[t]:
                s += math.floor(tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(g) / avg)) * 1e12 + 0.5)
        out[n] = s / 1e12
    return out


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(q,) for q in QUERIES], "q string"), spark.createDataFrame([(n,) for n in NAMES], "name string")


def test_scores(frames):
    q, n = frames
    got = {(r["q"], r["doc"]): r["score"] for r in bm25.scores(q, bm25.postings(n), bm25.average_length(n)).collect()}
    want = {(x, d): s for x in QUERIES for d, s in brute(x).items() if s}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-11 for k in want)


@pytest.mark.parametrize("k", [1, 5, 14, 40])
def test_top_names(frames, k):
    q, n = frames
    got = {}
    for r in bm25.top_names(q, bm25.forward_index(n), k).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["doc"]))
    for x in QUERIES:
        want = sorted(brute(x).items(), key=lambda d: (-d[1], d[0].encode()))[:k]
        assert sorted(got[x]) == [(i + 1, d) for i, (d, _) in enumerate(want)]


def test_top_names_in_many_cells(spark):
    rng = random.Random(8)
    names = ["".join(rng.choices("abç", k=rng.randint(1, 7))) + rng.choice(["", " ab", " 漢字 x"]) for _ in range(400)] + ["", " "]
    asked = list({"".join(rng.choices("abç ", k=rng.randint(1, 9))) for _ in range(60)})
    q, n = spark.createDataFrame([(x,) for x in asked], "q string"), spark.createDataFrame([(x,) for x in names], "name string")
    few = {tuple(r) for r in bm25.top_names(q, bm25.forward_index(n), 7).collect()}
    many = {tuple(r) for r in bm25.top_names(q, bm25.forward_index(n), 7, shard=50, block=9).collect()}
    full = {}
    for r in bm25.scores(q, bm25.postings(n), bm25.average_length(n)).collect():
        full.setdefault(r["q"], []).append((-r["score"], r["doc"].encode()))
    want = {(x, d.decode(), -s, k + 1) for x, found in full.items() for k, (s, d) in enumerate(sorted(found)[:7])}
    assert few == many and {r for r in few if r[2] > 0} == want
    assert bm25.top_names(q, bm25.forward_index(n.limit(0)), 3).count() == 0 and bm25.top_names(q.limit(0), bm25.forward_index(n), 3).count() == 0


def test_a_repeated_term_counts_twice(frames):
    assert brute("york york")["York"] == 2 * brute("york")["York"]


PLACES = "geonameid bigint, asciiname string, country_code string, population bigint, feature_code string, latitude double, longitude double"


def test_search_batch(spark):
    named = spark.createDataFrame([("Moscow", 1, 10), ("Moscow", 2, 10), ("Moscow", 3, None), ("Moskva", 1, 10), ("Kazan", 4, 5)], "name string, geonameid bigint, population bigint")
    places = spark.createDataFrame([(1, "M", "RU", 10, None, None, None), (2, "M", "US", 10, None, None, None), (4, "K", "RU", None, None, None, None)], PLACES)
    q = spark.createDataFrame([("moscow",), ("  ",), (None,), ("zzz",)], "q string")
    got = {}
    for r in search.search_batch(q, named, places, 3).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["geonameid"]))
    assert set(got) == {"moscow", "zzz"}  # a blank query has none, an unknown one takes names at score 0
    assert sorted(got["moscow"])[:2] == [(1, 1), (2, 2)]  # homonyms tie, the smaller id first; place 3 isn't known
    flipped = search.search_batch(q, named, places, 3, rerank=lambda df: df.withColumn("rerank_score", F.col("geonameid").cast("double")))
    assert sorted((r["rank"], r["geonameid"]) for r in flipped.filter("q = 'moscow'").collect())[0][1] == 4
    with pytest.raises(ValueError):
        search.search_batch(q, named, places, 101)
    assert search.hydrate(spark.createDataFrame([(1,), (1,), (9,)], "geonameid bigint"), places).count() == 1


GEO = "geonameid bigint, name string, asciiname string, country_code string, feature_code string, admin1_code string, population bigint, latitude double, longitude double"


def test_projections(spark):
    geo = spark.createDataFrame([(1, "Köy", "Koy", "TR", "PPL", "01", 5, None, None), (2, "Same", "Same", "TR", "PPL", None, None, None, None), (3, "Null", "Null", "TR", None, "01", 1, None, None), (4, "Old", "Old", "TR", "PPLH", "01", 1, None, None), (5, "Far", "Far", "DE", "PPL", "01", 1, None, None)], GEO)
    alt = spark.createDataFrame([(1, 1, "ru", "Кёй"), (2, 1, "de", "Dorf"), (3, 9, "ru", "Нет"), (4, 1, "ru", "Кёй"), (5, 1, "tr", None)], "alternate_name_id bigint, geonameid bigint, isolanguage string, alternate_name string")
    scope = names.in_scope(geo)
    assert {r["geonameid"] for r in scope.collect()} == {1, 2}
    rows = names.name_rows(scope, alt)
    assert sorted((r["geonameid"], r["name"], r["isolanguage"]) for r in rows.collect()) == [(1, "Koy", "en"), (1, "Köy", "en"), (1, "Кёй", "ru"), (2, "Same", "en")]
    groups = {r["name"]: [tuple(p) for p in r["places"]] for r in names.name_groups(rows).collect()}
    assert groups["Same"] == [(2, 0)]
    admin1 = spark.createDataFrame([("TR", "01", "Adana")], "country_code string, admin1_code string, admin1_name string")
    titles = spark.createDataFrame([("en", "TR", "Turkey")], "language string, country_code string, country_name string")
    got = {r["geonameid"]: r["description"] for r in names.descriptions(rows, admin1, titles).collect()}
    assert got == {1: "Koy | Köy | Кёй\nTurkey\nAdana", 2: "Same\nTurkey"}


def test_artifacts(spark, tmp_path):
    import json

    from placeloom.plans import artifacts as A
    from placeloom.sources.dumps import NotBuiltError

    geo = spark.createDataFrame([(1, "Köy", "Koy", "TR", "PPL", "01", 5, None, None)], GEO)
    alt = spark.createDataFrame([], "alternate_name_id bigint, geonameid bigint, isolanguage string, alternate_name string")
    admin1 = spark.createDataFrame([("TR", "01", "Adana")], "country_code string, admin1_code string, admin1_name string")
    path = str(tmp_path / "set")
    with pytest.raises(NotBuiltError):
        A.load(spark, path)
    made = A.build(geo, alt, admin1, path)
    assert (made["n_documents"], made["n_places"], made["n_descriptions"]) == (2, 1, 1)
    manifest, tables = A.load(spark, path, countries=["CN", "US", "TR", "RU"])
    assert manifest == made and tables["places"].count() == 1
    asked = spark.createDataFrame([("köy",), (" ",)], "q string")
    assert [(r["q"], r["geonameid"], r["document"]) for r in A.search(spark, path, asked, 3).collect()] == [("köy", 1, "Koy | Köy\nTurkey\nAdana")]
    texts = spark.createDataFrame([(1, "trains to Köy today"), (2, "trains"), (3, "Köy"), (4, None)], "request_id bigint, query string")
    assert sorted((r["request_id"], r["q"], r["geonameid"], r["rank"]) for r in A.answer(spark, path, texts, k=3).collect()) == [(1, "Köy", 1, 1), (3, "Köy", 1, 1)]
    with pytest.raises(A.StaleSetError):
        A.load(spark, path, countries=["RU"])
    (tmp_path / "set" / "manifest.json").write_text(json.dumps(made | {"build_id": "other"}))
    (tmp_path / "set" / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(A.StaleSetError):
        A.load(spark, path)


def test_scores_are_not_shuffled(spark):
    # every query meets every name; only texts are shuffled, once for each cell
    n = spark.range(900).select(F.format_string("abc %03d", "id").alias("doc"))
    q = spark.range(400).select(F.format_string("abc q%d", "id").alias("q"))
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled() -> int:
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    index, mean = bm25.postings(n, "doc").cache(), bm25.average_length(n, "doc")
    index.count()
    before = shuffled()
    got = bm25.scores(q, index, mean).groupBy().agg(F.count("score"), F.sum("score")).first()
    assert got[0] == 360_000 and shuffled() - before < 50_000
    # the same over plain names, and in small cells
    assert bm25.scores(q, n, mean, shard=100, block=30).groupBy().agg(F.count("score"), F.sum("score")).first()[0] == 360_000
    one = {tuple(r) for r in bm25.scores(q, index, mean).collect()}
    assert one == {tuple(r) for r in bm25.scores(q, n, mean, shard=100, block=30).collect()}
    # without some terms, a name is as long as before
    assert {tuple(r) for r in bm25.scores(q, index.filter("term = 'abc'"), mean).collect()} == {(r.q, r.doc, r.score) for r in bm25.scores(q.select(F.lit("abc").alias("q")), index, mean).withColumnRenamed("q", "__q").crossJoin(q).collect()}
    values = spark.createDataFrame([(0.1234565,), (1.0000005,), (2.9999995,), (123.4567885,), (0.0,), (4321.1234565,)], "s double")
    assert values.filter(bm25.rounded("s") != F.round("s", 6)).count() == 0


def test_scores_keep_texts_once(spark):
    # 9 shards and 40 blocks: what is shuffled does not grow with the cells
    n = spark.range(900).select(F.format_string("abc %03d", "id").alias("doc"))
    q = spark.range(400).select(F.format_string("abc q%d", "id").alias("q"))
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled() -> int:
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    assert bm25.scores(q, n, 5.0, shard=100, block=10).groupBy().agg(F.count("score")).first()[0] == 360_000
    assert shuffled() - before < 10_000


def test_scores_in_batches(spark, monkeypatch):
    # a query meets more names than a batch has pairs; blank, null and unknown texts meet none
    monkeypatch.setattr(bm25, "PAIRS", 7)
    n = spark.createDataFrame([(x,) for x in [*(f"abc{i:02d}" for i in range(20)), " ", None, "xyz", "xyz"]], "doc string")
    q = spark.createDataFrame([(x,) for x in ["abc", "ab", "xyz abc", "", None, "qqq", "abc"]], "q string")
    mean = bm25.average_length(n, "doc")
    got = [tuple(r) for r in bm25.scores(q, n, mean).collect()]
    pairs = {(a, f"abc{i:02d}") for a in ("abc", "xyz abc") for i in range(20)} | {("xyz abc", "xyz")}
    assert len(got) == 41 and {x[:2] for x in got} == pairs and len({x[2] for x in got if x[1] != "xyz"}) == 1
    assert bm25.scores(q.limit(0), n, mean).count() == bm25.scores(q, n.limit(0), 0.0).count() == 0
