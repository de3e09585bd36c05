import random
import unicodedata

from placeloom.llm import lookalike as L

NAMES = "geonameid bigint, name_id bigint, name string, form string, look string"


def run(spark, rows):
    df = spark.createDataFrame(rows, "geonameid bigint, name_id bigint, name string")
    return {(r["geonameid"], r["name_id"]): r for r in L.consistent_names(df).collect()}


def test_plain_form():
    assert L.plain_form("Ｒｕｖａ　 Falls​") == "Ruva Falls"
    assert L.plain_form("Gölü") == "Gölü"
    assert L.plain_form("Hiﬁgiya") == "Hifigiya" and L.plain_form("雲⼝") == "雲口"
    assert L.plain_form("a‐b‑c－d") == "a-b-c-d"
    assert L.plain_form("  ‍ ") == ""
    assert L.plain_form("pınar") != L.plain_form("pinar") and L.plain_form("е") != L.plain_form("ё")


def test_mixed_tokens_follow_the_vocabulary(spark):
    got = run(spark, [(1, 1, "Бугухиград"), (1, 2, "Bугухигpaд"), (1, 3, "Bугу"), (2, 1, "New Town"), (2, 2, "Νew Tοwn"), (3, 1, "Xiao"), (3, 2, "Хіао")])
    assert got[1, 2]["form"] == "Вугухиград" or got[1, 2]["form"] == "Bугухигpaд"
    assert got[2, 2]["form"] == "New Town"
    assert got[1, 3]["form"] == "Bугу"  # no word of the corpus, so it stays
    assert got[3, 1]["look"] == got[3, 2]["look"]


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    base = ["Ruvate Falls", "Сосновка", "Saint-Vera", "Gölü pınar", "雲口"]
    noise = [lambda s: s, lambda s: s + "​", lambda s: s.replace("a", "а"), lambda s: s.replace(" ", " "), lambda s: unicodedata.normalize("NFD", s), lambda s: s.upper(), lambda s: s.replace("-", "‐"), lambda s: s + " "]
    rows = [(rng.randint(1, 6), i, rng.choice(noise)(rng.choice(base))) for i in range(1, 160)] + [(1, 900, None), (1, 901, ""), (1, 902, " ​"), (2, 5, "Ruvate Falls"), (2, 5, "Ruvate Falls")]
    named = L.consistent_names(spark.createDataFrame(rows, "geonameid bigint, name_id bigint, name string"))
    got = {tuple(r) for r in L.same_looking(named).collect()}
    look = lambda s: L.look_key(L.plain_form(s))
    want = {(g, a, b) for g, a, x in rows for h, b, y in rows if g == h and a < b and x and y and look(x) and x != y and look(x) == look(y)}
    assert got == want and want


def test_links_empty_tables_and_extra_columns(spark):
    geo = spark.createDataFrame([(1, "A", "x"), (1, "A", "y"), (None, "B", "z")], "geonameid bigint, name string, look string")
    alt = spark.createDataFrame([(5, 1, "link", "http://a"), (6, 1, None, "Ａ"), (7, 1, "en", None)], "alternate_name_id bigint, geonameid bigint, isolanguage string, alternate_name string")
    names = L.place_names(geo, alt)
    assert {tuple(r) for r in names.collect()} == {(1, 0, "A"), (1, 6, "Ａ")}
    assert [tuple(r) for r in L.same_looking(L.consistent_names(names)).collect()] == [(1, 0, 6)]
    empty = spark.createDataFrame([], "geonameid bigint, name_id bigint, name string")
    assert L.same_looking(L.consistent_names(empty)).count() == 0


def test_long_text(spark):
    got = run(spark, [(1, 1, "a​" * 50_000), (1, 2, "a" * 50_000)])
    assert got[1, 1]["form"] == got[1, 2]["form"] == "a" * 50_000


def test_repair_decides(spark, monkeypatch):
    # Cyrillic with one Latin letter: only the vocabulary shows that it is Cyrillic, as most of its letters have no Latin twin
    rows = [(1, 1, "Москва"), (1, 2, "Мoсква"), (2, 1, "Мoсквич")]
    named = run(spark, rows)
    assert named[1, 2]["form"] == named[1, 2]["look"] == "Москва" and named[2, 1]["form"] == "Мoсквич" != named[2, 1]["look"]
    df = spark.createDataFrame(rows, "geonameid bigint, name_id bigint, name string")
    assert L.same_looking(L.consistent_names(df)).count() == 1
    table = L.look_alikes() | {("о", "Latin"): "о", ("o", "Cyrillic"): "x"}  # a table without the pair repairs nothing
    assert L.same_looking(L.consistent_names(df, swap=table)).count() == 0
    assert {r["step"]: r["names"] for r in L.repair_report(L.consistent_names(df)).collect()} == {"kept": 1, "rewritten": 1, "keyed": 1}


def test_public_table(spark):
    table = L.public_table(spark)
    assert L.look_alikes().items() <= table.items()
    for a, b in ("ρp", "νv", "υu", "ԚQ", "ԜW", "ՕO", "ᎪA", "օo"):
        assert table[a, "Latin"] == b
    assert all(a not in "ιг" and (a, b) != ("ı", "i") for (a, _), b in table.items())
    got = run(spark, [(1, 1, "Pavup"), (1, 2, "ρavup"), (1, 3, "Pavυp"), (2, 1, "Paris"), (2, 2, "\U0001d40faris"), (3, 1, "邊\U000e0100界"), (3, 2, "邊界"), (4, 1, "xо"), (5, 1, "pavup")])
    assert got[1, 2]["look"] == "pavup" and got[1, 3]["form"] == "Pavup" and got[2, 2]["form"] == "Paris" and got[3, 1]["form"] == "邊界"


def test_classes(spark):
    named = L.consistent_names(spark.createDataFrame([(1, 1, "A b"), (1, 2, "A  b"), (1, 3, "Ａ b"), (1, 4, "A b"), (1, 5, None)], "geonameid bigint, name_id bigint, name string"))
    classes, members = L.look_classes(named)
    assert [tuple(r) for r in classes.collect()] == [(1, "A b", 4, 3)] and members.count() == 4
