import pyarrow as pa
from pyspark.sql import functions as F

from placeloom.functions.text import country_flag
from placeloom.plans.messages import user_message
from placeloom.sources.arrow import ordinary_table


def test_ordinary_types():
    deep = pa.large_list(pa.struct([("text", pa.large_string()), ("tags", pa.map_(pa.large_string(), pa.large_list(pa.int64())))]))
    t = pa.table({"q": pa.array(["я", None], pa.large_string()), "e": pa.array([[{"text": "a", "tags": [("k", [1])]}], None], deep), "b": pa.array([b"x", None], pa.large_binary())})
    out = ordinary_table(t)
    assert "large" not in str(out.schema) and out.to_pylist() == t.to_pylist() and ordinary_table(out) is out


def test_messages_and_flags(spark):
    rows = [("one_city", "en", "Rome", "x", "y", "search", "food"), ("multi_city", "en", "Rome, Milan", None, None, None, "food"), ("city_admin1_country", "ru", None, "Lazio", "Italy", "rich", "news"), ("planet", "en", "Mars", None, None, None, None), (None,) * 7]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string")
    got = [r[0] for r in df.select(user_message(*map(F.col, "abcdefg"))).collect()]
    assert got == ["language: en\nname: Rome\nstyle: search\ntopic: food", "language: en\nnames: Rome, Milan\nstyle: \ntopic: food", "language: ru\nname: \nregion: Lazio\ncountry: Italy\nstyle: rich\ntopic: news", None, None]
    flags = spark.createDataFrame([("tr",), ("USA",), (None,), ("1a",)], "c string").select(country_flag(F.col("c")))
    assert [r[0] for r in flags.collect()] == ["🇹🇷", "", "", ""]


def test_system_messages(spark):
    from placeloom.plans.messages import system_message

    kinds = ["one_city", "multi_city", "city_admin1", "city_country", "city_admin1_country"]
    got = {r["k"]: r["m"] for r in spark.createDataFrame([(k,) for k in [*kinds, "planet", None]], "k string").select("k", system_message(F.col("k")).alias("m")).collect()}
    assert len({got[k] for k in kinds}) == 5 and got["planet"] is None and got[None] is None
    assert "No entity has the label COUNTRY." in got["city_admin1"] and "Exactly one entity has the label REGION" in got["city_admin1"]


def test_case_folding_and_lists(spark):
    from placeloom.functions.text import casefold, quoted_list

    words = ["STRASSE", "Straße", "ΟΔΟΣ", "ı", "İ", ""]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(casefold("w")).collect()] == [w.casefold() for w in words]
    lists = [["a", "it's"], ['"', "'\""], [], ["x\\y"], ["a\nb"]]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in lists], "x array<string>").select(quoted_list(F.col("x"))).collect()] == [str(x) for x in lists]
