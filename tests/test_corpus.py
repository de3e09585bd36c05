import json
import zipfile

import pytest
from pyspark.sql import functions as F

from placeloom import schemas as S
from placeloom.operators import corpus as C
from placeloom.sources import dumps as D

PLACE = "geonameid bigint, name string, v int"
NAME = "alternate_name_id bigint, geonameid bigint, alternate_name string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (None, "n", 1)], PLACE)
    new = spark.createDataFrame([(2, "B", 2), (2, "B3", 3), (4, "d", 1)], PLACE)
    got = {tuple(r) for r in C.upsert(old, new, "geonameid", [F.desc("v")]).collect()}
    assert got == {(1, "a", 1), (2, "B3", 3), (4, "d", 1), (None, "n", 1)}
    assert {tuple(r) for r in C.upsert(old, new.limit(0), "geonameid").collect()} == {tuple(r) for r in old.collect()}


def test_delta_order(spark):
    places = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], PLACE)
    names = spark.createDataFrame([(10, 1, "x"), (11, 2, "y"), (12, 2, "z")], NAME)
    dead = spark.createDataFrame([(1,), (None,), (99,)], "geonameid bigint")
    dead_names = spark.createDataFrame([(12,)], "alternate_name_id bigint")
    change = spark.createDataFrame([(1, "a2", 2)], PLACE)
    change_names = spark.createDataFrame([(13, 1, "new"), (14, 77, "lost"), (11, 2, "Y")], NAME)
    p, n = C.apply_delta(places, names, deletes=dead, name_deletes=dead_names, changes=change, name_changes=change_names)
    assert rows(p) == [(1, "a2", 2), (2, "b", 1)]  # deleted and changed: it survives
    assert rows(n) == [(11, 2, "Y"), (13, 1, "new")]  # but its earlier names are gone
    p, n = C.apply_delta(places, names)
    assert rows(p) == rows(places) and rows(n) == rows(names)


LINE = ["5", "Nm", "Nm", "", "1.5", "", "P", "", "RU", "", "", "", "", "", "", "", "", "", "2020-02-03"]


def test_zip_and_lines(spark, tmp_path):
    other = ["6", *LINE[1:6], "A", *LINE[7:]]
    with zipfile.ZipFile(tmp_path / "RU.zip", "w") as z:
        z.writestr("RU.txt", "\n".join(["\t".join(LINE), "\t".join(other), "short\tline", "\t".join(["7", "with\rreturn", *LINE[2:]])]))
        z.writestr("readme.txt", "no")
    lines = D.zip_lines(spark, f"{tmp_path}/*.zip")
    got = {r["geonameid"]: r for r in D.places_of_lines(lines, ["RU"]).collect()}
    assert set(got) == {5, 7} and got[7]["name"] == "with\rreturn"
    r = got[5]
    assert (r["feature_code"], r["population"], r["latitude"], r["longitude"], str(r["modification_date"])) == (None, 0, 1.5, None, "2020-02-03")
    names = spark.createDataFrame([("\t".join(c),) for c in (["1", "5", "ru", "Н", "1", "", "", "", "", ""], ["2", "x", "ru", "Н", "", "", "", "", "", ""], ["3", "5", "de", "N", "", "", "", "", "", ""], ["4", "9", "ru", "N", "", "", "", "", "", ""], ["5", "5"])], "line string")
    assert [(r["alternate_name_id"], r["is_preferred_name"], r["is_historic"]) for r in D.names_of_lines(names, D.places_of_lines(lines), ["ru"]).collect()] == [(1, True, False)]
    broken = spark.createDataFrame([("\t".join([*LINE[:14], "12x", *LINE[15:]]),)], "line string")
    with pytest.raises(Exception):
        D.places_of_lines(broken).collect()


def test_delta_files_and_admin1(spark, tmp_path):
    (tmp_path / "deletes-2026-01-01.txt").write_text("5\tx\nabc\ty\n 7\n")
    (tmp_path / "modifications-2026-01-01.txt").write_text("\t".join(LINE) + "\n")
    got = D.read_delta(spark, str(tmp_path), "2026-01-01")
    assert rows(got["deletes"]) == [(5,)] and got["changes"].count() == 1 and got["name_deletes"] is None and got["name_changes"] is None
    (tmp_path / "admin1.txt").write_text("RU.01\tMoscow\tx\nRU\tno\nUS.A.B\tAB\nDE.1\tout\n")
    assert rows(D.read_admin1(spark, str(tmp_path / "admin1.txt"))) == [("RU", "01", "Moscow"), ("US", "A.B", "AB")]
    assert D.read_admin1(spark, str(tmp_path / "absent.txt")).count() == 0


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(D.NotBuiltError):
        D.read_table(spark, path, S.ADMIN1)
    df = spark.createDataFrame([("RU", "01", "x")], S.ADMIN1)
    D.write_table(df, path, "build-1")
    back = D.read_table(spark, path, S.ADMIN1)
    assert rows(back) == rows(df) and D.build_id(D.read_table(spark, path)) == "build-1"
    D.write_table(back.union(back), path)  # over its own input
    assert D.read_table(spark, path).count() == 2 and back.count() == 1  # a reader of the version before goes on
    with pytest.raises(Exception):
        D.write_table(df.select(F.raise_error(F.lit("lost")).alias("x")), path)
    assert D.read_table(spark, path).count() == 2  # a write that fails leaves the table
    D.write_table(df, path)
    assert len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("v-")]) == 2
    plain = str(tmp_path / "plain")
    df.write.parquet(plain)
    assert rows(D.read_table(spark, plain, S.ADMIN1)) == rows(df)


def test_json_arrays_and_checkpoints(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 3 else f"Москва \"{i}\"", [1, None]) for i in range(7)], "id int, t string, x array<int>")
    for n in (1, 3):
        D.write_json_array(df.repartition(n), str(tmp_path / f"a{n}"))
        files = [json.loads(f.read_text()) for f in (tmp_path / f"a{n}").glob("part-*")]
        assert len(files) == n and sorted((r["id"], r["t"], tuple(r["x"])) for f in files for r in f) == sorted((r["id"], r["t"], tuple(r["x"])) for r in df.collect())
    assert "Москва" in next((tmp_path / "a1").glob("part-*")).read_text()
    assert rows(D.read_json_array(spark, str(tmp_path / "a3"), "id int, t string").select("id")) == [(i,) for i in range(7)]
    D.write_json_array(df.limit(0).coalesce(1), str(tmp_path / "none"))
    assert D.read_json_array(spark, str(tmp_path / "none"), "id int").count() == 0
    for i in range(2):
        D.append_checkpoint(spark.createDataFrame([(i, "q")], "request_id bigint, query string"), str(tmp_path / "ck"))
    assert rows(D.read_checkpoint(spark, str(tmp_path / "ck")).select("request_id")) == [(0,), (1,)]


def test_load_all_keeps_the_last(spark, tmp_path):
    line = lambda i, name, at: "\t".join([str(i), name, name, *LINE[3:14], str(at), *LINE[15:]])
    for f, members in {"a": ["RU.txt", "US.txt"], "b": ["TR.txt"]}.items():
        with zipfile.ZipFile(tmp_path / f"{f}.zip", "w") as z:
            for m in members:
                z.writestr(m, "\n".join(line(i, f"{f}{m}", k) for k, i in enumerate([1, 2, 1] if m == "RU.txt" else [1] if m == "US.txt" else [2, 3])))
    names = [["9", "1", "ru", "old", "", "", "", "", "", ""], ["9", "1", "ru", "new", "", "", "", "", "", ""], ["8", "77", "ru", "lost", "", "", "", "", "", ""]]
    (tmp_path / "names").mkdir()
    with zipfile.ZipFile(tmp_path / "names" / "n.zip", "w") as z:
        z.writestr("alternateNames.txt", "\n".join("\t".join(c) for c in names))
    out = str(tmp_path / "staged")
    for _ in range(2):  # the second load merges into the first
        D.stage_all(spark, f"{tmp_path}/*.zip", f"{tmp_path}/names/*.zip", out)
        assert rows(D.read_table(spark, f"{out}/geonames").select("geonameid", "name", "population")) == [(1, "aUS.txt", 0), (2, "bTR.txt", 0), (3, "bTR.txt", 1)]
        assert rows(D.read_table(spark, f"{out}/alternate_names").select("alternate_name_id", "alternate_name")) == [(9, "new")]


def test_checkpoint_shapes(spark, tmp_path):
    old = '{"request_id": 1, "query": "q"}\n' * 150
    (tmp_path / "c.jsonl").write_text(old + '{"request_id": 2, "query": "z", "prompt_version": "3", "valid": true, "entities": [{"text": "a", "label": "CITY", "start": 0, "end": 1}]}\n{"request_id": 3, "que')
    got = D.read_checkpoint(spark, str(tmp_path / "c.jsonl"))
    assert got.count() == 151 and got.filter("prompt_version = '3'").first()["entities"][0]["label"] == "CITY"


def test_stream_upsert(spark, tmp_path):
    from placeloom.streaming.delta import place_stream, upsert_stream

    base = spark.createDataFrame([(1, "a", "a", "P", None, "RU", None, None, 5, None, None, None, None)], S.GEONAMES)
    path, inbox = str(tmp_path / "places"), str(tmp_path / "in")
    D.write_table(base, path)
    base.selectExpr("* except (population, name)", "9 as population", "'b' as name", "timestamp_ntz'2026-01-01 00:00:00' as loaded_at").select(*[f.name for f in S.GEONAMES.fields], "loaded_at").withColumn("population", F.lit(9).cast("bigint")).write.parquet(inbox)
    for _ in range(2):  # the second run finds nothing new
        upsert_stream(place_stream(spark, inbox), path, "geonameid", S.GEONAMES, ["loaded_at"], str(tmp_path / "ck")).awaitTermination()
        assert [(r["geonameid"], r["name"], r["population"]) for r in D.read_table(spark, path, S.GEONAMES).collect()] == [(1, "b", 9)]


def test_checkpoint_stream(spark, tmp_path):
    from placeloom.streaming.delta import checkpoint_stream

    inbox, path = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(2):
        spark.createDataFrame([(i, "q")], "request_id bigint, query string").write.mode("append").parquet(inbox)
        checkpoint_stream(spark.readStream.schema("request_id bigint, query string").parquet(inbox), path, str(tmp_path / "ck")).awaitTermination()
    assert rows(D.read_checkpoint(spark, path).select("request_id", "query")) == [(0, "q"), (1, "q")]
