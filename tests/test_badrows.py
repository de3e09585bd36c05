import random

import pytest

from placeloom.operators import badrows as B

LINES = "line_id bigint, file_name string, line string, cells string, reason string"


def place(**over):
    cells = ["1", "Name", "Name", "", "50.1", "60.2", "P", "PPL", "RU", "", "01", "", "", "", "12", "", "3", "Etc/GMT", "2020-01-01"]
    for k, v in over.items():
        cells[B.PLACE_COLUMNS.index(k)] = v
    return "\t".join(cells)


def name(**over):
    cells = ["7", "1", "ru", "Имя", "1", "", "", "", "", ""]
    for k, v in over.items():
        cells[B.NAME_COLUMNS.index(k)] = v
    return "\t".join(cells)


def judge(spark, lines, file_name="RU.txt"):
    df = spark.createDataFrame([(i, file_name, x, "c", "r") for i, x in enumerate(lines)], LINES)
    got = {r["line_id"]: r["reason"] for r in B.violations(B.parse_cells(df)).collect()}
    return [got.get(i) for i in range(len(lines))]


def test_reasons_of_places(spark):
    lines = [
        place(), place(population=""), place(population="12x"), place(population="１"), place(latitude="90.0"), place(latitude="-90.0001"), place(latitude="52.18.7"), place(latitude=""), place(latitude="+5"), place(latitude="089.5"),
        place() + "\tx", "a\tb", "", None, place(alternatenames='"a\tb ""c"" d"'), place(alternatenames='"a\tb'), place(alternatenames='"a" b'), place(name='Dani "x" y'), place(population="-1", latitude="x"), place(population='"5"'),
        place(timezone='"'), place(alternatenames='"open') + "\tx",
    ]
    assert judge(spark, lines) == [None, None, "population", "population", None, "latitude", "latitude", None, "latitude", None, "columns", "columns", "columns", "columns", None, "quoting", "quoting", None, "population", None, "quoting", "quoting"]


def test_reasons_of_names(spark):
    lines = [name(), name(isolanguage=""), name(isolanguage="zh-Hant"), name(isolanguage="RU"), name(isolanguage="abcd"), name(isolanguage="zh-H"), name(alternate_name='"x"" y"'), "1\t2"]
    assert judge(spark, lines, "alternateNamesV2.txt") == [None, None, None, "isolanguage", "isolanguage", "isolanguage", None, "columns"]
    assert judge(spark, [name()], None) == ["columns"]


def test_split_round_trip():
    rng = random.Random(1)
    for _ in range(2000):
        cells = ["".join(rng.choices('ab"\t', k=rng.randint(0, 5))) for _ in range(rng.randint(1, 5))]
        cells[0] = cells[0] or "x"
        line = "\t".join('"' + c.replace('"', '""') + '"' if "\t" in c or c.startswith('"') else c for c in cells)
        assert B.split_quoted(line) == cells


def test_long_line(spark):
    line = place(alternatenames='"' + '""' * 50_000 + "x" * 200_000 + '"')
    assert judge(spark, [line]) == [None]


@pytest.mark.parametrize("kind", ["place", "name"])
def test_clean_rows(spark, kind):
    df = spark.createDataFrame([(1, "RU.txt", place(population="", modification_date="bad"), "", ""), (2, "RU.txt", place(population="x"), "", ""), (3, "alternateNames.txt", name(), "", "")], LINES)
    parsed = B.parse_cells(df)
    rows = B.clean_rows(parsed, B.violations(parsed), kind).collect()
    assert len(rows) == 1
    if kind == "place":
        assert (rows[0]["population"], rows[0]["latitude"], rows[0]["modification_date"]) == (0, 50.1, None)
    else:
        assert (rows[0]["alternate_name_id"], rows[0]["is_preferred_name"], rows[0]["is_historic"]) == (7, True, False)
    odd = [place(population="1" * 25, geonameid="x7", longitude="east"), place(population="9" * 40), place(elevation="1.5")] if kind == "place" else [name(geonameid="x"), name(alternate_name_id="9" * 20)]
    parsed = B.parse_cells(spark.createDataFrame([(i, "RU.txt" if kind == "place" else "alternateNames.txt", x, "", "") for i, x in enumerate(odd)], LINES))
    got = {r["line_id"]: r for r in B.clean_rows(parsed, B.violations(parsed), kind).collect()}
    if kind == "place":
        assert got[0]["population"] == int("1" * 25) and got[0]["unparsed"] == {"geonameid": "x7", "longitude": "east"}
        assert got[1]["population"] is None and got[1]["unparsed"] == {"population": "9" * 40} and got[2]["unparsed"] == {"elevation": "1.5"}
    else:
        assert got[0]["unparsed"] == {"geonameid": "x"} and got[1]["unparsed"] == {"alternate_name_id": "9" * 20}
    empty = B.parse_cells(df.limit(0))
    assert B.violations(empty).count() == 0 and B.clean_rows(empty, B.violations(empty), kind).count() == 0


def test_own_rules(spark):
    df = B.parse_cells(spark.createDataFrame([(1, "RU.txt", place(timezone="x"), "", ""), (2, "alternateNames.txt", name(isolanguage="??"), "", "")], LINES))
    assert [tuple(r) for r in B.violations(df, rules=[B.Rule("place", B.PLACE_COLUMNS.index("timezone"), 9, "zone", r"\A.*/.*\z")]).collect()] == [(1, "zone")]
    assert B.violations(df, rules=[]).count() == 0
    with pytest.raises(ValueError):
        B.violations(df, rules=B.RULES * B.MAX_RULES)
