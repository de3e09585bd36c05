"""Rows that fail to parse: tab-separated dump lines become typed rows or rejects with a reason.

Cells are exploded to (line, column, value), joined to a table of rules, evaluated, and the first failing rule of each
line is its reason; the lines without a failure are the clean rows.

Defined cases: a null or empty line has one (empty) column, so it fails with ``columns``; a null file name counts as a
place file; repeated lines under other ids are judged on their own; further columns of the input are kept aside.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a place line and of an alternate-name line, in file order (fixed values of the dump format).
PLACE_COLUMNS = [
    "geonameid", "name", "asciiname", "alternatenames", "latitude", "longitude", "feature_class", "feature_code", "country_code", "cc2",
    "admin1_code", "admin2_code", "admin3_code", "admin4_code", "population", "elevation", "dem", "timezone", "modification_date",
]
NAME_COLUMNS = ["alternate_name_id", "geonameid", "isolanguage", "alternate_name", "is_preferred_name", "is_short_name", "is_colloquial", "is_historic", "from_period", "to_period"]


@dataclass(frozen=True)
class Rule:
    """Cells of ``column`` in files of ``kind`` must match ``pattern``; a lower ``rank`` is reported first."""

    kind: str
    column: int
    rank: int
    reason: str
    pattern: str


RULES = [
    Rule("place", PLACE_COLUMNS.index("population"), 3, "population", r"\A[0-9]*\z"),
    Rule("place", PLACE_COLUMNS.index("latitude"), 4, "latitude", r"\A(-?0*([0-8]?[0-9](\.[0-9]+)?|90(\.0+)?))?\z"),
    Rule("name", NAME_COLUMNS.index("isolanguage"), 5, "isolanguage", r"\A([a-z]{2,3}(-[A-Za-z]{2,4})?)?\z"),
]


def split_quoted(line: str) -> list[str] | None:
    """Cells of one line, or None if a column's quoting is broken. One pass, so a line may be of any length."""
    cells, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            parts, start = [], at + 1
            while True:
                close = line.find('"', start)
                if close < 0:
                    return None
                parts.append(line[start:close])
                if close + 1 < n and line[close + 1] == '"':
                    parts.append('"')
                    start = close + 2
                    continue
                break
            cells.append("".join(parts))
            at = close + 1
            if at == n:
                return cells
            if line[at] != "\t":
                return None
            at += 1
        else:
            tab = line.find("\t", at)
            if tab < 0:
                cells.append(line[at:])
                return cells
            cells.append(line[at:tab])
            at = tab + 1


@F.pandas_udf(T.ArrayType(T.StringType()))
def _quoted_cells(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else split_quoted(x))


def parse_cells(lines: DataFrame, line: str = "line", file_name: str = "file_name") -> DataFrame:
    """Adds ``kind`` (place, name) and ``cells`` (null where quoting is broken).

    Lines in which no column begins with a quote are split in the JVM; only the others go through Python.
    """
    text = F.coalesce(F.col(line), F.lit(""))
    has_quote = text.startswith('"') | text.contains('\t"')
    return lines.withColumn("kind", F.when(F.coalesce(F.col(file_name), F.lit("")).startswith("alternateNames"), "name").otherwise("place")).withColumn(
        "cells", F.when(~has_quote, F.split(text, "\t", -1)).otherwise(_quoted_cells(F.when(has_quote, text)))
    )


#: Pseudo columns of the cell table that stand for a whole line: its quoting is broken, or its number of columns is wrong.
BROKEN_QUOTES, WRONG_WIDTH = -2, -1
#: Rules that a call may bring; the rule table is broadcast.
MAX_RULES = 1000


def rule_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    """Rules of cells, and those of whole lines with a null pattern, which no value meets."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rows = [(k, c, rank, reason, None) for k in ("place", "name") for c, rank, reason in ((BROKEN_QUOTES, 1, "quoting"), (WRONG_WIDTH, 2, "columns"))]
    return spark.createDataFrame(rows + [(r.kind, r.column, r.rank, r.reason, r.pattern) for r in rules], "kind string, column int, rank int, reason string, pattern string")


def _cell_table(parsed: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, kind, column, value): the cells that a rule is about, or one pseudo cell for a line that fails as a whole."""

    def of_line(column: int) -> Column:
        return F.array(F.struct(F.lit(column).alias("column"), F.lit(None).cast("string").alias("value")))

    def ruled(kind: str, width: int) -> Column:
        at = sorted({r.column for r in rules if r.kind == kind})
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.get("cells", F.lit(c)).alias("value")) for c in at]) if at else F.array().cast("array<struct<column:int,value:string>>")
        return F.when(F.size("cells") != width, of_line(WRONG_WIDTH)).otherwise(cells)

    cells = F.when(F.col("cells").isNull(), of_line(BROKEN_QUOTES)).when(F.col("kind") == "name", ruled("name", len(NAME_COLUMNS))).otherwise(ruled("place", len(PLACE_COLUMNS)))
    return parsed.select(key, "kind", F.inline(cells))


def violations(parsed: DataFrame, key: str = "line_id", rules: list[Rule] = RULES) -> DataFrame:
    """One row per failing line: key and its first reason. One pass over the lines; only failing cells are shuffled."""
    rules_of = rule_table(parsed.sparkSession, rules)
    wrong = _cell_table(parsed, key, rules).join(F.broadcast(rules_of), ["kind", "column"]).filter("pattern is null or not regexp_like(value, pattern)")
    first = wrong.groupBy(key).agg(F.min("rank").alias("rank"))
    return first.join(F.broadcast(rules_of.select("rank", "reason").distinct()), "rank").select(key, "reason")


# Types of the columns that aren't text, and the forms that a value of each type has.
TYPES = {
    "geonameid": "bigint", "alternate_name_id": "bigint", "population": "decimal(38,0)", "latitude": "double", "longitude": "double", "elevation": "bigint", "dem": "bigint", "modification_date": "date",
}
FORMS = {"bigint": r"\A-?[0-9]+\z", "decimal(38,0)": r"\A-?[0-9]+\z", "double": r"\A-?[0-9]+(\.[0-9]+)?\z", "date": r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"}
FLAGS = ("is_preferred_name", "is_short_name", "is_colloquial", "is_historic")
_KEPT_EMPTY = ("name", "asciiname", "alternatenames", "alternate_name")


def clean_rows(parsed: DataFrame, rejected: DataFrame, kind: str, key: str = "line_id") -> DataFrame:
    """Typed rows of one kind, without the rejected lines.

    Unchecked cells that don't fit their type are null, and their text stands in ``unparsed``, a map by column, so no
    value is lost or changed. Populations have up to 38 digits; an empty one is 0.
    """
    names = PLACE_COLUMNS if kind == "place" else NAME_COLUMNS
    good = parsed.filter(F.col("kind") == kind).join(rejected.select(key), key, "left_anti")
    cols, lost = [], []
    for i, n in enumerate(names):
        c = F.get(F.col("cells"), F.lit(i))
        if n in TYPES:
            v = F.when(c.rlike(FORMS[TYPES[n]]), c).try_cast(TYPES[n])
            lost.append(F.when((c != "") & v.isNull(), F.struct(F.lit(n).alias("key"), c.alias("value"))))
            c = F.when(c == "", F.lit(0).cast(TYPES[n])).otherwise(v) if n == "population" else v
        elif n in FLAGS:
            c = F.coalesce(c == "1", F.lit(False))
        elif n not in _KEPT_EMPTY:
            c = F.when(c != "", c)
        cols.append(c.alias(n))
    return good.select(F.col(key), *cols, F.map_from_entries(F.array_compact(F.array(*lost))).alias("unparsed"))
