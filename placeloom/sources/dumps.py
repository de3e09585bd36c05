"""Readers of dumps: zipped and plain tab-separated files, the region file, deltas, checkpoints, JSON arrays.

Lines end at line feeds only, and cells are split at tabs without quoting, as the dumps are written. Defined cases: a
missing optional file is an empty table with its schema; short lines, lines of another class or language and lines
without an integer id are skipped; empty cells are null, an empty population is 0; a value that can't be cast raises.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom import schemas as S
from placeloom.operators.badrows import NAME_COLUMNS, PLACE_COLUMNS


class NotBuiltError(RuntimeError):
    """A table that a step needs was not written yet."""


#: Lines handed on at once from a zip member, which is read as a stream.
LINES_AT_ONCE = 50_000


def zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, line_no, line) of the text members of zip files. A zip can't be split, so each file is one task; its members are streamed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if not member.endswith(".txt") or "readme" in member.lower():
                            continue
                        lines, done = [], 0
                        with z.open(member) as f:
                            for raw in f:
                                lines.append(raw.decode("utf-8").removesuffix("\n"))
                                if len(lines) == LINES_AT_ONCE:
                                    yield pd.DataFrame({"path": source, "file_name": member, "line_no": range(done, done + len(lines)), "line": lines})
                                    lines, done = [], done + len(lines)
                        if lines:
                            yield pd.DataFrame({"path": source, "file_name": member, "line_no": range(done, done + len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, file_name string, line_no bigint, line string")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"))


def _optional(read, empty, spark: SparkSession) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], empty)
        raise


def _cell(cells: Column, i: int) -> Column:
    c = F.get(cells, F.lit(i))
    return F.when(c != "", c)


def places_of_lines(lines: DataFrame, countries: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Populated places of place lines, with the columns ``keep`` of the lines; values are cast strictly, so a broken one raises under ANSI mode."""
    cells = F.split("line", "\t", -1)
    at = {n: i for i, n in enumerate(PLACE_COLUMNS)}
    rows = lines.withColumn("c", cells).filter((F.size("c") >= len(PLACE_COLUMNS)) & (F.get("c", F.lit(at["feature_class"])) == "P"))
    if countries:
        rows = rows.filter(F.get("c", F.lit(at["country_code"])).isin(countries))
    c = F.col("c")
    out = []
    for f in S.GEONAMES.fields:
        raw = F.get(c, F.lit(at[f.name])) if f.name in ("name", "asciiname", "feature_class", "country_code") else _cell(c, at[f.name])
        v = raw if f.dataType.simpleString() == "string" else raw.cast(f.dataType)
        out.append((F.coalesce(v, F.lit(0).cast("bigint")) if f.name == "population" else v).alias(f.name))
    return rows.select(*out, *keep)


def names_of_lines(lines: DataFrame, ids: DataFrame | None = None, languages: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Alternate names of name lines, of the wanted places and languages, with the columns ``keep`` of the lines."""
    at = {n: i for i, n in enumerate(NAME_COLUMNS)}
    rows = lines.withColumn("c", F.split("line", "\t", -1)).filter(F.size("c") >= len(NAME_COLUMNS))
    c = F.col("c")
    if languages:
        rows = rows.filter(F.get(c, F.lit(at["isolanguage"])).isin(languages))
    rows = rows.withColumn("geonameid", F.get(c, F.lit(at["geonameid"])).try_cast("bigint")).filter("geonameid is not null")
    flags = [(F.get(c, F.lit(at[f])) == "1").alias(f) for f in ("is_preferred_name", "is_short_name", "is_colloquial", "is_historic")]
    out = rows.select(F.get(c, F.lit(0)).cast("bigint").alias("alternate_name_id"), "geonameid", _cell(c, at["isolanguage"]).alias("isolanguage"), F.get(c, F.lit(at["alternate_name"])).alias("alternate_name"), *flags, *keep)
    return out if ids is None else out.join(ids.select("geonameid").distinct(), "geonameid", "left_semi").select(out.columns)


def admin1_of_lines(lines: DataFrame, countries: list[str] = S.COUNTRIES) -> DataFrame:
    cells = F.split("line", "\t", -1)
    key = F.split(F.get(cells, F.lit(0)), r"\.", 2)
    rows = lines.filter((F.size(cells) >= 2) & (F.size(key) == 2))
    return rows.select(F.get(key, F.lit(0)).alias("country_code"), F.get(key, F.lit(1)).alias("admin1_code"), F.get(cells, F.lit(1)).alias("admin1_name")).filter(F.col("country_code").isin(countries))


def read_admin1(spark: SparkSession, path: str, countries: list[str] = S.COUNTRIES) -> DataFrame:
    return _optional(lambda: admin1_of_lines(text_lines(spark, path), countries), S.ADMIN1, spark)


def ids_of_lines(lines: DataFrame, key: str) -> DataFrame:
    """Ids of a delete file: first cells of digits only."""
    first = F.get(F.split("line", "\t", -1), F.lit(0))
    return lines.filter(first.rlike(r"\A[0-9]+\z")).select(first.cast("bigint").alias(key))


def read_delta(spark: SparkSession, folder: str, day: str, countries: list[str] = S.COUNTRIES, languages: list[str] = S.LANGUAGES) -> dict[str, DataFrame | None]:
    """The four files of a day, by the argument names of ``corpus.apply_delta``; a missing file is None and changes nothing."""

    def have(name: str) -> DataFrame | None:
        try:
            return text_lines(spark, f"{folder}/{name}-{day}.txt")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    made = {
        "deletes": ("deletes", lambda x: ids_of_lines(x, "geonameid")), "name_deletes": ("alternateNamesDeletes", lambda x: ids_of_lines(x, "alternate_name_id")),
        "changes": ("modifications", lambda x: places_of_lines(x, countries)), "name_changes": ("alternateNamesModifications", lambda x: names_of_lines(x, None, languages)),
    }
    return {arg: None if (lines := have(name)) is None else make(lines) for arg, (name, make) in made.items()}


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one step: written aside and renamed over what is there, so a reader sees the old or the new text."""
    fs, aside = hadoop(spark, f"{path}.__new")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    target = fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path))
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), target, over)


def get_text(spark: SparkSession, path: str) -> str | None:
    fs, p = hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


#: Holds the name of a table's current version.
POINTER = "_current"


def table_path(spark: SparkSession, path: str) -> str:
    """The folder of a table's current version; a table that another writer made has no versions and is the folder itself."""
    version = get_text(spark, f"{path}/{POINTER}")
    return f"{path}/{version.strip()}" if version else path


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A table's current version, cast to its declared schema if one is given; NotBuiltError names what to run if it isn't there."""
    try:
        df = spark.read.parquet(table_path(spark, path))
    except AnalysisException as e:
        raise NotBuiltError(f"{path} does not exist: build the staging tables first") from e
    return df if schema is None else df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_table(df: DataFrame, path: str, build_id: str | None = None) -> None:
    """Parquet with zstd; the build id goes into the metadata of the first column.

    Each write is a new version beside the others; a pointer is switched when it is whole, so a failure at any time leaves
    the table as it was, and a table may replace its own input. The version before stays for its readers, older ones go.
    """
    spark = df.sparkSession
    if build_id:
        df = df.withMetadata(df.columns[0], {"build_id": build_id})
    before = (get_text(spark, f"{path}/{POINTER}") or "").strip()
    version = f"v-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{path}/{version}")
    put_text(spark, f"{path}/{POINTER}", version)
    fs, folder = hadoop(spark, path)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(status.getPath(), True)


def build_id(df: DataFrame) -> str | None:
    return df.schema.fields[0].metadata.get("build_id")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines under the declared schema, so early rows of an older shape narrow nothing; broken lines become null rows and go."""
    return spark.read.schema(S.CHECKPOINT).option("mode", "PERMISSIVE").json(path).filter("request_id is not null")


def read_json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Finished requests as further JSON lines; earlier files are never touched, so what was written stays."""
    df.write.mode("append").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """JSON arrays of the rows, unescaped UTF-8: each file is one array, and a frame of one partition gives one file. Null fields are kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead = "["
        for pdf in batches:
            rows = pdf["value"].tolist()
            if rows:
                yield pd.DataFrame({"value": [(lead if i == 0 else ",") + row for i, row in enumerate(rows)]})
                lead = ","
        yield pd.DataFrame({"value": ["[]" if lead == "[" else "]"]})

    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInPandas(run, "value string").write.mode("overwrite").text(path)


#: The later file, then the later line in it, is the last.
_LAST = ("path", "file_name", "line_no")


def load_all(spark: SparkSession, place_zips: str, name_zips: str, existing: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Places and names of zipped dumps, the last of repeated ids, names only of those places; put over what exists."""
    from placeloom.operators.corpus import keep_one, upsert

    last = [F.desc(c) for c in _LAST]
    places = keep_one(places_of_lines(zip_lines(spark, place_zips), keep=_LAST), ["geonameid"], last).drop(*_LAST)
    names = keep_one(names_of_lines(zip_lines(spark, name_zips), places, S.LANGUAGES, keep=_LAST), ["alternate_name_id"], last).drop(*_LAST)
    if existing is None:
        return places, names
    return upsert(existing[0], places, "geonameid"), upsert(existing[1], names, "alternate_name_id")


def stage_all(spark: SparkSession, place_zips: str, name_zips: str, folder: str) -> None:
    """Loads the dumps over the staging tables of a folder, or makes these."""
    paths = f"{folder}/geonames", f"{folder}/alternate_names"
    try:
        existing = read_table(spark, paths[0], S.GEONAMES), read_table(spark, paths[1], S.ALTERNATE_NAMES)
    except NotBuiltError:
        existing = None
    for df, path in zip(load_all(spark, place_zips, name_zips, existing), paths):
        write_table(df, path)
