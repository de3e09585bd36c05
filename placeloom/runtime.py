"""Session set-up, lineage cuts and exact ranks without a single-task window."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def local_session(app: str = "placeloom", cores: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PLACELOOM_DRIVER_MEMORY", "6g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir. Only a session whose tasks run on this machine gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="placeloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, with no lineage behind it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def collation_free_blank(c: Column | str) -> Column:
    """Trimmed, with every run of Unicode blanks (no-break ones too) as one space."""
    # the properties by name: the same characters as in Unicode mode, which takes twice the time
    return F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[\s\x{85}\p{Z}\x{FEFF}]+", " "))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns that later filters and expressions use several times: a generator keeps the optimiser from copying them into each use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def exact_rank(df: DataFrame, group: list[str], order: list[str], out: str = "rank", buckets: int = 1024) -> DataFrame:
    """1-based rank of each row in its group by a uniform hash of ``order``, ties broken by ``order`` itself.

    A plain window would sort a whole group in one task. Here a group is spread over ``buckets`` hash ranges; only the
    counts per (group, range) are summed up, and rows are ranked inside their range. ``order`` must identify a row in
    its group, so that the rank is the same on every run.
    """
    bits = max(1, (buckets - 1).bit_length())
    keyed = df.withColumn("__hash", F.xxhash64(*order)).withColumn("__bucket", F.shiftrightunsigned(F.col("__hash"), 64 - bits).cast("int"))
    keys = [*group, "__bucket"]
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], (F.sum("__n").over(W.partitionBy(*group).orderBy("__bucket")) - F.col("__n")).alias("__before"))
    ranked = keyed.withColumn("__inside", F.row_number().over(W.partitionBy(*keys).orderBy("__hash", *order)))
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return ranked.join(before, on, "left").select(*df.columns, (F.col("__before") + F.col("__inside")).alias(out))


def sorted_rank(df: DataFrame, group: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """1-based rank of each row in its group by ``order``, which must identify a row in its group; replaces a column ``out``.

    Rows are sorted by ranges over all groups, so a group of any size, with any ties in the first columns, spreads over
    tasks. The sorted rows are cut, then counted per (group, task), and a row's place in its task is added to the counts
    of the tasks before.
    """
    keep = [c for c in df.columns if c != out]
    at = cut(df.orderBy(*[F.asc(c) for c in group], *order).select(*keep, F.monotonically_increasing_id().alias("__at")))
    # the id has the task above its lower 33 bits
    placed = at.withColumn("__task", F.shiftright("__at", 33))
    keys = [*group, "__task"]
    counts = placed.groupBy(*keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "__first", (F.sum("__n").over(W.partitionBy(*group).orderBy("__task")) - F.col("__n")).alias("__before"))
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(before, on).select(*keep, (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias(out))
