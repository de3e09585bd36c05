"""Retrieval metrics of a run against judgements, the oracle run, and the gate between two runs.

qrels: query, id (relevant ones). run: query, id, rank from 1. Defined cases: a judged query that the run lacks counts 0;
queries without relevant ids count in no mean; repeated pairs count once, at the better rank.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.runtime import sorted_rank
from placeloom.sources.dumps import put_text

CUTS = (5, 10, 25, 50)
#: Equal ranges that a group's values are counted in.
RANGES = 4096


def per_query(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """RR, P@1 and R@k of each judged query: judgements meet the run on (query, id), then one aggregate per query."""
    rel = qrels.select("query", "id").distinct()
    got = run.groupBy("query", "id").agg(F.min("rank").alias("rank"))
    hit = rel.join(got, ["query", "id"], "left")
    best = F.min("rank")
    return hit.groupBy("query").agg(
        F.coalesce(1.0 / best, F.lit(0.0)).alias("rr"), F.coalesce((best == 1).cast("double"), F.lit(0.0)).alias("p1"),
        *[(F.sum(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))) / F.count(F.lit(1))).alias(f"r{k}") for k in CUTS],
    )


def metrics(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """One row of means, to four decimals."""
    q = per_query(qrels, run)
    return q.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in q.columns if c != "query"])


def oracle_run(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """The run with relevant ids first, each part in its order: the ceiling of re-ranking."""
    rel = qrels.select("query", "id", F.lit(1).alias("gold")).distinct()
    marked = run.join(rel, ["query", "id"], "left")
    by = marked.select("*", F.coalesce("gold", F.lit(0)).alias("__gold"), F.col("rank").alias("__rank")).drop("gold")
    return sorted_rank(by, ["query"], [F.desc("__gold"), F.asc("__rank"), F.asc("id")]).drop("__gold", "__rank")


def gate(before: DataFrame, after: DataFrame) -> bool:
    """Whether the second metrics row is no worse in P@1 and RR. Two rows on the driver."""
    a, b = before.first(), after.first()
    return b["p1"] >= a["p1"] and b["rr"] >= a["rr"]


def empty_accuracy(queries: DataFrame, run: DataFrame) -> DataFrame:
    """Part of the queries without an answer (column gold_size = 0) for which the run has nothing."""
    none = queries.filter("gold_size = 0").select("query").distinct()
    got = none.join(run.select("query").distinct().withColumn("has", F.lit(1)), "query", "left")
    return got.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.round(F.avg(F.col("has").isNull().cast("double")), 4), F.lit(0.0)).alias("accuracy"))


def latency_percentiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exclusive percentiles, as a sample of n values cut into hundredths at (n + 1) * p.

    Values are counted per distinct value, these by equal ranges between a group's least and most; ranks are summed over
    ranges first and then inside a range, so a group's values need not fit one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ends = counts.groupBy(*by).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.sum("c").alias("n"))
    ends = ends.select(*[F.col(c).alias(f"__{c}") for c in by], "least", "most", "n")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    part = F.when(F.col("most") > F.col("least"), F.floor((F.col("v") - F.col("least")) / (F.col("most") - F.col("least")) * RANGES)).otherwise(F.lit(0))
    placed = counts.join(ends, same).withColumn("r", part)
    ranges = placed.groupBy(*by, "r").agg(F.sum("c").alias("s"))
    before = ranges.select(*[F.col(c).alias(f"_b{c}") for c in by], F.col("r").alias("_r"), (F.sum("s").over(W.partitionBy(*by).orderBy("r")) - F.col("s")).alias("before"))
    on = F.col("r") == F.col("_r")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_b{c}"))
    line = placed.withColumn("inside", F.sum("c").over(W.partitionBy(*by, "r").orderBy("v"))).join(before, on).withColumn("upto", F.col("before") + F.col("inside"))
    out = []
    for p in (50, 90, 95, 99):
        at = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), (F.col("n") + 1) * p / 100.0))
        lo = F.floor(at)
        below = F.min(F.when(F.col("upto") >= lo, F.col("v")))
        above = F.min(F.when(F.col("upto") >= F.least(lo + 1, F.col("n")), F.col("v")))
        out.append(F.round(below + (above - below) * F.max(at - lo), 6).alias(f"p{p}"))
    return line.groupBy(*by).agg(F.max("n").alias("n"), *out, F.min("v").alias("least"), F.max("v").alias("most"))


def score_table(runs: dict[str, DataFrame]) -> str:
    """A Markdown table with a line for each named metrics row. One row of each run comes to the driver."""
    names = ["rr", "p1", *[f"r{k}" for k in CUTS]]
    lines = ["| run | " + " | ".join(names) + " |", "|---" * (len(names) + 1) + "|"]
    for title, df in runs.items():
        row = df.first()
        lines.append(f"| {title} | " + " | ".join(f"{row[n] or 0:.4f}" for n in names) + " |")
    return "\n".join(lines)


def evaluation(qrels: DataFrame, runs: dict[str, DataFrame], ideal_of: str | None = None) -> DataFrame:
    """A row of means for each named run, and for the ideal order of one of them: all runs meet the judgements in one join.

    Every system is judged on the same queries, those with relevant ids.
    """
    named = dict(runs)
    if ideal_of is not None:
        named["ideal"] = oracle_run(qrels, runs[ideal_of])
    tagged = [df.select(F.lit(name).alias("system"), "query", "id", "rank") for name, df in named.items()]
    run = reduce(DataFrame.unionByName, tagged)
    both = qrels.select("query", "id").distinct().withColumn("system", F.explode(F.array(*[F.lit(n) for n in named])))
    key = F.struct("system", "query").alias("query")
    q = per_query(both.select(key, "id"), run.select(key, "id", "rank"))
    return q.groupBy(F.col("query.system").alias("system")).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in q.columns if c != "query"])


def write_metrics(df: DataFrame, path: str, key: str = "system", **about: object) -> dict:
    """A metrics table (a row for each ``key``, so a handful) as one JSON file with what is known about the run; returns what was written."""
    names = [c for c in df.columns if c != key]
    payload = {"evaluated_at": datetime.now(UTC).isoformat(timespec="seconds"), **about, "columns": names, "rows": {r[key]: [r[n] for n in names] for r in df.orderBy(key).collect()}}
    put_text(df.sparkSession, path, json.dumps(payload, ensure_ascii=False, indent=1))
    return payload
