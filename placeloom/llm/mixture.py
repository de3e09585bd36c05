"""A mixture of sources with target shares of its tokens.

The mixture holds as many tokens as the corpus. A source of weight w needs w * total tokens, that is r = w * total / own
uses of each of its records; r is cut at the source's ``max_repeats``. Every record is used floor(r) times, and once more
for a sample of inclusion probability r - floor(r), drawn by the cube method: the vector of probabilities moves along
directions in the null space of the constraints (tokens and records of the sample) until each is 0 or 1. The flight runs
in parallel on hash buckets of a source and leaves two open records in each; these few are gathered and flown again, level
by level, until only two of a source remain (the landing), which are settled by chance in their probabilities. What the
landing misses is about the size of the last open records, so the ``FIRST`` largest of every source fly first, from the largest on, each along the direction in which its own
probability moves one way and that of all smaller records the other way, so that the tokens stay balanced. Size decides
nothing but the order of flight.

Defined cases: sources without a target, and null sources, count in the total and not in the mixture; null and empty
texts have 0 tokens and ride along; a source of 0 tokens with a weight gives nothing and is reported as short; an empty
table gives an empty mixture.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.llm.tokens import token_counts
from placeloom.runtime import cut

#: Records flown together in one bucket; open records that one flight leaves at most.
BUCKET_ROWS, OPEN = 20_000, 2
#: Records of each source that fly first, from the largest on.
FIRST = 200


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves ``p`` until at most two entries are between 0 and 1, keeping sum(p) and sum(p * x).

    Three open entries have a null vector of (1, x), given in closed form; the step along it or against it is drawn so
    that each entry keeps its expectation.
    """
    p = p.astype(float).tolist()
    x = x.astype(float).tolist()
    eps = 1e-12
    todo = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    draws = iter(rng.random(2 * len(todo) + 8).tolist())
    held: list[int] = []
    for nxt in todo:
        held.append(nxt)
        while len(held) == 3:
            i, j, k = held
            u = (x[k] - x[j], x[i] - x[k], x[j] - x[i])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[a]) / b if b > 0 else -p[a] / b for a, b in zip(held, u) if b)
            down = min(p[a] / b if b > 0 else (p[a] - 1) / b for a, b in zip(held, u) if b)
            step = up if next(draws, 0.5) * (up + down) < down else -down
            for a, b in zip(held, u):
                v = p[a] + step * b
                p[a] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
            held = [a for a in held if 0.0 < p[a] < 1.0]
    return np.array(p)


def lead_flight(x: list[float], p: float, rest: float, draws: list[float]) -> tuple[list[float], float]:
    """(0 or 1 of each record of the sizes ``x``, descending; the probability of all others, which hold ``rest`` tokens); all begin at ``p``.

    A record flies along the null vector of the token constraint that moves all smaller ones together against it: it goes
    to 1 in its probability, else to 0, and the common probability of the smaller ones makes up for the tokens. Where that
    would leave 0 to 1, the record has landed and what the others can't take up is the mixture's error.
    """
    out, common, left = [], p, sum(x) + rest
    for size, draw in zip(x, draws):
        left -= size
        taken = 1.0 if draw < common else 0.0
        if left > 0:
            common = min(1.0, max(0.0, common - (taken - common) * size / left))
        out.append(taken)
    return out, common


def _fly(groups: DataFrame, by: list[str], key_type: str, seed: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "id"], ascending=[False, True], kind="stable")
        rng = np.random.default_rng([seed, len(pdf), int(pdf["tokens"].sum()) & 0x7FFFFFFF])
        return pdf.assign(p=flight(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(), rng))[["source", "id", "tokens", "p"]]

    return groups.groupBy(*by).applyInPandas(run, f"source string, id {key_type}, tokens bigint, p double")


def _lead(rows: DataFrame, key_type: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(the largest records of each source with their p, the common p of the others of each source). One group has at most FIRST rows."""
    order = W.partitionBy("source").orderBy(F.desc("tokens"), F.asc("id"))
    first = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= FIRST)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        rest = float(pdf["own_tokens"].iloc[0] - pdf["tokens"].sum())
        rng = np.random.default_rng([seed, len(pdf), int(pdf["tokens"].sum()) & 0x7FFFFFFF])
        p, common = lead_flight(pdf["tokens"].astype(float).tolist(), float(pdf["p"].iloc[0]), rest, rng.random(len(pdf)).tolist())
        return pdf.assign(p=p, common=common)[["source", "id", "tokens", "p", "common"]]

    flown = cut(first.select("source", "id", "tokens", "p", "own_tokens", "rn").groupBy("source").applyInPandas(run, f"source string, id {key_type}, tokens bigint, p double, common double"))
    return flown.select("source", "id", "tokens", "p"), flown.groupBy("source").agg(F.max("common").alias("common"))


def source_report(counts: DataFrame, targets: DataFrame, total: int) -> DataFrame:
    """A row for each target source: own tokens, wanted tokens, uses per record, and whether it falls short."""
    own = counts.groupBy("source").agg(F.sum("tokens").alias("own_tokens"), F.count(F.lit(1)).alias("records"), F.max("tokens").alias("largest"))
    rows = targets.withColumn("total_tokens", F.lit(total).cast("bigint")).join(own, "source", "left").na.fill(0, ["own_tokens", "records", "largest"])
    wanted = F.col("target_weight") * F.col("total_tokens")
    return rows.select(
        "source", "target_weight", "max_repeats", "total_tokens", "own_tokens", "records", "largest", wanted.alias("wanted_tokens"),
        F.when(F.col("own_tokens") > 0, F.least(F.col("max_repeats").cast("double"), wanted / F.col("own_tokens"))).otherwise(0.0).alias("uses"),
        (F.col("max_repeats") * F.col("own_tokens") < wanted).alias("short"),
    )


#: Target sources of a mixture: a table of one row each is broadcast.
MAX_SOURCES = 10_000


def _small(per_source: DataFrame) -> DataFrame:
    """A table of at most one row for each target source, whose number is checked where the mixture begins."""
    return F.broadcast(per_source)


def _counted(docs: DataFrame, key: str, text: str, source: str, path: str | None) -> tuple[DataFrame, int]:
    counts = token_counts(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")), ["id", "source"], "text", path)
    counts = cut(counts)
    return counts, counts.agg(F.sum("tokens")).first()[0] or 0


def shortfalls(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """The report of targets before sampling; ``short`` marks sources whose capped records can't fill their share."""
    counts, total = _counted(docs, key, text, source, path)
    return source_report(counts, targets, total)


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None, seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """(mixture, report): rows key, source, tokens, repeats of the used records; and shares reached by each source."""
    kind = docs.schema[key].dataType.simpleString()
    if targets.select("source").count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    counts, total = _counted(docs, key, text, source, path)
    report = cut(source_report(counts, targets, total))
    plan = report.select("source", F.floor("uses").alias("base"), (F.col("uses") - F.floor("uses")).alias("p"), "own_tokens", F.greatest(F.lit(1), F.ceil(F.col("records") / BUCKET_ROWS)).alias("buckets"))
    rows = counts.join(_small(plan), "source")
    open_ = rows.filter("p > 0")
    lead, common = _lead(open_, kind, seed)
    bucket = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), n).alias("bucket")
    others = open_.drop("p").join(_small(common), "source").join(lead.select("source", "id"), ["source", "id"], "left_anti")
    others = others.select("source", "id", "tokens", F.col("common").alias("p"), bucket(seed, F.col("buckets")))
    settled, open_, level = lead, others, 0
    while True:
        flown = cut(_fly(open_, ["source", "bucket"], kind, seed + level))
        done = flown.filter("p = 0 or p = 1")
        settled = settled.unionByName(done)
        left = flown.filter("p > 0 and p < 1")
        most = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        level += 1
        if most <= OPEN:
            land = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("land"), "id"), 11) / F.lit(float(1 << 53))) < F.col("p")
            settled = settled.unionByName(left.withColumn("p", land.cast("double")))
            break
        fewer = max(1, -(-most // BUCKET_ROWS))
        open_ = left.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + level), "id"), F.lit(fewer)))
    extra = settled.filter("p = 1").select("source", "id", F.lit(1).alias("extra"))
    used = rows.select("source", "id", "tokens", "base").join(extra, ["source", "id"], "left").select(F.col("id").alias(key), "source", "tokens", (F.col("base") + F.coalesce("extra", F.lit(0))).alias("repeats")).filter("repeats > 0")
    used = cut(used)
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mix_tokens"), F.max("repeats").alias("most_repeats"))
    whole = used.agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0] or 1
    shares = report.join(got, "source", "left").na.fill(0, ["mix_tokens", "most_repeats"])
    return used, shares.withColumn("actual_share", F.col("mix_tokens") / F.lit(whole)).drop("total_tokens")
