"""A sample with given shares of each stratum, a floor for small strata and a report of what could not be met.

Each stratum's quota is ``max(min_rows, floor(share * size))``. Every request draws one number from a hash of its id; it
is accepted when the number is below quota / observed, widened a little so that too few are drawn only by rare chance.
The surplus is then cut exactly, by rank of the draw; a stratum that drew too few is drawn again in full, so the counts
never depend on luck. Ranks are taken within hash ranges (``exact_rank``), so no stratum is sorted in one task.

Defined cases: the language is compared trimmed and in lower case, other categories as they are; rows with a null category belong to no
stratum but count in the size; repeated rows of a request count once; a request in two strata is counted in each; an
empty table gives an empty sample and a report in which each stratum with a floor falls short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.runtime import cut, exact_rank

#: Part of the requests that the sample holds; the surplus drawn, in standard deviations of the count.
FRACTION_OF, SURPLUS_SD = 5, 5.0
#: Target strata of a sample: their quotas are broadcast.
MAX_STRATA = 10_000


def _category(c: str, lower: bool) -> Column:
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")) if lower else F.col(c)


def stratum_requests(plan: DataFrame, key: str, strata: list[str], lowered: str) -> DataFrame:
    """Distinct (stratum, key) of rows with all categories."""
    cols = [_category(c, c == lowered).alias(c) for c in strata]
    return plan.select(key, *cols).dropna(subset=[key, *strata]).distinct()


def quota_report(plan: DataFrame, targets: DataFrame, key: str = "request_id", strata: tuple[str, ...] = ("isolanguage", "sample_source", "pool"), lowered: str = "isolanguage", one_in: int = FRACTION_OF) -> DataFrame:
    """A row for each target stratum: observed, quota, taken and deficit (requests), size of the sample."""
    strata = list(strata)
    members = stratum_requests(plan, key, strata, lowered)
    observed = members.groupBy(*strata).agg(F.count(F.lit(1)).alias("observed"))
    size = plan.select(key).distinct().agg(F.count(key)).first()[0] // one_in
    wanted = targets.withColumn("size", F.lit(size).cast("bigint"))
    quota = F.greatest(F.col("min_rows").cast("bigint"), F.floor(F.col("target_share") * F.col("size")))
    keyed = wanted.select(*[F.col(c).alias(f"t_{c}") for c in strata], *[_category(c, c == lowered).alias(c) for c in strata], "target_share", "min_rows", "size", quota.alias("quota"))
    full = keyed.join(observed, strata, "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    taken = F.least("quota", "observed")
    return full.select(*[F.col(f"t_{c}").alias(c) for c in strata], "target_share", "min_rows", "size", "observed", "quota", taken.alias("taken"), (F.col("quota") - taken).alias("deficit"))


def sample_to_targets(plan: DataFrame, targets: DataFrame, key: str = "request_id", strata: tuple[str, ...] = ("isolanguage", "sample_source", "pool"), lowered: str = "isolanguage", one_in: int = FRACTION_OF, seed: int = 17) -> DataFrame:
    """The sample: one row (key, strata) for each accepted request."""
    if targets.count() > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} target strata")
    names = list(strata)
    report = quota_report(plan, targets, key, strata, lowered, one_in)
    p = F.col("quota") / F.greatest("observed", F.lit(1))
    wide = F.least(F.lit(1.0), p + F.lit(SURPLUS_SD) * F.sqrt(p / F.greatest("observed", F.lit(1))) + F.lit(SURPLUS_SD) / F.greatest("observed", F.lit(1)))
    # the report has as many rows as the targets, a fixed table of categories
    quotas = report.select(*[_category(c, c == lowered).alias(c) for c in names], "quota", "taken", wide.alias("p"))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") / F.lit(float(1 << 53))).alias("draw")
    members = stratum_requests(plan, key, names, lowered).join(F.broadcast(quotas), names).select("*", draw)
    drawn = cut(members.filter(F.col("draw") < F.col("p")))
    short = drawn.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.first("taken").alias("need"))
    short = quotas.join(short.select(*names, "n"), names, "left").filter("taken > coalesce(n, 0)").select(*names)
    # strata that drew too few, by chance of under one in a million each, are drawn again with p = 1
    again = members.join(F.broadcast(short), names, "left_semi")
    pool = drawn.join(F.broadcast(short), names, "left_anti").unionByName(again)
    ranked = exact_rank(pool.withColumn("draw", F.col("draw")), names, [key], "rank")
    return ranked.filter("rank <= quota").select(key, *names)


def drawn_report(plan: DataFrame, targets: DataFrame, key: str = "request_id", strata: tuple[str, ...] = ("isolanguage", "sample_source", "pool"), lowered: str = "isolanguage", one_in: int = FRACTION_OF, seed: int = 17) -> DataFrame:
    """``quota_report`` with taken and deficit counted in the drawn sample."""
    names = list(strata)
    report = quota_report(plan, targets, key, strata, lowered, one_in)
    drawn = sample_to_targets(plan, targets, key, strata, lowered, one_in, seed).groupBy(*names).agg(F.count(F.lit(1)).alias("drawn"))
    on = [_category(c, c == lowered).eqNullSafe(F.col(f"d_{c}")) for c in names]
    full = report.join(drawn.select(*[F.col(c).alias(f"d_{c}") for c in names], "drawn"), on, "left")
    taken = F.coalesce("drawn", F.lit(0))
    return full.select(*[c for c in report.columns if c not in ("taken", "deficit")], taken.alias("taken"), (F.col("quota") - taken).alias("deficit"))
