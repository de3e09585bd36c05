"""A table of requests led through a generator: asked, parsed, checked, asked again, with a row for each finished request.

The generator is a function on tables: it gets the pending requests with their messages and adds a column ``response``
(null where the call itself failed). Each attempt is one job over all pending requests; what is finished is cut off.

Defined cases: requests that are done at the version are not asked again; an answer that is no proper JSON, or breaks its
kind's contract, is asked again up to ``attempts`` times and then kept as invalid with its last reason; a request whose
call failed each time gives no row, so that a later run asks again; an empty plan gives no rows; columns of the plan are
kept, others than the checkpoint's are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.operators.validate import invalid_reason, parse_response
from placeloom.plans.messages import system_message, user_message
from placeloom.runtime import cut

UNPARSED = "no usable answer"


def generate(plan: DataFrame, ask: Callable[[DataFrame], DataFrame], version: str, done: DataFrame | None = None, attempts: int = 3) -> DataFrame:
    """Rows of the checkpoint: the plan's columns, query, entities, confidence, prompt_version, valid, invalid_reason, attempts."""
    own = plan.columns
    pending = plan if done is None else plan.join(done.select("request_id").distinct(), "request_id", "left_anti")
    fields = [F.col(c) for c in ("sample_source", "isolanguage", "name", "admin1_name", "country_name", "style", "topic")]
    pending = cut(pending.select(*own, system_message(F.col("sample_source")).alias("system"), user_message(*fields).alias("message")))
    finished = []
    for i in range(1, attempts + 1):
        got = ask(pending.withColumn("attempt", F.lit(i))).select(*own, "system", "message", "response")
        answer = got.select("*", parse_response(F.col("response")).alias("a"))
        reason = F.when(F.col("a").isNull(), F.lit(UNPARSED)).otherwise(invalid_reason(F.col("a.query"), F.col("a.entities"), F.coalesce("sample_source", F.lit("")), F.coalesce("name", F.lit(""))))
        judged = cut(answer.withColumn("invalid_reason", reason))
        last = F.lit(i == attempts)
        over = judged.filter(F.col("response").isNotNull() & (F.col("invalid_reason").isNull() | last))
        finished.append(over.select(*own, F.col("a.query").alias("query"), F.col("a.entities").alias("entities"), F.col("a.confidence").alias("confidence"), F.lit(version).alias("prompt_version"), F.col("invalid_reason").isNull().alias("valid"), "invalid_reason", F.lit(i).alias("attempts")))
        pending = judged.filter(F.col("response").isNull() | (F.col("invalid_reason").isNotNull() & ~last)).select(*own, "system", "message")
    return reduce(DataFrame.unionByName, finished)
