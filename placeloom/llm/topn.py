"""The N best rows of every group, whatever the groups' sizes.

Rows of one item are first folded to the item's best, on (group, item), which spreads a group of any size over all tasks;
then a ``row_number`` window with a rank filter. Catalyst plans that filter as a group limit on both sides of the second
exchange, so at most N rows of a group leave a task.

Defined cases: rows with a null or NaN score and rows with a null group or item don't count; a null secondary score is 0;
ties go to the smaller item; groups with fewer items give all of them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_items(df: DataFrame, group: str, item: str, score: str, second: str, n: int = 5) -> DataFrame:
    """Columns group, item, score, second, rank: the first ``n`` items by score desc, second desc, item asc."""
    if n < 1:
        raise ValueError("n must be positive")
    spark = df.sparkSession
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"), F.coalesce(F.col(second), F.lit(0)).alias("p")).filter("s is not null and not isnan(s) and g is not null and i is not null")
    # -0.0 and 0.0 are one score; adding 0.0 makes them one value
    rows = rows.withColumn("s", F.col("s") + F.lit(0.0))
    # max of the second score among rows of one score, then the row with the highest: both hash aggregates on plain types
    level = rows.groupBy("g", "i", "s").agg(F.max("p").alias("p"))
    best = level.groupBy("g", "i").agg(F.max("s").alias("s"), F.max_by("p", "s").alias("p"))
    ranked = spark.sql(
        f"SELECT g, i, s, p, rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, p DESC, i ASC) AS rank FROM {{best}}) WHERE rank <= {int(n)}",
        best=best,
    )
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("p").alias(second), "rank")
