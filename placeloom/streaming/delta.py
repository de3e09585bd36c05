"""Deltas and checkpoints as streams: each micro-batch changes the staging tables or appends finished requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placeloom import schemas as S
from placeloom.operators.corpus import keep_one, upsert
from placeloom.sources.dumps import read_table, write_table


def upsert_stream(stream: DataFrame, path: str, key: str, schema, order: list[str], checkpoint: str) -> StreamingQuery:
    """Puts each micro-batch over the table at ``path``; in a batch the last row by ``order`` wins. A batch that is run again changes nothing more."""

    def put(batch: DataFrame, _: int) -> None:
        new = keep_one(batch, [key], [F.col(c).desc_nulls_last() for c in order])
        write_table(upsert(read_table(batch.sparkSession, path, schema), new, key), path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpoint_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished requests as JSON lines, each micro-batch once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def place_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of place versions that arrive in a folder."""
    schema = S.T.StructType([*S.GEONAMES.fields, S.T.StructField("loaded_at", S.T.TimestampNTZType())])
    return spark.readStream.schema(schema).parquet(folder)


def arrivals(stream: DataFrame, at: str = "searched_at", late: str = "1 hour", window: str = "1 day", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per event-time window, closed when the watermark has passed."""
    timed = stream.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
