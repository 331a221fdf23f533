"""Continuous application of action logs: a stream of action rows or files folded into a snapshot store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators.store import Store
from recordloom.sources.text import ACTIONS


def action_rows(spark: SparkSession, path: str) -> DataFrame:
    """A stream of Parquet action rows (seq, op, uuid, fields) that arrive in a folder."""
    return spark.readStream.schema(ACTIONS).parquet(path)


def applied(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Commits each micro-batch as one version, exactly once.

    The manifest of the version that a batch makes holds the batch's number, under the name of the checkpoint, so a
    batch that is replayed after a failure is recognised. Within a batch, actions go by seq.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.apply(batch.select("seq", "op", "uuid", "fields"), batch=(checkpoint.rstrip("/"), number))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts(stream: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Actions of each kind in windows of the time in their ids, with a watermark for late ones."""
    from recordloom.functions.ids import decode

    timed = stream.withColumn("at", decode(F.col("uuid")).cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", window), "op").agg(F.count(F.lit(1)).alias("n"))
