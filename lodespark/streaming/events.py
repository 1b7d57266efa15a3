"""Structured Streaming over event logs: sources, sessions, last writer wins, upserts by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.operators.incremental import VersionedTarget, latest_per


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of JSON events from the files that arrive below ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def session_windows(events: DataFrame, gap: str = "600 seconds", late: str | None = None) -> DataFrame:
    """session, start, end, n: runs of a session's events without a pause of ``gap``; on streams with a watermark of ``late``.

    ``events``: session, at (any timestamp type). Null sessions or times are dropped.
    """
    rows = events.where(F.col("session").isNotNull() & F.col("at").isNotNull()).withColumn("at", F.col("at").cast("timestamp"))
    if late is not None:
        rows = rows.withWatermark("at", late)
    w = F.session_window("at", gap)
    return rows.groupBy("session", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert_batches(target: VersionedTarget, key: list[str], order: list[str]):
    """A function for ``foreachBatch``: each micro batch is reduced to the last event of every key and published as one version.

    A batch that is delivered again after a failure finds its version published and changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        target.process(latest_per(batch, key, order), number)

    return run
