"""Incremental ingest of reports with file-source Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import normalize_text
from ..operators.nested import explode_positions, with_members


def positions_stream(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Cleaned positions of newly arrived reports; a report delivered again within ``late`` is dropped.

    ``stream`` needs ``id``, ``positions`` and an event time ``received_at``.
    """
    s = stream.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", late).dropDuplicatesWithinWatermark(["id"])
    p = with_members(explode_positions(s, ["id", "received_at"]), "targets")
    return p.withColumn("stakeholder", normalize_text("stakeholder"))


def ingest(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, late: str = "30 days") -> None:
    """Process all reports that arrived at ``source`` since the last run, then stop; exactly once by checkpoint."""
    stream = spark.readStream.schema(schema).parquet(source)
    q = positions_stream(stream, late).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """``(window_start, key, n)`` per tumbling window with a watermark for late rows."""
    s = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return s.groupBy(F.window("_t", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
