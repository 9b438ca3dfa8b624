"""Streaming side of the append-only ledger: each micro-batch is appended once, windows count evidence by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_ledger(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append a stream of evidence rows to a Parquet ledger. The checkpoint makes a restart write nothing twice;
    rows repeated within the watermark (two hours) are dropped by evidence_id."""
    w = stream.withWatermark("recorded_at", "2 hours").dropDuplicatesWithinWatermark(["evidence_id"])
    q = w.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (q.trigger(availableNow=True) if once else q).start()


def evidence_windows(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Supporting and refuting evidence by tumbling window, rows later than `late` left out."""
    return stream.withWatermark("recorded_at", late).groupBy(F.window("recorded_at", width), "category").agg(F.count_if(F.col("kind") == "SUPPORTING").alias("supporting"), F.count_if(F.col("kind") == "REFUTING").alias("refuting"))
