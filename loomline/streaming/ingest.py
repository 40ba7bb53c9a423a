"""Lineage run records as a stream: an addition to the batch ingestion, with the same extraction."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.sources.runs import records, run_edges
from loomline.sources.store import Store

PAYLOADS = "file_id long, delivered_at timestamp, payload string"


def run_stream(payloads: DataFrame, delay: str = "2 days") -> DataFrame:
    """Records of a stream of payloads (file_id, delivered_at, payload); a record of the same run and place is let through once within the delay, and the
    state of older runs is dropped with the watermark. A record without a run id is only a copy of the same place of the same file."""
    recs = records(payloads, keep=["file_id", "delivered_at"])
    own = F.coalesce("run_id", F.concat_ws("/", F.lit("file"), "file_id", "pos"))
    return recs.withColumn("_run", own).withWatermark("delivered_at", delay).dropDuplicatesWithinWatermark(["_run", "pipeline_id", "event_type"]).drop("_run")


def hourly_counts(payloads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Records per hour of delivery and event type; an hour comes out when the watermark has passed it."""
    recs = records(payloads, keep=["delivered_at"])
    return recs.withWatermark("delivered_at", delay).groupBy(F.window("delivered_at", "1 hour"), "event_type").agg(F.count("*").alias("n"))


def commit_edges(payloads: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Appends each batch's edges to the store as one commit; empty batches make none, and a batch that is repeated after a failure is committed once."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def commit(batch: DataFrame, number: int) -> None:
        edges = run_edges(batch).distinct().withColumn("properties", F.lit("{}"))
        if not edges.isEmpty():
            store.write("append", batch=f"{name}-{number}", edges=edges)

    return run_stream(payloads).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
