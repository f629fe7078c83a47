"""Streaming price ingest: landed pages to a deduplicated, insert-only table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gridlens.operators.quality import COUNTERS, apply_rule
from gridlens.sinks.tables import PARTITIONS, create_or_upsert
from gridlens.sources.feeds import FEEDS, flatten_pages, stream_pages

PRICE_KEYS = ("node", "start_time")
# Name of the rule's counters in a query's progress.
RULE = "price_rule"
BATCH = "batch long, " + ", ".join(f"{c} long" for c in COUNTERS) + ", rows_late long, rows_repeated long, rows_inserted long, state_rows long"


def dedupe_stream(
    rows: DataFrame, keys: Sequence[str], event_time: str, lateness: str = "3 days"
) -> DataFrame:
    """First row per key; state for a key is dropped once the watermark has passed it.

    The watermark needs a zoned event time; a wall clock is read in the session zone.
    """
    timed = rows.withColumn("_event_time", rows[event_time].cast("timestamp"))
    unique = timed.withWatermark("_event_time", lateness).dropDuplicatesWithinWatermark(list(keys))
    return unique.drop("_event_time")


def clean_price_stream(
    spark: SparkSession, path: str, feed: str = "da_exante", lateness: str = "3 days", **options
) -> DataFrame:
    """Landing folder to reconciled prices with one row per node hour; the rule's counters are in the progress."""
    spec = FEEDS[feed]
    flat = flatten_pages(stream_pages(spark, path, spec, **options), spec)
    return dedupe_stream(apply_rule(flat, None, RULE), PRICE_KEYS, "start_time", lateness)


def upsert_stream(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    newest_by: Sequence[str],
    partition_by: Sequence[str] = PARTITIONS,
    available_now: bool = True,
    inserted: dict[int, int] | None = None,
) -> StreamingQuery:
    """Run every micro-batch through the insert-only upsert; ``inserted`` gets its rows by batch number.

    A batch repeated after a failure inserts nothing twice, because its keys are stored. The merge
    looks at the batch several times, so the batch is kept meanwhile: its pages are read and its state
    is written once.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            if not kept.isEmpty():
                added = create_or_upsert(batch.sparkSession, kept, path, keys, newest_by, partition_by)
                if inserted is not None:
                    inserted[batch_id] = added
        finally:
            kept.unpersist()

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batch_counts(query: StreamingQuery, inserted: dict[int, int]) -> list[tuple[int, ...]]:
    """A row of :data:`BATCH` per micro-batch that read something, from the progress of an ended query.

    Rows behind the watermark and repeated keys are counted by the operator that holds the keys; its state
    keeps as many keys as arrive in the time that rows may be late.
    """
    counts = []
    for progress in query.recentProgress:
        seen = progress.observedMetrics.get(RULE)
        # A run that finds nothing reports progress too.
        if progress.numInputRows and seen is not None and progress.stateOperators:
            holder = progress.stateOperators[0]
            repeated = holder.customMetrics.get("numDroppedDuplicateRows", 0)
            counts.append((
                progress.batchId, *(seen[c] for c in COUNTERS), holder.numRowsDroppedByWatermark, repeated,
                inserted.get(progress.batchId, 0), holder.numRowsTotal,
            ))
    return counts


def ingest_available(
    spark: SparkSession, landing: str, path: str, checkpoint: str, feed: str = "da_exante", lateness: str = "3 days",
    partition_by: Sequence[str] = PARTITIONS, **options,
) -> list[tuple[int, ...]]:
    """Stream everything landed since the last run into the price table; a row of counters per micro-batch.

    Files read, keys seen and the watermark are in the checkpoint, so a run goes on where the last one
    ended. A key stays as it was stored first.
    """
    inserted: dict[int, int] = {}
    rows = clean_price_stream(spark, landing, feed, lateness, **options)
    query = upsert_stream(rows, path, checkpoint, PRICE_KEYS, ["lmp"], partition_by, inserted=inserted)
    query.awaitTermination()
    return batch_counts(query, inserted)
