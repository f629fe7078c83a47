"""Ingest jobs: landed pages of a feed through its rule into its table, with counters of the same pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridlens.operators.quality import apply_rule
from gridlens.session import scratch, stage
from gridlens.sinks.tables import append_deduped, require_rows, upsert_unique, write_counted
from gridlens.sources.feeds import FEEDS, LOAD_COLUMNS, Feed, flatten_pages, newest_load, read_feed, read_pages
from gridlens.sources.tables import table_exists

DAILY = ("year", "month", "day")


@dataclass(frozen=True)
class IngestReport:
    """What one run of a job did; ``days`` are those it was to fetch, where it works by days."""

    feed: str
    sink: str
    rows_read: int
    rows_kept: int
    rows_removed: int
    rows_mismatched: int
    rows_written: int
    days: int | None = None


REPORT = (
    "feed string, sink string, rows_read long, rows_kept long, rows_removed long, rows_mismatched long, rows_written long, days int"
)


def report_table(spark: SparkSession, reports: Sequence[IngestReport]) -> DataFrame:
    """Reports as a table, a row per run."""
    return spark.createDataFrame([tuple(asdict(r).values()) for r in reports], REPORT)


def _checked(rows: DataFrame, feed: Feed) -> tuple[DataFrame, dict[str, int]]:
    """One stored row per key that passes the feed's rule, from its newest load, and the rule's counters.

    The landed pages are read once: the counters come from the pass that stores the rows.
    """
    counters = Observation()
    kept = stage(newest_load(apply_rule(rows, feed.not_negative, counters), feed.keys).drop(*LOAD_COLUMNS), "ingest")
    return kept, counters.get


def ingest_feed(spark: SparkSession, landing, path: str, name: str, sink: str | None = None, partition_by: Sequence[str] = DAILY) -> IngestReport:
    """Bring a feed's table up to date with everything landed.

    ``sink`` is the feed's own unless given: ``upsert`` adds unknown keys, ``append`` lets landed rows
    win over stored ones, ``overwrite`` replaces the table, ``overwrite_partitions`` the partitions
    that have landed rows. A landing without a row that passes the rule is refused, so that it can't
    empty a table.
    """
    feed = FEEDS[name]
    kind = sink or feed.sink
    with scratch(spark):
        rows, counts = _checked(read_feed(spark, landing, name, load=True), feed)
        require_rows(rows, f"{name}: the landing")
        if kind == "upsert":
            written = upsert_unique(spark, rows, path, feed.keys, partition_by)
        elif kind == "append":
            written = append_deduped(spark, rows, path, feed.keys, partition_by)
        else:
            written = write_counted(rows, path, partition_by, "overwrite", "static" if kind == "overwrite" else "dynamic")
    return IngestReport(name, kind, **counts, rows_written=written)


def missing_days(spark: SparkSession, path: str, start: date, end: date) -> list[date]:
    """Days of the half-open window without a stored partition, in order.

    The anti-join reads the partition values of the window's months and no data; its result has at most as
    many rows as the window has days.
    """
    window = spark.range(max(0, (end - start).days)).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))
    if table_exists(spark, path):
        last = end - timedelta(days=1)
        number = F.col("year") * 12 + F.col("month")
        stored = spark.read.parquet(path).where(
            F.col("year").between(start.year, last.year) & number.between(start.year * 12 + start.month, last.year * 12 + last.month)
        )
        stored = stored.select(F.make_date("year", "month", "day").alias("day")).distinct()
        window = window.join(stored, "day", "left_anti")
    return [r.day for r in window.orderBy("day").collect()]


def ingest_window(spark: SparkSession, landing: str, path: str, name: str, start: date, end: date) -> IngestReport:
    """Fetch the days of a window that are not stored yet and write only their partitions.

    Pages lie in ``landed=YYYY-MM-DD`` folders, of which only the missing days' are read; rows of other
    days in them are not taken. A second run finds nothing to do and reads nothing. Missing days without any landed
    row are refused.
    """
    feed = FEEDS[name]
    days = missing_days(spark, path, start, end)
    if not days:
        return IngestReport(name, "window", 0, 0, 0, 0, 0, days=0)
    pages = read_pages(spark, landing, feed, load=True).where(F.col("landed").isin(*days)).drop("landed")
    rows = flatten_pages(pages, feed)
    with scratch(spark):
        kept, counts = _checked(rows.where(F.to_date("start_time").isin(*days)), feed)
        require_rows(kept, f"{name}: the window")
        written = write_counted(kept, path, DAILY, "overwrite")
    return IngestReport(name, "window", **counts, rows_written=written, days=len(days))
