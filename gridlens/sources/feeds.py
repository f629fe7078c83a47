"""Landed market feeds: JSON pages with a ``data`` array, flattened to typed tables.

A feed is described by data; one reader and one flattener serve all of them, for batch and
for streams. Pages are read with a fixed schema, so integer JSON numbers arrive as doubles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions.timeparts import parse_wall_clock, with_partition_parts
from gridlens.operators.quality import latest_per_key

INTERVAL = "struct<start string, end string, resolution string, value string>"

# Fuel columns of the mix feeds.
FUEL_COLUMNS = ("coal", "gas", "nuclear", "water", "wind", "solar", "other", "storage")


@dataclass(frozen=True)
class Feed:
    """Shape of one feed: where the interval is, what is measured, how rows are tagged, checked and stored.

    ``not_negative`` names the measure that a row must have and that may not be below zero; feeds without
    one are prices, whose components are reconciled. An ``upsert`` feed keeps what is stored, an
    ``overwrite`` feed replaces its table.
    """

    tag_column: str
    tag: str
    measures: tuple[str, ...]
    entity: str = "region"
    entity_constant: str | None = None
    interval: str = "timeInterval"
    attributes: tuple[tuple[str, str], ...] = ()
    nested: str | None = None
    nested_measures: tuple[str, ...] = ()
    not_negative: str | None = None
    sink: str = "upsert"

    @property
    def keys(self) -> list[str]:
        return [self.entity, "start_time"]

    @property
    def record_schema(self) -> str:
        parts = [] if self.entity_constant else [f"{self.entity} string"]
        parts.append(f"{self.interval} {INTERVAL}")
        parts += [f"{source} string" for source, _ in self.attributes]
        parts += [f"{m} double" for m in self.measures]
        if self.nested:
            inner = ", ".join(f"{m}: double" for m in self.nested_measures)
            parts.append(f"{self.nested} struct<{inner}>")
        return ", ".join(parts)

    @property
    def page_schema(self) -> str:
        return f"data array<struct<{self.record_schema}>>"


def _price(tag: str) -> Feed:
    return Feed(
        "price_type", tag, ("lmp", "mcc", "mec", "mlc"), entity="node",
        attributes=(("preliminaryFinal", "preliminary_final"),),
    )


def _mix(tag: str) -> Feed:
    return Feed("demand_type", tag, ("totalMw",), nested="fuelTypes", nested_measures=FUEL_COLUMNS, not_negative="totalMw")


def _amount(tag: str, measures: tuple[str, ...], **shape) -> Feed:
    return Feed("demand_type", tag, measures, not_negative=measures[0], sink="overwrite", **shape)


# Tags, constants and field names of the feeds.
FEEDS = {
    "da_exante": _price("da_exante"),
    "da_expost": _price("da_expost"),
    "rt_expost": _price("rt_expost"),
    "da_fuel_mix": _mix("da_fuel_mix"),
    "rt_fuel_mix": _mix("rt_fuel_mix"),
    "da_cleared_demand": _amount("da_cleared_demand", ("fixed", "priceSens", "virtual")),
    "da_cleared_generation_phys": _amount("da_cleared_generation_phys", ("supply",)),
    "da_cleared_generation_virtual": _amount("da_cleared_generation_virtual", ("supply",), entity_constant="NO_REGION"),
    "rt_cleared_demand": _amount("rt_cleared_demand", ("demand",), entity_constant="MISO", interval="interval"),
}


# When and from which file a record was landed; the order of :func:`newest_load`.
LOAD_COLUMNS = ("load_time", "load_file")


def with_load(pages: DataFrame) -> DataFrame:
    """Pages with the modification time and the path of their file, from the reader's hidden columns."""
    return pages.select(
        "*", F.col("_metadata.file_modification_time").alias("load_time"), F.col("_metadata.file_path").alias("load_file")
    )


def newest_load(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: from the file landed last, of files of one instant the last by name.

    Where one file repeats a key, the greatest values decide, so that repeated runs agree.
    """
    values = [c for c in rows.columns if c not in (*keys, *LOAD_COLUMNS)]
    return latest_per_key(rows, keys, [*LOAD_COLUMNS, *values])


def read_pages(spark: SparkSession, path, feed: Feed, multi_line: bool = False, load: bool = False) -> DataFrame:
    """Landed pages. One page per line splits across tasks; ``multi_line`` reads whole files.

    ``load`` adds :data:`LOAD_COLUMNS`. Folders of the form ``name=value`` add their columns.
    """
    pages = spark.read.schema(feed.page_schema).option("multiLine", multi_line).json(path)
    return with_load(pages) if load else pages


def stream_pages(spark: SparkSession, path: str, feed: Feed, **options) -> DataFrame:
    return spark.readStream.schema(feed.page_schema).options(**options).json(path)


def flatten_pages(pages: DataFrame, feed: Feed) -> DataFrame:
    """One typed row per record with its tag and the year, month and day of its start.

    Columns of the pages beside ``data`` stay with their records.
    """
    carried = [c for c in pages.columns if c != "data"]
    records = pages.select(F.inline("data"), *carried)
    entity = F.lit(feed.entity_constant) if feed.entity_constant else F.col(feed.entity)
    interval = F.col(feed.interval)
    flat = records.select(
        entity.alias(feed.entity),
        parse_wall_clock(interval["start"]).alias("start_time"),
        parse_wall_clock(interval["end"]).alias("end_time"),
        interval["resolution"].alias("resolution"),
        interval["value"].alias("interval_value"),
        *[F.col(source).alias(name) for source, name in feed.attributes],
        *feed.measures,
        *[F.col(f"{feed.nested}.{m}").alias(m) for m in feed.nested_measures],
        F.lit(feed.tag).alias(feed.tag_column),
        *carried,
    )
    return with_partition_parts(flat, "start_time")


def read_feed(spark: SparkSession, path, name: str, multi_line: bool = False, load: bool = False) -> DataFrame:
    feed = FEEDS[name]
    return flatten_pages(read_pages(spark, path, feed, multi_line, load), feed)


def read_nodes(spark: SparkSession, path: str, attributes: str) -> DataFrame:
    """Node records with the page they came from.

    Pages lie in ``page_fetched=N`` folders; ``attributes`` is the DDL of a record.
    """
    schema = f"data array<struct<{attributes}>>, page_fetched int"
    return spark.read.schema(schema).json(path).select(F.inline("data"), "page_fetched")
