"""Partitioned Parquet sinks.

Writers put a ``rebalance`` hint on the partition columns: a table partition becomes few
files, and one that holds much of the data is split over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridlens.operators.quality import latest_per_key
from gridlens.sources.tables import table_exists

PARTITIONS = ("year", "month")


def _balanced(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    return df.hint("rebalance", *partition_by)


def _write(df: DataFrame, path: str, partition_by: Sequence[str], mode: str, overwrite_mode: str = "dynamic"):
    (
        df.write.mode(mode)
        .option("compression", "zstd")
        .option("partitionOverwriteMode", overwrite_mode)
        .partitionBy(*partition_by)
        .parquet(path)
    )


def overwrite_table(df: DataFrame, path: str, partition_by: Sequence[str] = PARTITIONS) -> None:
    """Replace the whole table."""
    _write(_balanced(df, partition_by), path, partition_by, "overwrite", "static")


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str] = PARTITIONS) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    _write(_balanced(df, partition_by), path, partition_by, "overwrite")


def _ends(source: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """One row: per partition column the least and greatest value, and whether any is NULL."""
    return source.agg(*[
        F.struct(F.min(p).alias("low"), F.max(p).alias("high"), F.coalesce(F.max(F.isnull(p)), F.lit(False)).alias("none")).alias(p)
        for p in partition_by
    ])


def _within_partitions(stored: DataFrame, source: DataFrame, partition_by: Sequence[str], known: bool = False) -> DataFrame:
    """Stored rows inside the range of each partition column in the source.

    The range comes from a scalar subquery, so Spark skips the other partitions at run time
    whether or not the source carries a filter. With ``known`` it is looked up first: one look at a source
    that is kept, where every use of a subquery would be a look of its own.
    """
    ends = _ends(source, partition_by)
    bounds = None if known else ends.select(F.struct(*partition_by)).scalar()
    row = ends.first() if known else None
    for p in partition_by:
        if known:
            low, high, none = (F.lit(v) for v in row[p])
        else:
            low, high, none = bounds[p]["low"], bounds[p]["high"], bounds[p]["none"]
        within = F.col(p).between(low, high)
        stored = stored.where(F.coalesce(within, F.lit(False)) | (F.col(p).isNull() & none))
    return stored


def new_rows(
    source: DataFrame,
    stored: DataFrame,
    keys: Sequence[str],
    partition_by: Sequence[str],
    span: DataFrame | None = None,
    known: bool = False,
) -> DataFrame:
    """Source rows whose key is not stored, NULL equal to NULL; reads only partitions near the source's.

    ``span`` is a cheaper frame with the same partition columns, such as the source before
    deduplication. With ``known`` its partitions are looked up by a job before the plan is made.
    """
    near = _within_partitions(stored, source if span is None else span, partition_by, known).select(*keys)
    renamed = near.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)])
    same = [source[k].eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return source.join(renamed, same, "left_anti")


def insert_only_upsert(
    spark: SparkSession,
    source: DataFrame,
    path: str,
    keys: Sequence[str],
    newest_by: Sequence[str],
    partition_by: Sequence[str] = PARTITIONS,
) -> int:
    """Append source rows with unknown keys and return how many were inserted.

    The source is deduplicated first. Running it again with the same source inserts nothing.
    Partition columns must follow from the key.
    """
    unique = latest_per_key(source, keys, newest_by)
    fresh = new_rows(unique, spark.read.parquet(path), keys, partition_by, span=source, known=True)
    return _append_counted(fresh, path, partition_by)


def _append_counted(df: DataFrame, path: str, partition_by: Sequence[str]) -> int:
    return write_counted(df, path, partition_by, "append")


def write_counted(df: DataFrame, path: str, partition_by: Sequence[str], mode: str, overwrite_mode: str = "dynamic") -> int:
    """Write and count in one job.

    The count sits above the rebalance: below it, Spark may drop it with an empty stage.
    """
    written = Observation()
    counted = _balanced(df, partition_by).observe(written, F.count(F.lit(1)).alias("rows"))
    _write(counted, path, partition_by, mode, overwrite_mode)
    return written.get["rows"]


def upsert_unique(
    spark: SparkSession, source: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = PARTITIONS
) -> int:
    """Insert-only upsert of a source that has one row per key; creates the table on first use.

    The source is looked at twice (its partitions, its rows), so it should be a stored table.
    """
    if table_exists(spark, path):
        source = new_rows(source, spark.read.parquet(path), keys, partition_by, known=True)
    return _append_counted(source, path, partition_by)


def create_or_upsert(
    spark: SparkSession,
    source: DataFrame,
    path: str,
    keys: Sequence[str],
    newest_by: Sequence[str],
    partition_by: Sequence[str] = PARTITIONS,
) -> int:
    """Insert-only upsert that creates the table on first use."""
    if table_exists(spark, path):
        return insert_only_upsert(spark, source, path, keys, newest_by, partition_by)
    return _append_counted(latest_per_key(source, keys, newest_by), path, partition_by)


def append_deduped(
    spark: SparkSession,
    incoming: DataFrame,
    path: str,
    keys: Sequence[str],
    partition_by: Sequence[str] = PARTITIONS,
) -> int:
    """Merge incoming rows into a table, incoming rows winning over stored ones.

    Only partitions touched by the incoming rows are read and replaced. Keys must be unique
    inside ``incoming``. Returns the rows of the replaced partitions.
    """
    tagged = incoming.withColumn("_load", F.lit(1))
    if table_exists(spark, path):
        touched = incoming.select(*partition_by).distinct()
        near = _within_partitions(spark.read.parquet(path), incoming, partition_by, known=True)
        stored = near.join(touched, list(partition_by), "left_semi")
        tagged = tagged.unionByName(stored.withColumn("_load", F.lit(0)))
    merged = latest_per_key(tagged, keys, ["_load"]).drop("_load")
    return write_counted(merged, path, partition_by, "overwrite")


def require_rows(df: DataFrame, what: str = "source") -> DataFrame:
    """Fail early on an empty input."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
