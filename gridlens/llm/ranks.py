"""Places of rows in an order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.session import stage

# Rows of a range partition, about.
PART_ROWS = 200_000


def numbered(rows: DataFrame, group: str, order: list[str], label: str, part_rows: int | None = None) -> DataFrame:
    """Stored ``rows`` with ``pos``, their place in ``group`` from 0, and the group's ``size``.

    The rows are cut into ranges of (group, order) and stored with the number of their range; ranges are
    numbered one by one and the counts of the ranges before give the rest. A range is one task's work, so
    ``order`` must tell rows apart: equal values of all of it would fall into one range.
    """
    parts = max(1, -(-rows.count() // (part_rows or PART_ROWS)))
    ranged = rows.repartitionByRange(parts, group, *order).withColumn("_part", F.spark_partition_id())
    placed = stage(ranged, f"{label}-order")
    counts = stage(placed.groupBy(group, "_part").agg(F.count("*").alias("_n")), f"{label}-counts")
    whole = Window.partitionBy(group)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    offsets = counts.select(group, "_part", F.sum("_n").over(whole).alias("size"), before.alias("_before"))
    inside = Window.partitionBy(group, "_part").orderBy(*order)
    return placed.join(offsets, [group, "_part"]).withColumn("pos", F.col("_before") + F.row_number().over(inside) - 1).drop("_part", "_before")
