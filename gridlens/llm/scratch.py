"""Disk held by finished jobs."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs.

    It does so when the driver's collector finds that nothing refers to a shuffle any more, which a
    quiet driver may not do for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
