"""Column-oriented weather documents: parallel arrays to hourly rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions.timeparts import ISO_MINUTES, parse_wall_clock, with_partition_parts
from gridlens.operators.weather import HOURLY_VARIABLES

# The station of the weather study.
STATION = {"station_id": "KMSP", "latitude": 44.88200, "longitude": -93.22180}


def hourly_schema(variables: Sequence[str] = HOURLY_VARIABLES) -> str:
    arrays = ", ".join(f"{v}: array<double>" for v in variables)
    return f"hourly struct<time: array<string>, {arrays}>"


def flatten_hourly(
    documents: DataFrame, variables: Sequence[str] = HOURLY_VARIABLES, station: dict = STATION
) -> DataFrame:
    """One row per element of the parallel arrays, with the station's constants.

    A variable that is absent from a document is NULL on its rows.
    """
    empty = F.array().cast("array<double>")
    arrays = [F.coalesce(F.col(f"hourly.{v}"), empty).alias(v) for v in variables]
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), *arrays)
    rows = documents.select(F.inline(zipped))
    flat = rows.select(
        parse_wall_clock(F.col("time"), ISO_MINUTES).alias("timestamp"),
        *[F.lit(station[c]).alias(c) for c in ("latitude", "longitude", "station_id")],
        *variables,
    )
    return with_partition_parts(flat, "timestamp")


def read_weather(
    spark: SparkSession, path, variables: Sequence[str] = HOURLY_VARIABLES, station: dict = STATION
) -> DataFrame:
    documents = spark.read.schema(hourly_schema(variables)).json(path)
    return flatten_hourly(documents, variables, station)
