"""The combined analysis set: prices, regimes, weather and fuel mix per node hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.timeparts import with_partition_parts
from gridlens.operators.fuel import pct_of_seasonal_avg, with_fuel_flags
from gridlens.operators.prices import with_regime, with_regime_durations
from gridlens.operators.weather import weather_features
from gridlens.session import stage, stage_all
from gridlens.sinks.ingest import DAILY
from gridlens.sinks.tables import write_counted


def node_hours(dart: DataFrame, weather: DataFrame, fuel: DataFrame) -> DataFrame:
    """Regimes and run lengths per node hour with weather and fuel features.

    ``dart`` is the joined price table; ``weather`` (UTC) and ``fuel`` (comparison of one
    region) hold one row per hour. The hourly features are stored before the join, so that
    Spark sees their size: it broadcasts them when small and shuffles otherwise.
    """
    features = stage_all(
        weather=weather_features(weather), fuel=with_fuel_flags(fuel).drop("region")
    )
    return (
        with_regime_durations(with_regime(dart))
        .join(features["weather"], "start_time", "left")
        .join(features["fuel"], "start_time", "left")
    )


def combined_dataset(dart: DataFrame, expost: DataFrame, weather: DataFrame, fuel: DataFrame) -> DataFrame:
    """:func:`node_hours` with the ex-post price and the wind output in percent of its winter mean.

    The joined rows are stored once, because the percentage needs their mean.
    """
    prices = expost.select("node", "start_time", F.col("lmp").alias("lmp_da_expost"))
    joined = node_hours(dart, weather, fuel).join(prices, ["node", "start_time"], "left")
    return pct_of_seasonal_avg(stage(joined, "combined"), "WindMW_RT", "WindMW_RT_PctOfSeasonalAvg")


def write_combined(rows: DataFrame, path: str) -> int:
    """Store the combined set by day, as its readers select days, and return how many rows it has."""
    return write_counted(with_partition_parts(rows, "start_time"), path, DAILY, "overwrite", "static")
