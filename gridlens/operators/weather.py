"""Weather: cleaning, hourly features, climate shift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.labels import temperature_bucket
from gridlens.functions.numbers import sample_skewness
from gridlens.functions.timeparts import is_winter, utc_to_market
from gridlens.operators.quality import drop_flagged, latest_per_key, weather_flags
from gridlens.operators.series import fill_gaps, rolling_std

# Hourly variables of the weather feed, and those that are imputed.
HOURLY_VARIABLES = (
    "temperature_2m", "relative_humidity_2m", "dewpoint_2m", "apparent_temperature",
    "precipitation", "rain", "snowfall", "pressure_msl", "surface_pressure", "cloud_cover",
    "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m",
)
KEY_VARIABLES = (
    "temperature_2m", "relative_humidity_2m", "dewpoint_2m", "precipitation", "wind_speed_10m",
)

# Fixed value: lowest bucket limit of the price study (the load study uses -10).
PRICE_STUDY_COLD = -5


def clean_weather(
    raw: DataFrame,
    values: Sequence[str] = KEY_VARIABLES,
    keys: Sequence[str] = ("station_id",),
    newest_by: Sequence[str] | None = None,
    min_periods: int | None = None,
) -> DataFrame:
    """One row per station hour, gaps filled, remaining gaps and impossible rows dropped."""
    per_hour = [*keys, "timestamp"]
    unique = latest_per_key(raw, per_hour, newest_by or values)
    filled = fill_gaps(unique, keys, "timestamp", values, min_periods=min_periods)
    flags = weather_flags("temperature_2m", "dewpoint_2m", "wind_speed_10m", "relative_humidity_2m")
    flagged = filled.dropna(subset=list(values)).withColumns(flags)
    errors = [f for f in flags if f != "excessive_wind_speed_flag"]
    return drop_flagged(flagged, errors).drop(*flags)


def weather_features(
    weather: DataFrame, keys: Sequence[str] = (), extreme_cold: float = PRICE_STUDY_COLD, to_market: bool = True
) -> DataFrame:
    """Hourly features from ``start_time`` (UTC), ``Temperature`` and ``WindSpeed``.

    Times move to the market's wall clock. The repeated hour of the autumn change keeps its
    first instant. Volatility is the deviation over six rows.
    """
    series = list(keys) or ["_all"]
    rows = weather if keys else weather.withColumn("_all", F.lit(1))
    if to_market:
        utc = rows.withColumn("_utc", F.col("start_time"))
        local = utc.withColumn("start_time", utc_to_market(F.col("_utc")))
        first = [F.min_by(c, "_utc").alias(c) for c in ("Temperature", "WindSpeed")]
        rows = local.groupBy(*series, "start_time").agg(*first)
    rolled = rolling_std(rows, series, "start_time", "WindSpeed", "WindSpeedVolatility6h")
    bucket = temperature_bucket(F.col("Temperature"), extreme_cold)
    return rolled.withColumn("TemperatureBucket", bucket).drop("_all")


def climate_shift(
    df: DataFrame, ts: str, value: str, split_year: int, labels: tuple[str, str], first: int, last: int
) -> DataFrame:
    """Winter moments of ``value`` before and after ``split_year`` (inclusive).

    Skewness is bias-corrected, kurtosis is the population one.
    """
    return winter_periods(df, ts, split_year, labels, first, last).groupBy("period").agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        sample_skewness(F.col(value)).alias("skewness"),
        F.kurtosis(value).alias("kurtosis"),
    )


def winter_periods(
    df: DataFrame, ts: str, split_year: int, labels: tuple[str, str], first: int, last: int
) -> DataFrame:
    """Winter rows of a year range with their period label."""
    year = F.year(ts)
    label: Column = F.when(year <= split_year, labels[0]).otherwise(labels[1])
    return df.where(is_winter(F.col(ts)) & year.between(first, last)).withColumn("period", label)
