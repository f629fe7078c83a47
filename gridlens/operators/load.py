"""Load reports and forecast errors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.labels import bucket_label, bucket_rank, direction_label
from gridlens.functions.numbers import ratio, share
from gridlens.functions.timeparts import day_floor, hour_ending_start
from gridlens.operators.quality import any_null

# Report columns and zones.
ACTUAL, FORECAST, ZONE = "ActualLoad (MWh)", "MTLF (MWh)", "LoadResource Zone"
ZONES = {
    "LRZ1": "Lrz1", "LRZ2_7": "Lrz2_7", "LRZ3_5": "Lrz3_5", "LRZ4": "Lrz4",
    "LRZ6": "Lrz6", "LRZ8_9_10": "Lrz8_9_10", "MISO": "Miso",
}
MEASURES = {"actual": ACTUAL, "forecast": FORECAST}


def fill_actual(report: DataFrame) -> DataFrame:
    """Missing actual load takes the forecast."""
    return report.withColumn(ACTUAL, F.coalesce(ACTUAL, FORECAST))


def load_long(report: DataFrame, measure: str) -> DataFrame:
    """(Datetime, zone, load) rows of one measure, rows with a missing value dropped."""
    if measure not in MEASURES:
        raise ValueError("measure must be 'actual' or 'forecast'")
    zone = F.upper(F.split(F.col(ZONE), " ")[0])
    return report.select(
        hour_ending_start(F.col("MarketDay"), F.col("HourEnding")).alias("Datetime"),
        zone.alias("zone"),
        F.col(MEASURES[measure]).alias("load"),
    ).dropna()


def load_wide(long: DataFrame, zones: dict[str, str] = ZONES) -> DataFrame:
    """One row per hour, one column per zone, mean of repeated reports; one aggregation."""
    means = [F.avg(F.when(F.col("zone") == z, F.col("load"))).alias(c) for z, c in zones.items()]
    return long.groupBy("Datetime").agg(*means)


def load_tables(report: DataFrame, zones: dict[str, str] = ZONES) -> tuple[DataFrame, DataFrame]:
    """Actual and forecast hours, kept apart."""
    return load_wide(load_long(report, "actual"), zones), load_wide(load_long(report, "forecast"), zones)


def prepare_load(
    report: DataFrame, measure: str, start: date, end: date, fill_missing: bool = False,
    zones: dict[str, str] = ZONES,
) -> DataFrame:
    """Report lines to hours by zone between two days (inclusive), in time order."""
    lines = fill_actual(report) if fill_missing else report
    days = lines.where(F.col("MarketDay").between(F.lit(start), F.lit(end)))
    return load_wide(load_long(days, measure), zones).orderBy("Datetime")


def unpivot_zones(wide: DataFrame, zones: Sequence[str], value: str) -> DataFrame:
    return wide.select("Datetime", *zones).unpivot("Datetime", list(zones), "Zone", value)


def join_load_weather(actual: DataFrame, forecast: DataFrame, weather: DataFrame) -> DataFrame:
    """Actual and forecast by (Datetime, Zone), then weather by Datetime, all rows kept.

    The three sides are stacked and put together by one exchange on Datetime: an aggregate per zone of
    an hour, then the hour's weather beside each of its zones. Keys are unique on each side or equal; of
    different rows of a key the greatest values stay. NULL keys match NULL keys.
    """
    own = [c for c in weather.columns if c != "Datetime"]
    sides = [
        df.select(
            "Datetime", F.col("Zone") if "Zone" in df.columns else F.lit(None).cast("string").alias("Zone"),
            *[F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double").alias(c) for c in ("LoadActual", "LoadForecast")],
            F.struct(*own).alias("_weather") if df is weather else F.lit(None).cast(weather.select(F.struct(*own)).schema[0].dataType).alias("_weather"),
            F.lit(df is weather).alias("_sky"),
        )
        for df in (actual, forecast, weather)
    ]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2]).repartition("Datetime").groupBy("Datetime", "Zone", "_sky").agg(
        *[F.max(c).alias(c) for c in ("LoadActual", "LoadForecast", "_weather")]
    )
    hour = Window.partitionBy("Datetime")
    placed = rows.withColumns({"_weather": F.max("_weather").over(hour), "_zones": F.count_if(~F.col("_sky")).over(hour)})
    return placed.where(~F.col("_sky") | (F.col("_zones") == 0)).select(
        "Datetime", "Zone", "LoadActual", "LoadForecast", *[F.col("_weather")[c].alias(c) for c in own]
    )


def forecast_errors(df: DataFrame) -> DataFrame:
    """Error (forecast minus actual), under-forecast flag, absolute and percent error."""
    error = F.col("LoadForecast") - F.col("LoadActual")
    return df.withColumns(
        {
            "Error": error,
            "IsUnderForecast": F.col("LoadForecast") < F.col("LoadActual"),
            "AbsoluteError": F.abs(error),
            "AbsolutePercentageError": ratio(F.abs(error), F.col("LoadActual")) * 100,
        }
    )


def complete_cases(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["LoadActual", "LoadForecast", "Temperature"])


def error_by_bucket(errors: DataFrame) -> DataFrame:
    """Mean errors and under-forecast share per temperature bucket."""
    under = F.col("IsUnderForecast")
    grouped = complete_cases(errors).groupBy("TemperatureBucket").agg(
        F.avg("AbsolutePercentageError").alias("MeanAbsolutePercentageError"),
        F.avg("AbsoluteError").alias("MeanAbsoluteError"),
        share(under).alias("ProportionUnderForecast"),
        F.count_if(under).alias("UnderForecastCount"),
        F.count_if(~under).alias("OverForecastCount"),
        F.count(F.lit(1)).alias("Count"),
    )
    return _labelled(grouped).withColumn(
        "CountLabel", F.concat(F.lit("n="), "UnderForecastCount", F.lit(" / "), "Count")
    )


def error_by_bucket_direction(errors: DataFrame) -> DataFrame:
    """Mean errors per temperature bucket and forecast direction."""
    grouped = complete_cases(errors).groupBy("TemperatureBucket", "IsUnderForecast").agg(
        F.avg("AbsolutePercentageError").alias("MeanAbsolutePercentageError"),
        F.avg("AbsoluteError").alias("MeanAbsoluteError"),
        F.count(F.lit(1)).alias("Count"),
    )
    return _labelled(grouped).withColumn("ForecastDirection", direction_label(F.col("IsUnderForecast")))


def _labelled(df: DataFrame) -> DataFrame:
    bucket = F.col("TemperatureBucket")
    return df.withColumns({"BucketOrder": bucket_rank(bucket), "TemperatureBucketLabel": bucket_label(bucket)})


def missing_load_by_day(df: DataFrame, top: int | None = None) -> DataFrame:
    """Days with missing load, most missing actual hours first; with ``top`` only so many."""
    gaps = df.where(any_null(["LoadActual", "LoadForecast"]))
    daily = gaps.groupBy(day_floor(F.col("Datetime")).alias("Date")).agg(
        F.count(F.lit(1)).alias("TotalCount"),
        F.count_if(F.col("LoadForecast").isNull()).alias("NullForecastLoadCount"),
        F.count_if(F.col("LoadActual").isNull()).alias("NullActualLoadCount"),
    )
    ordered = daily.orderBy(F.desc("NullActualLoadCount"), "Date")
    return ordered if top is None else ordered.limit(top)
