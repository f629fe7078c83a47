"""Queries over load reports, forecast errors and weather."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.labels import temperature_bucket
from gridlens.operators import load as loads
from gridlens.operators.distribution import box_summary, equal_width_histogram
from gridlens.operators.quality import completeness, null_counts
from gridlens.operators.series import fill_gaps, forward_fill
from gridlens.operators.weather import (
    KEY_VARIABLES,
    clean_weather,
    climate_shift,
    weather_features,
    winter_periods,
)
from gridlens.plans.bindings import (
    event_load,
    event_station,
    event_weather,
    season_prices,
    season_weather,
    sql,
    table,
)
from gridlens.plans.registry import bin_sql, query, r, rounded
from gridlens.session import scratch_dir, stage
from gridlens.sinks.tables import write_csv
from gridlens.sources.tables import read_load_report

ZONE_OF_FLAG = {"A": "LRZ1 North", "N": "LRZ2_7 East", "R": "MISO"}
PERIOD_SPLIT, PERIODS, FIRST_YEAR, LAST_YEAR = 1998, ("1995-1998", "1999-2001"), 1995, 2001


def load_report(spark, sf_dir) -> DataFrame:
    """Line items as a load report: ship day, hour ending, zone, forecast and actual."""
    zone = F.when(F.col("l_returnflag") == "A", ZONE_OF_FLAG["A"])
    zone = zone.when(F.col("l_returnflag") == "N", ZONE_OF_FLAG["N"]).otherwise(ZONE_OF_FLAG["R"])
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("MarketDay"),
        F.col("l_linenumber").alias("HourEnding"),
        zone.alias(loads.ZONE),
        (F.col("l_quantity") * 10).alias(loads.FORECAST),
        F.when(F.col("l_discount") > 0, F.col("l_quantity") * 10 + 5).alias(loads.ACTUAL),
    )


def _wide_sql(value: str, extra: str = "") -> str:
    """Pivot of one measure; loads are whole numbers, so sums are exact."""
    zones = {"A": "Lrz1", "N": "Lrz2_7", "R": "Miso"}
    columns = []
    for name in loads.ZONES.values():
        flag = next((f for f, z in zones.items() if z == name), None)
        columns.append(
            f"avg({value}) FILTER (WHERE l_returnflag = '{flag}') AS {name}" if flag else f"NULL::DOUBLE AS {name}"
        )
    rounded_columns = ", ".join(
        f"{r(c.split(' AS ')[0])} AS {c.split(' AS ')[1]}" for c in columns
    )
    return f"""SELECT l_shipdate + to_hours(l_linenumber - 1) AS Datetime, {rounded_columns}{extra}
 FROM lineitem WHERE {value} IS NOT NULL GROUP BY l_shipdate, l_linenumber"""


_ACTUAL = "(CASE WHEN l_discount > 0 THEN l_quantity * 10 + 5 END)"
_FORECAST = "(l_quantity * 10)"


@query(
    "load_report_scan",
    _wide_sql(_ACTUAL, ", 'actual' AS load_type") + " UNION ALL " + _wide_sql(_FORECAST, ", 'forecast'"),
)
def load_report_scan(spark, sf_dir):
    """Report files with preamble and repeated headers to actual and forecast tables."""
    path = scratch_dir(spark, "load")
    report = load_report(spark, sf_dir)
    text = report.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in report.columns])
    preamble = spark.range(5).select(
        F.lit("Regional report").alias("MarketDay"),
        *[F.lit(None).cast("string").alias(c) for c in report.columns[1:]],
    )
    write_csv(text.unionByName(preamble), path)
    actual, forecast = loads.load_tables(read_load_report(spark, path))
    return rounded(
        actual.withColumn("load_type", F.lit("actual")).unionByName(
            forecast.withColumn("load_type", F.lit("forecast"))
        )
    )


@query("load_pivot", _wide_sql(_FORECAST))
def load_pivot(spark, sf_dir):
    """Mean load by hour with one column per zone."""
    return rounded(loads.load_wide(loads.load_long(load_report(spark, sf_dir), "forecast")))


@query(
    "load_prepare",
    _wide_sql("(CASE WHEN l_discount > 0 THEN l_quantity * 10 + 5 ELSE l_quantity * 10 END)").replace(
        "WHERE", "WHERE l_shipdate BETWEEN '1996-01-01' AND '1999-12-31' AND"
    ),
)
def load_prepare(spark, sf_dir):
    """Filled actual load of four years by hour and zone."""
    report = load_report(spark, sf_dir)
    return rounded(loads.prepare_load(report, "actual", date(1996, 1, 1), date(1999, 12, 31), fill_missing=True))


@query(
    "load_unpivot",
    f"""SELECT Datetime, Zone, LoadForecast FROM ({_wide_sql(_FORECAST)})
 UNPIVOT INCLUDE NULLS (LoadForecast FOR Zone IN (Lrz1, Lrz2_7, Miso))""",
)
def load_unpivot(spark, sf_dir):
    """Zone columns back to rows, missing loads kept."""
    wide = loads.load_wide(loads.load_long(load_report(spark, sf_dir), "forecast"))
    return rounded(loads.unpivot_zones(wide, ["Lrz1", "Lrz2_7", "Miso"], "LoadForecast"))


@query(
    "fill_actual",
    f"""SELECT l_returnflag, count(*) AS rows, count(*) FILTER (WHERE l_discount > 0) AS reported,
 {r('sum(coalesce(' + _ACTUAL + ', l_quantity * 10))')} AS load FROM lineitem GROUP BY 1""",
)
def fill_actual(spark, sf_dir):
    """Actual load with gaps filled from the forecast, by zone."""
    report = load_report(spark, sf_dir).withColumn("reported", F.col(f"`{loads.ACTUAL}`").isNotNull())
    flag = F.when(F.col(f"`{loads.ZONE}`") == ZONE_OF_FLAG["A"], "A")
    flag = flag.when(F.col(f"`{loads.ZONE}`") == ZONE_OF_FLAG["N"], "N").otherwise("R")
    return rounded(
        loads.fill_actual(report).groupBy(flag.alias("l_returnflag")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if("reported").alias("reported"),
            F.sum(f"`{loads.ACTUAL}`").alias("load"),
        )
    )


@query(
    "completeness",
    sql("season_prices", """SELECT node, ((date_diff('day', min(start_time)::DATE, max(start_time)::DATE) + 1) * 24)::BIGINT
 AS rows_expected, count(*) AS rows_found,
 ((date_diff('day', min(start_time)::DATE, max(start_time)::DATE) + 1) * 24 - count(*))::BIGINT AS rows_missing
 FROM season_prices GROUP BY node"""),
)
def completeness_query(spark, sf_dir):
    """Hours expected and found per node."""
    hours = season_prices(spark, sf_dir)
    return completeness(hours, "start_time", F.min("start_time"), F.max("start_time"), ["node"])


def load_weather(spark, sf_dir) -> DataFrame:
    """Actual, forecast and weather joined, buckets of the load study."""
    rows = event_load(spark, sf_dir)
    actual = rows.select("Datetime", F.lit("Lrz1").alias("Zone"), "LoadActual").dropna()
    forecast = rows.select("Datetime", F.lit("Lrz1").alias("Zone"), "LoadForecast").dropna()
    weather = event_weather(spark, sf_dir).withColumnRenamed("start_time", "Datetime")
    bucket = temperature_bucket(F.col("Temperature"), -10)
    return loads.join_load_weather(actual, forecast, weather.withColumn("TemperatureBucket", bucket))


def load_errors(spark, sf_dir) -> DataFrame:
    return loads.forecast_errors(load_weather(spark, sf_dir))


@query(
    "forecast_errors",
    sql("errors", f"""SELECT Datetime, LoadActual, LoadForecast, {r('Temperature')} AS Temperature, TemperatureBucket,
 {r('Error')} AS Error, IsUnderForecast, {r('AbsoluteError')} AS AbsoluteError,
 {r('AbsolutePercentageError')} AS AbsolutePercentageError FROM errors"""),
)
def forecast_errors(spark, sf_dir):
    """Error measures on the full join of actual, forecast and weather."""
    return rounded(
        load_errors(spark, sf_dir).select(
            "Datetime", "LoadActual", "LoadForecast", "Temperature", "TemperatureBucket",
            "Error", "IsUnderForecast", "AbsoluteError", "AbsolutePercentageError",
        )
    )


_RANK_SQL = """CASE TemperatureBucket WHEN 'Extreme Cold' THEN 1 WHEN 'Very Cold' THEN 2 WHEN 'Cold' THEN 3
 WHEN 'Cool' THEN 4 WHEN 'Mild' THEN 5 WHEN 'Hot' THEN 6 ELSE 7 END::INTEGER AS BucketOrder,
 CASE TemperatureBucket WHEN 'Extreme Cold' THEN 'Extreme Cold (≤ -10°F)'
 WHEN 'Very Cold' THEN 'Very Cold (-10°F to 10°F)' WHEN 'Cold' THEN 'Cold (10°F to 32°F)'
 WHEN 'Cool' THEN 'Cool (32°F to 50°F)' WHEN 'Mild' THEN 'Mild (50°F to 70°F)'
 WHEN 'Hot' THEN 'Hot (70°F to 85°F)' ELSE 'Extreme Hot (>85°F)' END AS TemperatureBucketLabel"""


@query(
    "error_by_bucket",
    sql("complete", f"""SELECT TemperatureBucket, {_RANK_SQL},
 {r('avg(AbsolutePercentageError)')} AS MeanAbsolutePercentageError, {r('avg(AbsoluteError)')} AS MeanAbsoluteError,
 {r('avg(IsUnderForecast::INTEGER)')} AS ProportionUnderForecast,
 count(*) FILTER (WHERE IsUnderForecast) AS UnderForecastCount,
 count(*) FILTER (WHERE NOT IsUnderForecast) AS OverForecastCount, count(*) AS Count,
 'n=' || count(*) FILTER (WHERE IsUnderForecast) || ' / ' || count(*) AS CountLabel
 FROM complete GROUP BY TemperatureBucket"""),
)
def error_by_bucket(spark, sf_dir):
    """Forecast error by temperature bucket."""
    return rounded(loads.error_by_bucket(load_errors(spark, sf_dir)))


@query(
    "error_by_bucket_direction",
    sql("complete", f"""SELECT TemperatureBucket, IsUnderForecast, {_RANK_SQL},
 {r('avg(AbsolutePercentageError)')} AS MeanAbsolutePercentageError, {r('avg(AbsoluteError)')} AS MeanAbsoluteError,
 count(*) AS Count, CASE WHEN IsUnderForecast THEN 'Under Forecast' ELSE 'Over Forecast' END AS ForecastDirection
 FROM complete GROUP BY TemperatureBucket, IsUnderForecast"""),
)
def error_by_bucket_direction(spark, sf_dir):
    """Forecast error by temperature bucket and direction."""
    return rounded(loads.error_by_bucket_direction(load_errors(spark, sf_dir)))


@query(
    "count_label",
    sql("complete", """SELECT TemperatureBucket, 'n=' || count(*) FILTER (WHERE IsUnderForecast) || ' / ' || count(*)
 AS CountLabel FROM complete GROUP BY TemperatureBucket"""),
)
def count_label(spark, sf_dir):
    """Text label with the exact under-forecast count."""
    return loads.error_by_bucket(load_errors(spark, sf_dir)).select("TemperatureBucket", "CountLabel")


@query(
    "error_boxplot",
    sql("complete", f"""SELECT TemperatureBucket, IsUnderForecast, {r('min(AbsolutePercentageError)')} AS min,
 {r('quantile_cont(AbsolutePercentageError, 0.25)')} AS q1, {r('median(AbsolutePercentageError)')} AS median,
 {r('quantile_cont(AbsolutePercentageError, 0.75)')} AS q3, {r('max(AbsolutePercentageError)')} AS max,
 count(AbsolutePercentageError) AS count FROM complete GROUP BY TemperatureBucket, IsUnderForecast"""),
)
def error_boxplot(spark, sf_dir):
    """Five-number summary of the percent error."""
    rows = loads.complete_cases(load_errors(spark, sf_dir))
    columns = ["TemperatureBucket", "IsUnderForecast", "AbsolutePercentageError"]
    return rounded(box_summary(stage(rows.select(*columns), "errors"), ["TemperatureBucket", "IsUnderForecast"], "AbsolutePercentageError"))


@query(
    "missing_load_by_day",
    sql("errors", """SELECT date_trunc('day', Datetime)::TIMESTAMP AS Date, count(*) AS TotalCount,
 count(*) - count(LoadForecast) AS NullForecastLoadCount, count(*) - count(LoadActual) AS NullActualLoadCount
 FROM errors WHERE LoadActual IS NULL OR LoadForecast IS NULL GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 20"""),
)
def missing_load_by_day(spark, sf_dir):
    """Days with the most missing load (top 20)."""
    return loads.missing_load_by_day(load_weather(spark, sf_dir), 20)


@query(
    "weather_features",
    sql("features", f"""SELECT start_time, Temperature, WindSpeed, {r('WindSpeedVolatility6h')} AS WindSpeedVolatility6h,
 TemperatureBucket FROM features"""),
)
def weather_features_query(spark, sf_dir):
    """Market-time weather with wind volatility and temperature bucket."""
    return rounded(weather_features(stage(event_weather(spark, sf_dir), "weather")), keep=("Temperature", "WindSpeed"))


def _station_rows(spark, sf_dir) -> DataFrame:
    """Stored hourly rows of the station."""
    return stage(event_station(spark, sf_dir).withColumn("station_id", F.lit("S")), "station")


@query(
    "ffill_limit",
    sql("station", """SELECT timestamp, last_value(temperature_2m IGNORE NULLS) OVER w AS temperature_2m,
 last_value(wind_speed_10m IGNORE NULLS) OVER w AS wind_speed_10m FROM station
 WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""),
)
def ffill_limit(spark, sf_dir):
    """Forward fill over at most six rows."""
    rows = _station_rows(spark, sf_dir).select(
        "station_id", "timestamp", "temperature_2m", "wind_speed_10m"
    )
    filled = forward_fill(rows, ["station_id"], "timestamp", ["temperature_2m", "wind_speed_10m"])
    return filled.drop("station_id")


@query(
    "rolling_fill",
    sql("station", f"""SELECT timestamp, {r('''coalesce(last_value(temperature_2m IGNORE NULLS) OVER (ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
 CASE WHEN count(temperature_2m) OVER w >= 6 THEN avg(temperature_2m) OVER w END)''')} AS temperature_2m FROM station
 WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""),
)
def rolling_fill(spark, sf_dir):
    """Forward fill over two rows, then the 24-row mean where six values exist."""
    rows = _station_rows(spark, sf_dir).select("station_id", "timestamp", "temperature_2m")
    filled = fill_gaps(rows, ["station_id"], "timestamp", ["temperature_2m"], limit=2, min_periods=6)
    return rounded(filled.drop("station_id"))


def _fill_sql(v: str) -> str:
    return f"""coalesce(last_value({v} IGNORE NULLS) OVER (ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
 CASE WHEN count({v}) OVER w = 24 THEN avg({v}) OVER w END) AS {v}"""


_CLEAN_SQL = f"""SELECT * FROM (SELECT timestamp, {', '.join(_fill_sql(v) for v in KEY_VARIABLES)} FROM station
 WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
 WHERE {' AND '.join(f'{v} IS NOT NULL' for v in KEY_VARIABLES)} AND NOT (dewpoint_2m > temperature_2m
 OR temperature_2m < -60 OR temperature_2m > 120 OR wind_speed_10m < 0
 OR relative_humidity_2m < 0 OR relative_humidity_2m > 100)"""


@query("weather_clean", sql("station", _CLEAN_SQL))
def weather_clean(spark, sf_dir):
    """Deduplicated, filled and bounded weather rows."""
    return clean_weather(_station_rows(spark, sf_dir)).drop("station_id")


@query(
    "weather_null_report",
    sql("station", f"""SELECT 'after' AS stage, count(*) AS total_count,
 {', '.join(f'count(*) - count({v}) AS null_{v}' for v in KEY_VARIABLES)}
 FROM (SELECT {', '.join(_fill_sql(v) for v in KEY_VARIABLES)} FROM station
 WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
 UNION ALL SELECT 'before', count(*), {', '.join(f'count(*) - count({v})' for v in KEY_VARIABLES)} FROM station"""),
)
def weather_null_report(spark, sf_dir):
    """Missing values per variable before and after imputation."""
    raw = _station_rows(spark, sf_dir)
    filled = fill_gaps(raw, ["station_id"], "timestamp", list(KEY_VARIABLES))
    stages = raw.withColumn("stage", F.lit("before")).unionByName(filled.withColumn("stage", F.lit("after")))
    return null_counts(stages, list(KEY_VARIABLES), ["stage"])


_PERIOD_SQL = f"""SELECT CASE WHEN year(start_time) <= {PERIOD_SPLIT} THEN '{PERIODS[0]}' ELSE '{PERIODS[1]}' END AS period,
 Temperature AS x FROM season_weather WHERE month(start_time) IN (12, 1, 2)
 AND year(start_time) BETWEEN {FIRST_YEAR} AND {LAST_YEAR}"""


@query(
    "climate_shift",
    sql("season_weather", f"""SELECT period, count(x) AS n, {r('avg(x)', 4)} AS mean, {r('stddev_samp(x)', 4)} AS sd,
 {r('skewness(x)', 4)} AS skewness, {r('kurtosis_pop(x)', 4)} AS kurtosis FROM ({_PERIOD_SQL}) GROUP BY period"""),
)
def climate_shift_query(spark, sf_dir):
    """Winter temperature moments of two periods."""
    hours = season_weather(spark, sf_dir)
    return rounded(
        climate_shift(hours, "start_time", "Temperature", PERIOD_SPLIT, PERIODS, FIRST_YEAR, LAST_YEAR), 4
    )


@query(
    "climate_histogram",
    sql("season_weather", f"""SELECT period, bin, {r('lo + bin * w')} AS bin_left, {r('lo + bin * w + w')} AS bin_right,
 {r('lo + bin * w + w / 2')} AS bin_center, count FROM (SELECT period, bin, any_value(lo) AS lo,
 any_value((hi - lo) / 50) AS w, count(*) AS count FROM (SELECT *,
 {bin_sql('x', 'lo', 'hi', 50)} AS bin FROM (SELECT *, min(x) OVER (PARTITION BY period) AS lo,
 max(x) OVER (PARTITION BY period) AS hi FROM ({_PERIOD_SQL}))) GROUP BY period, bin)"""),
)
def climate_histogram(spark, sf_dir):
    """Temperature histogram of each period."""
    hours = winter_periods(
        season_weather(spark, sf_dir), "start_time", PERIOD_SPLIT, PERIODS, FIRST_YEAR, LAST_YEAR
    )
    return rounded(equal_width_histogram(stage(hours.select("period", "Temperature"), "winters"), "Temperature", 50, ["period"]))
