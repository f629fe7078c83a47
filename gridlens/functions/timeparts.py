"""Calendar parts of wall-clock hours (``timestamp_ntz``)."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Winter months, classes, holidays (month, day), peak hours and market zone.
WINTER_MONTHS = (12, 1, 2)
PEAK, OFF_PEAK = "Peak", "Off-peak"
WINTER_HOLIDAYS = ((12, 25), (1, 1))
PEAK_FIRST_HOUR, PEAK_LAST_HOUR = 6, 21
MARKET_ZONE = "America/New_York"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
ISO_MINUTES = "yyyy-MM-dd'T'HH:mm"


def parse_wall_clock(text: Column, fmt: str = ISO_SECONDS) -> Column:
    """ISO text to wall clock, whatever the session's zone; NULL when the text does not fit."""
    shape = "^" + re.sub("[A-Za-z]", r"\\d", fmt.replace("'T'", "~")).replace("~", "T") + "$"
    return F.when(text.rlike(shape), text.try_cast("timestamp_ntz"))


def hour_floor(ts: Column) -> Column:
    """The wall-clock hour; put together from its parts, as truncation would go through the session's zone."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def day_floor(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def with_partition_parts(df: DataFrame, ts: str) -> DataFrame:
    """Add the integer ``year``, ``month`` and ``day`` partition columns."""
    return df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)})


def iso_weekday(ts: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(ts) + 1


def is_winter(ts: Column) -> Column:
    return F.month(ts).isin(*WINTER_MONTHS)


def winter_season(ts: Column) -> Column:
    """Year of the season's December: January and February count to the year before."""
    return F.year(ts) - F.when(F.month(ts) <= 2, 1).otherwise(0)


def market_class(ts: Column, iso_weekday_compat: bool = False) -> Column:
    """Peak or off-peak class of an hour.

    ``iso_weekday_compat`` tests weekday numbers 5 and 6 on the Monday-1 base, which makes
    Friday and Saturday off-peak.
    """
    day_number = iso_weekday(ts) if iso_weekday_compat else F.weekday(ts)
    holiday = F.lit(False)
    for month, day in WINTER_HOLIDAYS:
        holiday = holiday | ((F.month(ts) == month) & (F.dayofmonth(ts) == day))
    off = holiday | day_number.isin(5, 6)
    peak_hour = F.hour(ts).between(PEAK_FIRST_HOUR, PEAK_LAST_HOUR)
    return F.when(~off & peak_hour, PEAK).when(ts.isNotNull(), OFF_PEAK)


def hour_ending_start(day: Column, hour_ending: Column) -> Column:
    """First instant of hour-ending 1..24 on a day."""
    start = day.cast("date").cast("timestamp_ntz")
    zero = F.lit(0)
    return start + F.make_dt_interval(zero, hour_ending.cast("int") - 1, zero, F.lit(0.0))


def utc_to_market(ts: Column, zone: str = MARKET_ZONE) -> Column:
    """UTC wall clock to the market's wall clock, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def add_years(day: Column, years: int) -> Column:
    """Same day ``years`` later; 29 February falls back to 28 February."""
    return F.add_months(day, 12 * years)


def winter_window(december_year: int, today: date) -> tuple[date, date]:
    """First day and exclusive end of a winter season, never reaching into ``today``."""
    return date(december_year, 12, 1), min(date(december_year + 1, 3, 1), today)


def lookback_window(days: int, today: date) -> tuple[date, date]:
    """First day and exclusive end of the last ``days`` whole days before ``today``."""
    return today - timedelta(days=days), today


def in_window(ts: Column, start, end) -> Column:
    """Half-open time window ``[start, end)``."""
    return (ts >= F.lit(start)) & (ts < F.lit(end))


def prune_to_window(df: DataFrame, ts: str, start: date, end: date) -> DataFrame:
    """Half-open window that also bounds the ``year``/``month`` partition columns."""
    month_no = F.col("year") * 12 + F.col("month")
    last = end - timedelta(days=1)
    bounds = F.col("year").between(start.year, last.year) & month_no.between(
        start.year * 12 + start.month, last.year * 12 + last.month
    )
    return df.where(bounds & in_window(F.col(ts), start, end))


def hourly_calendar(span: DataFrame, first: str, last: str, out: str = "start_time") -> DataFrame:
    """Every hour from day ``first`` to day ``last`` (inclusive) of each row of ``span``.

    Days are exploded before hours so that no array holds more than one day per element.
    """
    others = [c for c in span.columns if c not in (first, last)]
    days = span.select(
        *others, F.explode(F.sequence(F.col(first).cast("date"), F.col(last).cast("date"))).alias("_d")
    )
    hours = days.select("*", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("_h"))
    return hours.select(*others, hour_ending_start(F.col("_d"), F.col("_h")).alias(out))
