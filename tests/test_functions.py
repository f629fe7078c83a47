"""Labels, calendar parts and numeric columns."""

import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gridlens.functions import labels, numbers, timeparts
from gridlens.operators.rights import class_hours

REGIME_CASES = [
    (50.0, 200.0, "Extreme Event"),
    (90.0, 40.0, "False Scarcity"),
    (90.0, 95.0, "Anticipated Scarcity"),
    (85.0, 130.0, "Unanticipated Scarcity"),
    (3.0, 20.0, "Over-Generation"),
    (55.0, 30.0, "Moderate Stress"),
    (30.0, 48.0, "Moderate Stress"),
    (80.0, 80.0, "Moderate Stress"),
    (30.0, 35.0, "Normal Operations"),
    (None, 60.0, "Moderate Stress"),
    (100.0, None, "Normal Operations"),
    (None, None, "Normal Operations"),
]


@pytest.mark.parametrize("missing", [None, math.nan])
def test_regimes(spark, missing):
    rows = [(missing if a is None else a, missing if b is None else b, c) for a, b, c in REGIME_CASES]
    df = spark.createDataFrame(rows, "da double, rt double, expected string")
    clean = [numbers.no_nan(F.col(c)) for c in ("da", "rt")]
    out = df.select("expected", labels.price_regime(*clean).alias("regime")).collect()
    assert [r.regime for r in out] == [r.expected for r in out]


def test_temperature_buckets(spark):
    temps = [-10.0, -9.9, -5.0, 10.0, 10.1, 32.0, 50.0, 70.0, 85.0, 85.1, None]
    df = spark.createDataFrame([(t,) for t in temps], "t double")
    out = df.select(
        labels.temperature_bucket(F.col("t")).alias("load"),
        labels.temperature_bucket(F.col("t"), -5).alias("price"),
    ).collect()
    expected = ["Extreme Cold", "Very Cold", "Very Cold", "Very Cold", "Cold", "Cold", "Cool", "Mild",
                "Hot", "Extreme Hot", None]
    assert [r.load for r in out] == expected
    assert [r.price for r in out][:4] == ["Extreme Cold"] * 3 + ["Very Cold"]
    assert out[-1].price is None


def test_labels_and_order(spark):
    df = spark.createDataFrame([("Mild", True), ("other", False), ("Extreme Hot", None)], "b string, u boolean")
    rows = df.select(
        labels.bucket_label(F.col("b")).alias("label"), labels.bucket_rank(F.col("b")).alias("rank"),
        labels.direction_label(F.col("u")).alias("direction"),
    ).collect()
    assert [r.label for r in rows] == ["Mild (50°F to 70°F)", "other", "Extreme Hot (>85°F)"]
    assert [r.rank for r in rows] == [5, None, 7]
    assert [r.direction for r in rows] == ["Under Forecast", "Over Forecast", None]


def _calendar(spark, first, last):
    span = spark.createDataFrame([(date.fromisoformat(first), date.fromisoformat(last))], "a date, b date")
    return timeparts.hourly_calendar(span, "a", "b")


def test_class_hours_per_season(spark):
    out = class_hours(_calendar(spark, "2014-12-01", "2026-02-28")).collect()
    found = {(r.WinterYear, r.Class): r.ClassHours for r in out}
    expected = {
        2014: (1008, 1152), 2015: (1008, 1176), 2016: (1024, 1136), 2017: (992, 1168), 2018: (992, 1168),
        2019: (1008, 1176), 2020: (992, 1168), 2021: (1024, 1136), 2022: (1024, 1136), 2023: (1008, 1176),
        2024: (1008, 1152), 2025: (1008, 1152),
    }
    assert found == {(y, c): n for y, pair in expected.items() for c, n in zip(("Peak", "Off-peak"), pair)}


def test_weekday_base_option_moves_the_weekend(spark):
    hours = _calendar(spark, "2025-12-01", "2026-02-28")
    ts = F.col("start_time")
    differs = timeparts.market_class(ts) != timeparts.market_class(ts, iso_weekday_compat=True)
    assert hours.where(differs).count() == 400
    assert hours.count() == 2160


def test_market_zone_follows_daylight_saving(spark):
    df = spark.createDataFrame(
        [(datetime(2026, 1, 21, 5),), (datetime(2026, 7, 21, 5),)], "ts timestamp_ntz"
    )
    out = df.select(timeparts.utc_to_market(F.col("ts")).alias("local")).collect()
    assert [r.local for r in out] == [datetime(2026, 1, 21, 0), datetime(2026, 7, 21, 1)]


def test_dates(spark):
    df = spark.createDataFrame([(date(2024, 2, 29), 24)], "d date, h int")
    row = df.select(
        timeparts.add_years(F.col("d"), -3).alias("back"),
        timeparts.hour_ending_start(F.col("d"), F.col("h")).alias("start"),
        timeparts.winter_season(F.col("d")).alias("season"),
        timeparts.iso_weekday(F.col("d")).alias("weekday"),
    ).first()
    assert row.back == date(2021, 2, 28)
    assert row.start == datetime(2024, 2, 29, 23)
    assert (row.season, row.weekday) == (2023, 4)


def test_windows():
    assert timeparts.winter_window(2020, date(2026, 1, 1)) == (date(2020, 12, 1), date(2021, 3, 1))
    assert timeparts.winter_window(2025, date(2026, 1, 10)) == (date(2025, 12, 1), date(2026, 1, 10))
    assert timeparts.lookback_window(11, date(2026, 1, 12)) == (date(2026, 1, 1), date(2026, 1, 12))


def test_malformed_time_is_null(spark):
    df = spark.createDataFrame([("2026-01-21T05:00:00",), ("soon",)], "t string")
    out = df.select(timeparts.parse_wall_clock(F.col("t")).alias("ts")).collect()
    assert [r.ts for r in out] == [datetime(2026, 1, 21, 5), None]


SAMPLE = [1.0, 2.0, 2.5, 4.0, 9.0, -30.0, 5.5, 7.0]


def test_moments(spark):
    df = spark.createDataFrame([(x,) for x in SAMPLE], "x double")
    row = df.agg(
        numbers.sample_skewness(F.col("x")).alias("skew"), numbers.sample_kurtosis(F.col("x")).alias("kurt"),
        F.skewness("x").alias("skew_pop"), F.kurtosis("x").alias("kurt_pop"),
        F.stddev_pop("x").alias("sd_pop"), F.stddev_samp("x").alias("sd"),
    ).first()
    assert row.skew == pytest.approx(-2.565897699574176)
    assert row.kurt == pytest.approx(6.93755750248363)
    assert row.skew_pop == pytest.approx(-2.057295017425282)
    assert row.kurt_pop == pytest.approx(2.63693214403982)
    assert row.sd_pop == pytest.approx(11.658553726770744)
    assert row.sd == pytest.approx(12.46351819167789)


def test_moments_of_one_row_are_null(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    row = df.agg(
        numbers.sample_skewness(F.col("x")).alias("a"), numbers.sample_kurtosis(F.col("x")).alias("b"),
        F.stddev_samp("x").alias("c"), numbers.correlation(F.col("x"), F.col("y")).alias("d"),
    ).first()
    assert list(row) == [None, None, None, None]


def test_correlation_skips_incomplete_pairs(spark):
    rows = [(1.0, 2.0), (2.0, 4.5), (3.0, 5.0), (None, 9.0), (50.0, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = df.agg(numbers.correlation(F.col("x"), F.col("y")).alias("r")).first().r
    assert got == pytest.approx(0.9332565252573828)


def test_order_slice_never_decreases(spark):
    rng = random.Random(5)
    values = [0.0, 5e-324, -5e-324, 1e300, -1e300]
    values += [s * 2.0**k * f for k in range(-60, 60) for s in (1, -1) for f in (1.0, 1 - 2**-53, 1 + 2**-52)]
    values += [rng.gauss(0, 10 ** rng.randint(-3, 9)) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in sorted(values)], "v double")
    low, high = F.lit(min(values)), F.lit(max(values))
    out = df.select("v", numbers.order_slice(F.col("v"), low, high, 4096).alias("s")).collect()
    slices = [r.s for r in sorted(out, key=lambda r: r.v)]
    assert slices == sorted(slices)


def test_order_slice_separates_values_beside_an_outlier(spark):
    values = [float(i) for i in range(-500, 500)] + [1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    s = numbers.order_slice(F.col("v"), F.lit(-500.0), F.lit(1e12), 4096)
    assert df.groupBy(s.alias("s")).count().agg(F.max("count")).first()[0] <= 2


def test_wall_clocks_do_not_pass_through_the_session_zone(spark):
    from pyspark.sql import functions as F

    from gridlens.functions.timeparts import ISO_MINUTES, day_floor, hour_floor, parse_wall_clock

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([("2024-03-10T02:30:00", "2024-03-10T02:00"), ("10 March", "2024-3-10")], "a string, b string")
        ts = parse_wall_clock(F.col("a"))
        got = rows.select(
            *[x.cast("string") for x in (ts, hour_floor(ts), day_floor(ts), parse_wall_clock(F.col("b"), ISO_MINUTES))]
        ).collect()
        assert tuple(got[0]) == ("2024-03-10 02:30:00", "2024-03-10 02:00:00", "2024-03-10 00:00:00", "2024-03-10 02:00:00")
        assert tuple(got[1]) == (None, None, None, None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
