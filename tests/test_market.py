"""Prices, load, fuel and weather operators."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridlens.operators import fuel, load, prices, quality, weather

T0 = datetime(2024, 1, 1)


def price_rows(spark, rows):
    return spark.createDataFrame(
        [(n, T0 + timedelta(hours=h), p) for n, h, p in rows], "node string, start_time timestamp_ntz, lmp double"
    )


@pytest.fixture(scope="module")
def dart(spark):
    da = price_rows(spark, [("A", 0, 30.0), ("A", 1, float("nan")), ("A", 2, 50.0), ("B", 0, 90.0)])
    rt = price_rows(spark, [("A", 0, 35.0), ("A", 1, 60.0), ("A", 30, 200.0), ("B", 0, 40.0)])
    return prices.dart_table(da, rt)


def test_full_join_keeps_keys_of_both_sides(dart):
    rows = {(r.node, r.start_time): r for r in dart.collect()}
    assert len(rows) == 5
    only_rt = rows["A", T0 + timedelta(hours=30)]
    assert (only_rt.lmp_da_exante, only_rt.lmp_rt_expost, only_rt.month, only_rt.day_of_week) == (None, 200.0, 1, 2)
    assert rows["A", T0 + timedelta(hours=1)].lmp_da_exante is None
    assert rows["B", T0].lmp_dart_spread == -50.0


def test_missing_by_day(dart):
    out = {r.date: r.missing_count for r in prices.missing_by_day(dart).collect()}
    assert out == {T0: 2, T0 + timedelta(days=1): 1}


def test_regime_shares_and_window(dart):
    rows = prices.with_regime(dart)
    shares = {r.regime: (r["count"], r.share) for r in prices.regime_shares(rows).collect()}
    assert shares == {
        "Normal Operations": (1, 0.2), "Moderate Stress": (2, 0.4), "Extreme Event": (1, 0.2),
        "False Scarcity": (1, 0.2),
    }
    window = prices.event_window(rows, date(2024, 1, 2), date(2024, 1, 3), ["A"]).collect()
    assert [(r.node, r.scarcity) for r in window] == [("A", True)]
    assert prices.event_window(rows, date(2024, 1, 1), date(2024, 1, 2)).count() == 4


def test_durations_stats_and_longest(hours):
    labels = ["Normal Operations"] * 2 + ["Extreme Event"] + ["Normal Operations"] * 2 + ["Extreme Event"]
    durations = prices.with_regime_durations(hours(labels, "regime string"))
    stats = {r.regime: r for r in prices.regime_duration_stats(durations).collect()}
    normal = stats["Normal Operations"]
    assert (normal.avg_duration, normal.max_duration, normal.median_duration) == (1.5, 2, 1.5)
    assert (normal.runs, normal.avg_run_length) == (2, 2.0)
    matrix = prices.duration_matrix(durations).first()
    assert (matrix["Normal Operations"], matrix["Extreme Event"], matrix["Over-Generation"]) == (1.5, 1.0, None)
    longest = prices.longest_runs(durations).collect()
    assert [(r.regime, r.start_time.hour, r.consecutive_regime_hours) for r in longest] == [
        ("Normal Operations", 1, 2), ("Extreme Event", 2, 1)
    ]


def test_forecast_errors_and_buckets(spark):
    rows = [
        (T0, 100.0, 110.0, 20.0, "Cold"), (T0, 100.0, 90.0, 20.0, "Cold"), (T0, 200.0, 190.0, 20.0, "Cold"),
        (T0, 0.0, 5.0, 60.0, "Mild"), (T0, None, 5.0, 60.0, "Mild"), (T0, 10.0, 5.0, None, None),
    ]
    df = spark.createDataFrame(
        rows, "Datetime timestamp_ntz, LoadActual double, LoadForecast double, Temperature double, TemperatureBucket string"
    )
    errors = load.forecast_errors(df)
    buckets = {r.TemperatureBucket: r for r in load.error_by_bucket(errors).collect()}
    cold = buckets["Cold"]
    assert cold.MeanAbsolutePercentageError == pytest.approx(25 / 3)
    assert (cold.UnderForecastCount, cold.OverForecastCount, cold.Count, cold.CountLabel) == (2, 1, 3, "n=2 / 3")
    assert cold.TemperatureBucketLabel == "Cold (10°F to 32°F)"
    assert buckets["Mild"].MeanAbsolutePercentageError is None
    by_direction = load.error_by_bucket_direction(errors).collect()
    assert sum(r.Count for r in by_direction) == sum(r.Count for r in buckets.values())
    assert load.missing_load_by_day(df).first().NullActualLoadCount == 1


def test_under_forecast_count_is_exact(spark):
    flags = spark.range(6470).select(
        F.lit("Cool").alias("TemperatureBucket"), (F.col("id") < 3634).alias("IsUnderForecast"),
        *[F.lit(1.0).alias(c) for c in
          ("LoadActual", "LoadForecast", "Temperature", "AbsoluteError", "AbsolutePercentageError")],
    )
    assert load.error_by_bucket(flags).first().UnderForecastCount == 3634


def test_load_report_steps(spark):
    report = spark.createDataFrame(
        [
            (date(2024, 1, 1), 1, "LRZ1 North", 10.0, 11.0), (date(2024, 1, 1), 1, "LRZ1 North", 20.0, None),
            (date(2024, 1, 1), 24, "lrz2_7 East", 30.0, 31.0), (date(2024, 1, 1), None, "MISO", 1.0, 1.0),
        ],
        f"MarketDay date, HourEnding int, `{load.ZONE}` string, `{load.FORECAST}` double, `{load.ACTUAL}` double",
    )
    actual, forecast = load.load_tables(report)
    first = forecast.orderBy("Datetime").first()
    assert (first.Datetime, first.Lrz1, first.Lrz2_7) == (T0, 15.0, None)
    assert actual.orderBy("Datetime").first().Lrz1 == 11.0
    assert forecast.count() == 2
    filled = [r[load.ACTUAL] for r in load.fill_actual(report).collect()]
    assert filled == [11.0, 20.0, 31.0, 1.0]
    day = (date(2024, 1, 1), date(2024, 1, 1))
    assert load.prepare_load(report, "actual", *day).count() == 2
    assert load.prepare_load(report, "actual", *day, fill_missing=True).first().Lrz1 == 15.5
    assert load.prepare_load(report, "actual", date(2024, 1, 2), date(2024, 1, 3)).count() == 0
    long = load.unpivot_zones(forecast, ["Lrz1", "Lrz2_7"], "LoadForecast")
    assert long.count() == 4
    with pytest.raises(ValueError):
        load.load_long(report, "both")


def test_fuel_compare_and_flags(spark):
    columns = "region string, start_time timestamp_ntz, totalMw double, coal double, gas double, wind double, solar double, nuclear double"
    def mix(winds, gas):
        rows = [("N", T0 + timedelta(hours=i), 100.0, 10.0, g, w, 0.0, 5.0) for i, (w, g) in enumerate(zip(winds, gas))]
        return spark.createDataFrame(rows, columns)

    da = mix([10.0] * 5, [20.0] * 5)
    rt = mix([8.0, 9.0, 1.0, 2.0, 3.0], [20.0, 16.0, 17.0, 30.0, 40.0])
    out = fuel.with_fuel_flags(fuel.fuel_mix_compare(da, rt)).orderBy("start_time").collect()
    assert [r.WindMissFlag for r in out] == [1, 0, 1, 1, 1]
    assert [r.GasMissFlag for r in out] == [0, 1, 0, 0, 0]
    assert [r.LowWindFlag for r in out] == [0, 0, 1, 1, 0]
    assert out[0].SolarMW_PctDiff is None and out[0].WindMW_Diff == -2.0


def test_summaries_by_temperature(spark):
    rows = [("Cold", "Extreme Event", 1, 0, 1, 0, 50.0), ("Cold", "Normal Operations", 0, 0, 1, 0, 150.0),
            (None, "Normal Operations", 1, 1, 1, 1, 1.0)]
    df = spark.createDataFrame(
        rows, "TemperatureBucket string, regime string, LowWindFlag int, LowGasFlag int, WindMissFlag int, GasMissFlag int, w double"
    )
    for f in fuel.MIX:
        df = df.withColumn(f"{f}MW_RT", F.col("w"))
    compat = fuel.regime_by_temperature(df).first()
    assert (compat["Extreme Event"], compat.LowWindFlag, compat.WindMissFlag) == (20.0, 20.0, 40.0)
    pure = fuel.regime_by_temperature(df, flags_in_denominator=False).first()
    assert (pure["Extreme Event"], pure["Normal Operations"], pure.WindMissFlag) == (50.0, 50.0, 100.0)
    mix = fuel.fuel_mix_by_temperature(df).first()
    assert (mix.avg_CoalMW_RT, mix.TotalAvgMW_RT, mix.CoalPct_RT, mix.ScarcityPct) == (100.0, 500.0, 20.0, 50.0)


def test_pct_of_seasonal_average_uses_winter_only(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1), 10.0), (datetime(2024, 2, 1), 30.0), (datetime(2024, 7, 1), 1000.0)],
        "start_time timestamp_ntz, wind double",
    )
    out = fuel.pct_of_seasonal_avg(df, "wind", "pct").orderBy("start_time").collect()
    assert [r.pct for r in out] == [50.0, 150.0, 5000.0]


def test_weather_features_keep_one_row_in_the_repeated_hour(spark):
    rows = [(datetime(2025, 11, 2, 4) + timedelta(hours=i), float(i), float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "start_time timestamp_ntz, Temperature double, WindSpeed double")
    out = weather.weather_features(df).orderBy("start_time").collect()
    assert [(r.start_time.hour, r.Temperature) for r in out] == [(0, 0.0), (1, 1.0), (2, 3.0)]
    assert out[0].WindSpeedVolatility6h is None


def test_weather_cleaning(spark):
    base = dict(temperature_2m=40.0, relative_humidity_2m=50.0, dewpoint_2m=30.0, precipitation=0.0, wind_speed_10m=5.0)
    changes = [{}, {"temperature_2m": None}, {"dewpoint_2m": 99.0}, {"wind_speed_10m": 250.0}, {"relative_humidity_2m": 101.0}]
    rows = []
    for i, change in enumerate(changes):
        values = {**base, **change}
        rows.append(("S", T0 + timedelta(hours=i), *values.values()))
    rows.append(rows[0])
    df = spark.createDataFrame(
        rows, "station_id string, timestamp timestamp_ntz, " + ", ".join(f"{c} double" for c in base)
    )
    out = weather.clean_weather(df).orderBy("timestamp").collect()
    assert [r.timestamp.hour for r in out] == [0, 1, 3]
    assert out[1].temperature_2m == 40.0
    assert out[2].wind_speed_10m == 250.0


def test_climate_shift(spark):
    rows = [(datetime(2009, 1, 1) + timedelta(hours=i), float(i % 5)) for i in range(20)]
    rows += [(datetime(2020, 12, 1) + timedelta(hours=i), float(i % 3)) for i in range(9)]
    rows += [(datetime(2020, 7, 1), 99.0), (datetime(2008, 1, 1), 99.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, t double")
    out = {r.period: r for r in weather.climate_shift(df, "ts", "t", 2017, ("a", "b"), 2009, 2026).collect()}
    assert (out["a"].n, out["a"]["mean"], out["b"].n, out["b"]["mean"]) == (20, 2.0, 9, 1.0)


def test_price_reconciliation(spark):
    df = spark.createDataFrame(
        [(10.0, 1.0, 8.0, 1.0), (10.0, 1.0, 8.0, 1.04), (10.0, 1.0, 8.0, 1.06), (10.0, None, 8.0, 1.0)],
        "lmp double, mcc double, mec double, mlc double",
    )
    assert [r.lmp_check_flag for r in quality.reconcile_prices(df).collect()] == [0, 0, 1]


def test_rules_and_metrics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("a", None), ("b", 0.0)], "k string, x double")
    out = {r.k: tuple(r)[1:] for r in quality.rule_counts(df, F.col("x") >= 0, ["k"]).collect()}
    assert out == {"a": (3, 1, 2), "b": (1, 1, 0)}
    assert quality.keep_non_negative(df, "x").count() == 2
    assert quality.keep_positive(df, "x").count() == 1
    nulls = quality.null_counts(df, ["x"], ["k"]).where("k = 'a'").first()
    assert (nulls.total_count, nulls.null_x) == (3, 1)
    flagged = quality.with_capacity_flag(df, "x", "f", 0.5).collect()
    assert [r.f for r in flagged] == [1, 0, None, 0]


def test_latest_row_per_key(spark):
    df = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "only", 1)], "k int, v string, loaded int")
    out = quality.latest_per_key(df, ["k"], ["loaded"]).collect()
    assert sorted((r.k, r.v) for r in out) == [(1, "new"), (2, "only")]


def test_flag_rates_of_no_rows(spark):
    df = spark.createDataFrame([], "f boolean")
    assert [tuple(r) for r in quality.flag_rates(df, ["f"]).collect()] == [("f", 0, 0.0)]


def test_completeness(hours):
    df = hours([1.0] * 30)
    row = quality.completeness(df, "start_time", F.min("start_time"), F.max("start_time")).first()
    assert tuple(row) == (48, 30, 18)


def test_repeated_keys_do_not_multiply(spark):
    from datetime import datetime

    from gridlens.operators import fuel, prices

    hour = datetime(2024, 1, 1)
    side = spark.createDataFrame([("n", hour, 1.0, 1), ("n", hour, 2.0, 0)], "node string, start_time timestamp_ntz, lmp double, load int")
    assert [r.lmp_da_exante for r in prices.dart_table(side, side, ["load"]).collect()] == [1.0]
    assert prices.dart_table(side, side).count() == 1
    columns = list(fuel.FUELS.values())
    mix = spark.createDataFrame([("r", hour, *[1.0] * len(columns))] * 2, "region string, start_time timestamp_ntz, " + ", ".join(f"{c} double" for c in columns))
    assert fuel.fuel_mix_compare(mix, mix).count() == 1
