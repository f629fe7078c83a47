"""Transmission rights and tail risk."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.operators import rights, risk

AUCTION = "MarketParticipant string, Source string, Sink string, StartDate string, EndDate string, Type string, Class string, MW double, ClearingPrice double"


@pytest.fixture(scope="module")
def positions(spark):
    rows = [
        ("P", "A", "B", "12/1/2025", "2/28/2026", "OBL", "Peak", 10.0, 100.0),
        ("P", "A", "B", "12/1/2025", "2/28/2026", "OBL", "Peak", 30.0, 200.0),
        ("Q", "A", "B", "12/1/2025", "2/28/2026", "OBL", "Peak", 60.0, 300.0),
        ("P", "B", "A", "12/1/2024", "2/28/2025", "OBL", "Off-peak", 5.0, 10.0),
    ]
    return spark.createDataFrame(rows, AUCTION)


def test_weighted_positions(positions):
    own = rights.weighted_positions(positions, ["P"]).where("Source = 'A'").first()
    assert (own.MW, own.ClearingPrice, own.WinterYear) == (40.0, 175.0, 2025)
    market = rights.weighted_positions(positions).where("Source = 'A'").first()
    assert (market.MW, market.ClearingPrice) == (100.0, 250.0)


def test_backfilled_positions(positions):
    held = rights.backfill_positions(rights.weighted_positions(positions), 2025, [2014, 2020])
    assert held.count() == 4
    copy = held.where("WinterYear = 2020").first()
    assert (copy.StartDate, copy.EndDate, copy.MW) == ("12/1/2020", "2/28/2021", 100.0)


@pytest.fixture(scope="module")
def pnl(spark, positions):
    # Thursday 15 January 2026: hours 6..9 are peak.
    start = datetime(2026, 1, 15, 6)
    rows = []
    for i, (a, b) in enumerate([(10.0, 12.0), (20.0, 15.0), (30.0, 90.0), (5.0, 5.0)]):
        rows += [("A", start + timedelta(hours=i), a, -6.0 if i != 1 else 0.0), ("B", start + timedelta(hours=i), b, 0.0)]
    prices = spark.createDataFrame(rows, "node string, start_time timestamp_ntz, lmp double, Temperature double")
    hours = spark.createDataFrame([(2025, "Peak", 1000), (2024, "Off-peak", 1)], "WinterYear int, Class string, ClassHours long")
    return rights.hourly_pnl(rights.weighted_positions(positions, ["P"]), prices, hours)


def test_hourly_profit(pnl):
    rows = pnl.orderBy("start_time").collect()
    assert [r.PriceSpread for r in rows] == [2.0, -5.0, 60.0, 0.0]
    assert {r.HourlyCost for r in rows} == {7.0}
    assert [r.HourlyProfitLoss for r in rows] == [73.0, -207.0, 2393.0, -7.0]
    assert [r.HourlyCongestionRevenue for r in rows] == [80.0, -200.0, 2400.0, 0.0]


def test_summaries(pnl, positions):
    row = rights.summarise_paths(pnl, rights.weighted_positions(positions, ["P"])).first()
    assert (row.TotalCost, row.PricePaidPerMW, row.MWHeld) == (7000.0, 175.0, 40.0)
    assert (row.TotalProfitLoss, row.TotalCongestionRevenue) == (2252.0, 2280.0)
    assert row.StdHourlyProfitLoss == pytest.approx(np.std([73.0, -207.0, 2393.0, -7.0], ddof=1))
    season = rights.summarise_seasons(pnl).first()
    assert (season.TotalProfitLoss, season.MinProfitLoss, season.MaxProfitLoss) == (2252.0, -207.0, 2393.0)
    assert rights.event_pnl(pnl, date(2026, 1, 15), date(2026, 1, 16)).first().TotalProfitLoss == 2252.0
    assert rights.event_pnl(pnl, date(2026, 1, 16), date(2026, 1, 17)).count() == 0


def test_path_series(pnl):
    total = rights.cumulative_pnl(rights.path_hours(pnl)).orderBy("start_time").collect()
    assert [r.CumulativeProfitLoss for r in total] == [73.0, -134.0, 2259.0, 2252.0]
    cold = rights.cold_spells(pnl, ["Source", "Sink"]).orderBy("spell_start").collect()
    assert [(r.spell_start.hour, r.spell_end.hour) for r in cold] == [(6, 6), (8, 9)]
    drivers = rights.path_drivers(pnl, ["Temperature"]).first()
    assert (drivers.ProfitableHours, drivers.Hours, drivers.min_Temperature) == (2, 4, -6.0)
    expected = np.corrcoef([-6, 0, -6, -6], [73.0, -207.0, 2393.0, -7.0])[0, 1]
    assert drivers.corr_Temperature == pytest.approx(expected)


def test_path_spreads_of_winter_hours(spark):
    rows = [(n, datetime(2026, m, 15, 6), p) for m in (1, 7) for n, p in (("A", 1.0), ("B", 3.0), ("C", 9.0))]
    prices = spark.createDataFrame(rows, "node string, start_time timestamp_ntz, lmp double")
    paths = spark.createDataFrame([("A", "B")], "Source string, Sink string")
    out = rights.path_spreads(prices, paths).collect()
    assert [(r.PriceSpread, r.WinterYear, r.Class) for r in out] == [(2.0, 2025, "Peak")]


SAMPLE = [1.0, 2.0, 2.5, 4.0, 9.0, -30.0, 5.5, 7.0]


@pytest.fixture(scope="module")
def spreads(spark):
    return spark.createDataFrame([("p", x) for x in SAMPLE] + [("p", None)], "path string, x double")


def test_cvar_fixture(spreads):
    m = risk.cvar_metrics(spreads, ["path"], "x", 0.95)
    row = m.first()
    assert (row.CVaR_Left_Tail, row.CVaR_Right_Tail) == (-30.0, 9.0)
    assert row.Left_Tail_Threshold == pytest.approx(-19.15)
    assert row.Right_Tail_Threshold == pytest.approx(8.3)
    assert (row.Mean_Spread, row.Median_Spread) == (0.125, 3.25)
    assert row.Std_Spread == pytest.approx(11.658553726770744)
    assert row.CVaR_Value == pytest.approx(-1.38125)
    assert (row.n_observations, row.n_left_tail_events, row.n_right_tail_events) == (8, 1, 1)
    assert row.CVaR_Left_Tail <= row.Left_Tail_Threshold <= row.Median_Spread
    price = risk.cvar_price(m, ["path"], F.lit(77), F.lit(1008)).first()
    assert price.CVaR_FTR_Price == pytest.approx(-107207.1)
    assert price.Mean_Spread_Price == pytest.approx(9702.0)
    assert price.Risk_Premium == pytest.approx(-116909.1)
    gap = risk.normal_var_gap(m, ["path"]).first()
    assert gap.normal_var_95 == pytest.approx(0.125 - 1.6448536269514722 * 11.658553726770744)


def test_tails_with_many_ties(spark):
    values = [-5.0] * 40 + [float(i % 9) for i in range(160)]
    df = spark.createDataFrame([("p", v) for v in values], "path string, x double")
    row = risk.cvar_metrics(df, ["path"], "x", 0.95).first()
    arr = np.array(values)
    low, high = np.percentile(arr, 5), np.percentile(arr, 95)
    assert row.n_left_tail_events == (arr <= low).sum() == 40
    assert row.n_right_tail_events == (arr >= high).sum()
    assert row.CVaR_Right_Tail == pytest.approx(arr[arr >= high].mean())


def test_tail_compare(spark):
    event = [-100.0, -50.0, 0.0, 10.0]
    rows = [("p", "hist", x) for x in SAMPLE] + [("p", "event", x) for x in event] + [("q", "event", 1.0)]
    df = spark.createDataFrame(rows, "path string, sample string, x double")
    out = risk.tail_compare(df, ["path"], "x", "sample").collect()
    assert [r.path for r in out] == ["p"]
    row = out[0]
    assert (row.hist_cvar, row.event_cvar, row.cvar_gap) == (-30.0, -100.0, -70.0)
    assert row.share_beyond_hist_cvar == 0.5
    assert row.share_beyond_hist_var == 0.5
    assert row.worst_ratio == pytest.approx(100 / 30)
    assert (row.event_hours, row.event_mean) == (4, -35.0)
    assert row.hist_skewness == pytest.approx(-2.057295017425282)


def test_tail_histogram_and_outcome(spreads):
    bars = risk.histogram_tail(spreads, ["path"], "x", bins=10).collect()
    assert sum(r["count"] for r in bars) == 8
    assert sorted(r.bin for r in bars if r.in_tail) == [0]
    out = risk.event_outcome(spreads, ["path"], "x", 2.0, 10).first()
    assert (out.actual_pnl, out.scaled_pnl) == (2.0, 20.0)


def test_metrics_of_random_groups_match_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {
        "hot": np.round(rng.standard_t(2, 4000) * 20, 2),
        "small": rng.normal(0, 1, 7),
        "shifted": 1e5 + rng.random(300),
        "flat": np.full(50, 3.0),
    }
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "path string, x double").repartition(6)
    out = {r.path: r for r in risk.cvar_metrics(df, ["path"], "x", 0.95).collect()}
    assert set(out) == set(groups)
    for k, xs in groups.items():
        row, low, high = out[k], np.percentile(xs, 5), np.percentile(xs, 95)
        assert row.Left_Tail_Threshold == pytest.approx(low, rel=1e-12)
        assert row.CVaR_Left_Tail == pytest.approx(xs[xs <= low].mean(), rel=1e-12)
        assert row.CVaR_Right_Tail == pytest.approx(xs[xs >= high].mean(), rel=1e-12)
        assert row.n_left_tail_events == (xs <= low).sum()
        assert row.Std_Spread == pytest.approx(xs.std(), rel=1e-6, abs=1e-9)
        order = [row.CVaR_Left_Tail, row.Left_Tail_Threshold, row.Median_Spread, row.Right_Tail_Threshold, row.CVaR_Right_Tail]
        assert order == sorted(order)
