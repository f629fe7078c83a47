"""Ingest jobs, their counters, windows and marks; joins that must not pile up rows."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlens.operators import load, rights
from gridlens.operators.quality import COUNTERS, apply_rule
from gridlens.session import stage
from gridlens.sinks import ingest, tables as sink
from gridlens.sources import feeds, tables
from gridlens.streaming import prices

PAGE = '{{"data": [{}]}}'
MIX = '{{"region": "N", "timeInterval": {{"start": "{0}", "end": "{0}", "resolution": "h", "value": "1"}}, "totalMw": {1}, "fuelTypes": {{"coal": 1}}}}'
PRICE = (
    '{{"node": "{0}", "timeInterval": {{"start": "{1}", "end": "{1}", "resolution": "h", "value": "1"}}, "preliminaryFinal": "F",'
    ' "lmp": {2}, "mcc": {3}, "mec": {2}, "mlc": 0}}'
)


def land(folder, name, *records, at=None):
    folder.mkdir(parents=True, exist_ok=True)
    file = folder / name
    file.write_text("".join(PAGE.format(r) + "\n" for r in records))
    if at is not None:
        import os

        os.utime(file, (at, at))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_counters_and_upsert(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "table")
    land(
        landing, "a.json", PRICE.format("A", "2024-01-01T00:00:00", 5, 0), PRICE.format("A", "2024-01-01T01:00:00", 5, 1),
        PRICE.format("A", "2024-01-02T00:00:00", "null", 0), PRICE.format("B", "2024-01-02T00:00:00", 7, "null"),
    )
    first = ingest.ingest_feed(spark, str(landing), path, "da_exante")
    assert (first.sink, first.rows_read, first.rows_kept, first.rows_removed, first.rows_mismatched, first.rows_written) == ("upsert", 4, 2, 2, 1, 2)
    land(landing, "b.json", PRICE.format("A", "2024-01-01T00:00:00", 9, 0), PRICE.format("B", "2024-01-02T00:00:00", 7, 0))
    second = ingest.ingest_feed(spark, str(landing), path, "da_exante")
    assert (second.rows_read, second.rows_kept, second.rows_written) == (6, 4, 1)
    stored = {(r.node, r.start_time.hour): r.lmp for r in spark.read.parquet(path).collect()}
    assert stored == {("A", 0): 5.0, ("A", 1): 5.0, ("B", 0): 7.0}
    assert ingest.ingest_feed(spark, str(landing), path, "da_exante").rows_written == 0
    # The landed pages are looked at once, and load columns do not reach the table.
    rows = apply_rule(feeds.read_feed(spark, str(landing), "da_exante", load=True), None, "seen")
    assert plan_of(feeds.newest_load(rows, ["node", "start_time"])).count("FileScan json") == 1
    assert not set(feeds.LOAD_COLUMNS) & set(spark.read.parquet(path).columns)


@pytest.mark.parametrize("kind", ["upsert", "append", "overwrite", "overwrite_partitions"])
def test_refuses_a_landing_without_rows(spark, tmp_path, kind):
    """Nothing landed, or nothing that passes the rule, leaves the table as it is."""
    landing, path = tmp_path / "landing", str(tmp_path / "table")
    land(landing, "a.json", MIX.format("2024-01-01T00:00:00", 5))
    ingest.ingest_feed(spark, str(landing), path, "da_fuel_mix", kind)
    for records in ([], [MIX.format("2024-01-01T00:00:00", -5), MIX.format("2024-01-01T00:00:00", "null")]):
        empty = tmp_path / f"empty{len(records)}"
        land(empty, "a.json", *records)
        with pytest.raises(ValueError):
            ingest.ingest_feed(spark, str(empty), path, "da_fuel_mix", kind)
    assert [r.totalMw for r in spark.read.parquet(path).collect()] == [5.0]


def test_sinks_of_two_landings(spark, tmp_path):
    """What each sink leaves of a stored day, a day in both landings and a new day."""
    want = {
        "upsert": {1: 1.0, 2: 2.0, 3: 30.0}, "append": {1: 1.0, 2: 20.0, 3: 30.0},
        "overwrite": {2: 20.0, 3: 30.0}, "overwrite_partitions": {1: 1.0, 2: 20.0, 3: 30.0},
    }
    land(tmp_path / "one", "a.json", *[MIX.format(f"2024-01-0{d}T00:00:00", d) for d in (1, 2)])
    land(tmp_path / "two", "a.json", *[MIX.format(f"2024-01-0{d}T00:00:00", 10 * d) for d in (2, 3)])
    for kind, rows in want.items():
        path = str(tmp_path / kind)
        for landing in ("one", "two"):
            ingest.ingest_feed(spark, str(tmp_path / landing), path, "da_fuel_mix", kind)
        assert {r.start_time.day: r.totalMw for r in spark.read.parquet(path).collect()} == rows, kind


def test_newest_load(spark, tmp_path):
    """The file landed last decides, whatever its name and value; of one instant the name does."""
    hour = "2024-01-01T00:00:00"
    land(tmp_path, "z.json", MIX.format(hour, 9), at=1_000)
    land(tmp_path, "a.json", MIX.format(hour, 1), MIX.format(hour, 2), at=2_000)
    rows = feeds.read_feed(spark, str(tmp_path), "da_fuel_mix", load=True)
    assert [r.totalMw for r in feeds.newest_load(rows, ["region", "start_time"]).collect()] == [2.0]
    land(tmp_path, "b.json", MIX.format(hour, 0), at=2_000)
    rows = feeds.read_feed(spark, str(tmp_path), "da_fuel_mix", load=True)
    assert [r.totalMw for r in feeds.newest_load(rows, ["region", "start_time"]).collect()] == [0.0]


def test_window(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "table")
    for d in range(1, 8):
        land(landing / f"landed=2024-01-0{d}", "a.json", MIX.format(f"2024-01-0{d}T00:00:00", d), MIX.format(f"2024-01-0{d}T01:00:00", -1))
    run = lambda first, end: ingest.ingest_window(spark, str(landing), path, "da_fuel_mix", date(2024, 1, first), date(2024, 1, end))
    one = run(2, 5)
    assert (one.days, one.rows_read, one.rows_kept, one.rows_removed, one.rows_written) == (3, 6, 3, 3, 3)
    assert ingest.missing_days(spark, path, date(2023, 12, 30), date(2024, 1, 4)) == [date(2023, 12, 30), date(2023, 12, 31), date(2024, 1, 1)]
    # Stored days are left alone although their landing changes; a repeated run writes nothing.
    land(landing / "landed=2024-01-03", "a.json", MIX.format("2024-01-03T00:00:00", 99))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "table").rglob("*.parquet")}
    two = run(1, 7)
    assert (two.days, two.rows_written) == (3, 3)
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    assert run(1, 7).days == 0 and run(1, 7).rows_written == 0
    assert sorted(r.totalMw for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        run(8, 12)
    pages = feeds.read_pages(spark, str(landing), feeds.FEEDS["da_fuel_mix"]).where(F.col("landed").isin(date(2024, 1, 3)))
    scan = plan_of(pages)
    assert "PartitionFilters: [" in scan and "landed" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_stored_mark_reads_one_partition(spark, tmp_path):
    path = str(tmp_path / "table")
    assert tables.stored_mark(spark, path, "t") is None
    hours = [(datetime(2022 + k // 12, k % 12 + 1, 5, k % 24),) for k in range(30)]
    df = spark.createDataFrame(hours, "t timestamp_ntz").withColumns({"year": F.year("t"), "month": F.month("t")})
    sink.overwrite_table(df, path)
    assert tables.stored_mark(spark, path, "t") == hours[-1][0]
    folders = list(tables._newest_folders(spark, path, ("year", "month")))
    assert len(folders) == 30 and folders[0].endswith("year=2024/month=6") and folders[1].endswith("year=2024/month=5")
    assert len(tables.newest_in(spark, folders[0], "t").inputFiles()) == 1
    # A newest partition that holds no time: the one before it decides.
    none = spark.createDataFrame([(None, 2024, 9)], "t timestamp_ntz, year int, month int")
    none.write.mode("append").partitionBy("year", "month").parquet(path)
    assert tables.stored_mark(spark, path, "t") == hours[-1][0]
    later = tables.after_stored_mark(spark, spark.read.parquet(path), path, "t")
    assert later.count() == 0 and "PushedFilters: [IsNotNull(t), GreaterThan(t,2024-06-05T05:00)]" in plan_of(later)
    incoming = spark.createDataFrame([(hours[-1][0],), (hours[-1][0] + timedelta(hours=1),), (None,)], "t timestamp_ntz")
    assert [r.t for r in tables.after_stored_mark(spark, incoming, path, "t").collect()] == [hours[-1][0] + timedelta(hours=1)]


def test_rounds_by_path(spark, tmp_path):
    for year in (23, 24):
        for number in (1, 2, 3):
            (tmp_path / f"Win{year}_round_{number}.csv").write_text(
                f"MarketParticipant,Source,Sink,StartDate,EndDate,Type,Class,MW,ClearingPrice\nG,A,B,12/1/2023,2/28/2024,T,Peak,{year},{number}\n"
            )
    (tmp_path / "other.csv").write_text("MarketParticipant,Source,Sink,StartDate,EndDate,Type,Class,MW,ClearingPrice\nG,A,B,x,y,T,Peak,1,1\n")
    rows = tables.read_rounds(spark, str(tmp_path), r"Win(\d+)_round_(\d+)")
    got = sorted((r.year, r.round, r.MW, r.ClearingPrice) for r in rows.where("year is not null").collect())
    assert got == [(y, n, float(y), float(n)) for y in (23, 24) for n in (1, 2, 3)]
    assert rows.where("year is null and round is null").count() == 1 and plan_of(rows).count("FileScan csv") == 1


def test_load_weather_join(spark):
    """Unmatched rows of every side and NULL keys stay; one exchange."""
    t = [datetime(2024, 1, 1, h) for h in range(5)]
    actual = spark.createDataFrame([(t[0], "a", 1.0), (t[0], "b", 2.0), (t[1], "a", 3.0), (None, "a", 4.0)], "Datetime timestamp_ntz, Zone string, LoadActual double")
    forecast = spark.createDataFrame([(t[0], "a", 5.0), (t[2], "a", 6.0), (t[0], None, 7.0)], "Datetime timestamp_ntz, Zone string, LoadForecast double")
    weather = spark.createDataFrame([(t[0], 10.0, "x"), (t[3], None, "y"), (None, 12.0, "z")], "Datetime timestamp_ntz, Temperature double, Sky string")
    out = load.join_load_weather(actual, forecast, weather)
    assert out.columns == ["Datetime", "Zone", "LoadActual", "LoadForecast", "Temperature", "Sky"]
    got = sorted(map(str, (tuple(r) for r in out.collect())))
    want = [
        (t[0], "a", 1.0, 5.0, 10.0, "x"), (t[0], "b", 2.0, None, 10.0, "x"), (t[0], None, None, 7.0, 10.0, "x"), (t[1], "a", 3.0, None, None, None),
        (t[2], "a", None, 6.0, None, None), (t[3], None, None, None, None, "y"), (None, "a", 4.0, None, 12.0, "z"),
    ]
    assert got == sorted(map(str, want))
    assert plan_of(out).count("Exchange hashpartitioning") == 1 and "Join" not in plan_of(out)


def test_spread_join(spark):
    """Ten keys, one with a third of all rows: the same rows as a plain join, no task with a large share of them."""
    left = stage(spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 10).alias("k")), "left")
    right = spark.range(40).select((F.col("id") % 10).alias("k"), F.col("id").alias("h"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        joined = rights.spread_join(left, right, ["k"], 500)
        sizes = joined.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        plain = left.join(right, "k")
        assert sizes.max() < 0.1 * sizes.sum() < plain.groupBy(F.spark_partition_id()).count().toPandas()["count"].max()
        assert joined.select("id", "h").exceptAll(plain.select("id", "h")).count() == 0 and joined.count() == plain.count() == 120_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hourly_pnl_of_many_positions(spark):
    """Dealing positions out does not change the result."""
    times = [datetime(2024, 1, 2) + timedelta(hours=h) for h in range(48)]
    prices = spark.createDataFrame([(n, t, float(k + ord(n))) for n in "AB" for k, t in enumerate(times)], "node string, start_time timestamp_ntz, lmp double")
    positions = spark.createDataFrame(
        [("A", "B", "12/1/2023", "2/28/2024", f"T{k}", "Peak", float(k), 2.0, 2023) for k in range(60)],
        "Source string, Sink string, StartDate string, EndDate string, Type string, Class string, MW double, ClearingPrice double, WinterYear int",
    )
    hours = rights.class_hours(prices.select("start_time").distinct())
    few, many = (rights.hourly_pnl(positions, prices, hours, limit).select("Type", "start_time", "HourlyProfitLoss") for limit in (1000, 7))
    assert few.count() == many.count() > 0 and few.exceptAll(many).count() == 0


def test_path_series(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({
        "Source": "A", "Sink": rng.choice(["B", "C"], 400), "WinterYear": rng.choice([2022, 2023], 400),
        "start_time": [datetime(2024, 1, 1) + timedelta(hours=int(h)) for h in rng.integers(0, 120, 400)],
        "HourlyProfitLoss": rng.normal(size=400).round(3),
    })
    drivers = pd.DataFrame({"start_time": [datetime(2024, 1, 1) + timedelta(hours=h) for h in range(120)], "Temperature": rng.normal(-5, 5, 120), "Wind": rng.random(120) * 100})
    drivers.loc[7, "Temperature"] = np.nan
    frame = frame.merge(drivers, on="start_time")
    df = spark.createDataFrame(frame).withColumn("start_time", F.col("start_time").cast("timestamp_ntz")).withColumn("Temperature", F.nanvl("Temperature", F.lit(None).cast("double")))
    series, got = rights.path_series(df), {}
    report = {(r.Sink, r.WinterYear): r for r in rights.path_report(series).collect()}
    for r in series.collect():
        got.setdefault((r.Sink, r.WinterYear), []).append(r)
    for key, own in frame.groupby(["Sink", "WinterYear"]):
        hours = own.groupby("start_time").agg(p=("HourlyProfitLoss", "sum"), t=("Temperature", "max"), w=("Wind", "max")).sort_index()
        rows = sorted(got[key], key=lambda r: r.start_time)
        assert np.allclose([r.CumulativeProfitLoss for r in rows], hours.p.cumsum()) and len(rows) == len(hours)
        cold = (hours.t < -5).to_numpy()
        begins = cold & ~np.append(False, cold[:-1])
        assert [r.Spell for r in rows] == [int(k) if c else None for k, c in zip(begins.cumsum(), cold)]
        r = report[key]
        assert (r.Hours, r.ColdSpells, r.ColdHours, r.ProfitableHours) == (len(hours), begins.sum(), cold.sum(), (hours.p > 0).sum())
        assert np.isclose(r.corr_Temperature, hours.t.corr(hours.p)) and np.isclose(r.LowestCumulative, hours.p.cumsum().min())
        assert np.isclose(r.ColdProfitLoss, hours.p[cold].sum())
    # Hours by path, then one exchange to sort a path's season; the report exchanges nothing more.
    assert plan_of(rights.path_report(series)).count("Exchange hashpartitioning") == plan_of(series).count("Exchange hashpartitioning") == 2


def test_event_window_prunes(spark, tmp_path):
    times = [datetime(2022, 12, 1) + timedelta(hours=12 * h) for h in range(900)]
    prices = spark.createDataFrame([(n, t, float(h)) for n in "AB" for h, t in enumerate(times)], "node string, start_time timestamp_ntz, lmp double")
    stored = prices.withColumns({"year": F.year("start_time"), "month": F.month("start_time")})
    sink.overwrite_table(stored, str(tmp_path / "prices"))
    positions = spark.createDataFrame([("A", "B", "Peak", 2.0, 3.0, 2023)], "Source string, Sink string, Class string, MW double, ClearingPrice double, WinterYear int")
    hours = rights.class_hours(prices.select("start_time").distinct())
    window = (date(2024, 1, 10), date(2024, 1, 20))
    pruned = rights.event_profit(positions, spark.read.parquet(str(tmp_path / "prices")), hours, *window)
    whole = rights.event_profit(positions, prices, hours, *window)
    assert pruned.collect() == whole.collect() and pruned.count() == 1
    from gridlens.functions.timeparts import prune_to_window

    read = prune_to_window(spark.read.parquet(str(tmp_path / "prices")), "start_time", *window)
    assert {f.split("year=")[1].rsplit("/", 1)[0] for f in (r.f for r in read.select(F.col("_metadata.file_path").alias("f")).distinct().collect())} == {"2024/month=1"}


def test_streamed_deliveries(spark, tmp_path):
    """Counters of each delivery; a stored key stays; late rows are counted and not stored; state follows the time rows may be late."""
    landing, path, checkpoint = tmp_path / "landing", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    day = lambda d, price=5, part=0, node="A": PRICE.format(node, f"2024-01-{d:02d}T00:00:00", price, part)
    run = lambda: [dict(zip(("batch", *COUNTERS, "late", "repeated", "inserted", "state"), r)) for r in prices.ingest_available(spark, str(landing), path, checkpoint, lateness="2 days 12 hours")]
    land(landing, "1.json", *[day(d) for d in range(1, 11)], day(3, part="null"))
    first, = run()
    assert (first["rows_read"], first["rows_kept"], first["rows_removed"], first["late"], first["repeated"], first["inserted"]) == (11, 10, 1, 0, 0, 10)
    assert run() == []
    # Day 9 again at another price, days 11 to 13 of which one does not reconcile, and a day behind the watermark.
    land(landing, "2.json", day(9, 7), *[day(d, part=1 if d == 12 else 0) for d in (11, 12, 13)], day(2, node="B"))
    second, = run()
    assert (second["rows_read"], second["rows_kept"], second["rows_mismatched"]) == (5, 5, 1)
    assert (second["late"], second["repeated"], second["inserted"]) == (1, 1, 3)
    for k, d in enumerate(range(14, 32, 9)):
        land(landing, f"3{k}.json", *[day(x) for x in range(d, min(d + 9, 32))])
        last = run()[-1]
    assert spark.read.parquet(path).count() == 31 and last["state"] < 15
    stored = {r.start_time.day: (r.lmp, r.lmp_check_flag) for r in spark.read.parquet(path).collect()}
    assert stored[9] == (5.0, 0) and stored[12] == (5.0, 1) and 2 in stored
