"""Landed feeds, stored tables and the streaming ingest."""

import json
import os
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gridlens.operators.quality import reconcile_prices
from gridlens.session import scratch_dir, stage
from gridlens.sinks import tables as sink
from gridlens.sources import feeds, tables
from gridlens.sources.weather import read_weather
from gridlens.streaming.prices import PRICE_KEYS, clean_price_stream, upsert_stream


def interval(hour, day=21):
    return {"start": f"2026-01-{day:02d}T{hour:02d}:00:00", "end": f"2026-01-{day:02d}T{hour + 1:02d}:00:00",
            "resolution": "hourly", "value": str(hour)}


def land(path, *pages):
    path.mkdir(exist_ok=True)
    for records in pages:
        target = path / f"page-{len(os.listdir(path)):03d}.json"
        target.write_text(json.dumps({"data": records}))
    return str(path)


def price(node, hour, lmp=25, mlc=1, **kw):
    return {"node": node, "timeInterval": interval(hour), "preliminaryFinal": "F", "lmp": lmp, "mcc": 4,
            "mec": 20, "mlc": mlc, **kw}


def test_price_feed(spark, tmp_path):
    path = land(tmp_path / "p", [price("A", 5), price("A", 6, lmp=25.5)], [price("B", 5, mlc=None)])
    out = feeds.read_feed(spark, path, "rt_expost")
    row = out.where("node = 'A' and hour(start_time) = 5").first()
    assert row.lmp == 25.0 and row.price_type == "rt_expost" and row.preliminary_final == "F"
    assert row.start_time == datetime(2026, 1, 21, 5) and (row.year, row.month, row.day) == (2026, 1, 21)
    assert reconcile_prices(out).count() == 2
    assert feeds.read_feed(spark, path, "rt_expost", multi_line=True).count() == 3


def test_other_feeds(spark, tmp_path):
    mix = land(tmp_path / "m", [{"region": "NORTH", "timeInterval": interval(1), "totalMw": 9,
                                 "fuelTypes": {"coal": 1, "wind": 2.5}}])
    row = feeds.read_feed(spark, mix, "da_fuel_mix").first()
    assert (row.coal, row.wind, row.gas, row.demand_type) == (1.0, 2.5, None, "da_fuel_mix")
    demand = land(tmp_path / "d", [{"interval": interval(1), "demand": 7}])
    row = feeds.read_feed(spark, demand, "rt_cleared_demand").first()
    assert (row.region, row.demand, row.start_time.hour) == ("MISO", 7.0, 1)
    supply = land(tmp_path / "s", [{"timeInterval": interval(1), "supply": 3}, {"timeInterval": {"start": "x"}, "supply": 1}])
    rows = feeds.read_feed(spark, supply, "da_cleared_generation_virtual").orderBy("supply").collect()
    assert [(r.region, r.start_time) for r in rows] == [("NO_REGION", None), ("NO_REGION", datetime(2026, 1, 21, 1))]


def test_node_pages(spark, tmp_path):
    for page, names in ((1, ["a", "b"]), (2, ["c"])):
        (tmp_path / f"page_fetched={page}").mkdir()
        body = {"data": [{"name": n, "nodeType": "hub"} for n in names]}
        (tmp_path / f"page_fetched={page}" / "nodes.json").write_text(json.dumps(body))
    out = feeds.read_nodes(spark, str(tmp_path), "name string, nodeType string")
    assert sorted((r.name, r.page_fetched) for r in out.collect()) == [("a", 1), ("b", 1), ("c", 2)]


def test_weather_document(spark, tmp_path):
    body = {"hourly": {"time": ["2026-01-21T05:00", "2026-01-21T06:00"], "temperature_2m": [1, None], "rain": []}}
    (tmp_path / "w.json").write_text(json.dumps(body))
    rows = read_weather(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [r.temperature_2m for r in rows] == [1.0, None]
    assert rows[1].timestamp == datetime(2026, 1, 21, 6) and rows[0].rain is None and rows[0].snowfall is None
    assert (rows[0].station_id, rows[0].latitude) == ("KMSP", 44.882)


def test_load_report_lines(spark, tmp_path):
    head = "MarketDay,HourEnding,LoadResource Zone,MTLF (MWh),ActualLoad (MWh)"
    (tmp_path / "a.csv").write_text("\n".join(["Some report", "", head, "2024-01-01,1,LRZ1 N,10,11", head, "2024-01-01,2,LRZ1 N,12,"]))
    out = tables.read_load_report(spark, str(tmp_path)).orderBy("HourEnding").collect()
    assert [(r.MarketDay, r.HourEnding, r["ActualLoad (MWh)"]) for r in out] == [
        (date(2024, 1, 1), 1, 11.0), (date(2024, 1, 1), 2, None)
    ]


def test_auction_rounds(spark, tmp_path):
    paths = tables.auction_paths(str(tmp_path), "win{year}_r{round}.csv", [23, 24], [1, 2])
    assert [p[-11:] for p in paths] == ["win23_r1.csv"[-11:], "win24_r1.csv"[-11:], "win23_r2.csv"[-11:], "win24_r2.csv"[-11:]]
    for p in paths:
        with open(p, "w") as f:
            f.write("MarketParticipant,Source,Sink,StartDate,EndDate,Type,Class,MW,ClearingPrice\nP,A,B,12/1/2023,2/29/2024,OBL,Peak,1.5,10\n")
    assert tables.read_auctions(spark, paths).agg(F.sum("MW")).first()[0] == 6.0


KEYED = "k int, v string, loaded int, year int, month int"


def rows(spark, *items):
    return spark.createDataFrame([(k, v, n, 2026, m) for k, v, n, m in items], KEYED)


def test_upsert_inserts_unknown_keys_once(spark):
    path = scratch_dir(spark, "upsert")
    assert sink.create_or_upsert(spark, rows(spark, (1, "a", 1, 1), (2, "a", 1, 1)), path, ["k"], ["loaded"]) == 2
    source = rows(spark, (2, "b", 2, 1), (2, "c", 3, 1), (3, "b", 2, 2), (3, "c", 3, 2))
    assert sink.create_or_upsert(spark, source, path, ["k"], ["loaded"]) == 1
    assert sink.create_or_upsert(spark, source, path, ["k"], ["loaded"]) == 0
    out = sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
    assert out == [(1, "a"), (2, "a"), (3, "c")]


def test_upsert_skips_partitions_far_from_the_source(spark):
    path = scratch_dir(spark, "far")
    days = spark.sql("SELECT explode(sequence(date'2020-01-01', date'2025-12-31')) AS d").withColumns(
        {"year": F.year("d"), "month": F.month("d")}
    )
    sink.overwrite_table(days, path)
    late = spark.sql("SELECT explode(sequence(date'2025-12-20', date'2026-01-10')) AS d").withColumns(
        {"year": F.year("d"), "month": F.month("d")}
    )
    fresh = sink.new_rows(late, spark.read.parquet(path), ["d"], ["year", "month"])
    assert fresh.count() == 10
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\n]*year[^\n]*Subquery", plan)


def test_append_replaces_touched_partitions_only(spark):
    path = scratch_dir(spark, "append")
    sink.append_deduped(spark, rows(spark, (1, "a", 1, 1), (2, "a", 1, 1), (3, "a", 1, 2)), path, ["k"])
    untouched = sorted(os.listdir(f"{path}/year=2026/month=2"))
    sink.append_deduped(spark, rows(spark, (2, "b", 2, 1), (4, "b", 2, 1)), path, ["k"])
    out = sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
    assert out == [(1, "a"), (2, "b"), (3, "a"), (4, "b")]
    assert sorted(os.listdir(f"{path}/year=2026/month=2")) == untouched


def test_partition_overwrite_and_table_overwrite(spark):
    path = scratch_dir(spark, "overwrite")
    sink.overwrite_table(rows(spark, (1, "a", 1, 1), (2, "a", 1, 2)), path)
    sink.overwrite_partitions(rows(spark, (9, "b", 1, 2)), path)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 9]
    sink.overwrite_table(rows(spark, (5, "c", 1, 3)), path)
    assert [r.k for r in spark.read.parquet(path).collect()] == [5]


def test_high_water_mark(spark):
    stored, incoming = rows(spark, (1, "a", 3, 1), (2, "a", 7, 1)), rows(spark, (3, "b", 7, 1), (4, "b", 8, 1))
    assert [r.k for r in tables.after_high_water_mark(incoming, stored, "loaded").collect()] == [4]
    nothing = stored.where("k > 99")
    assert tables.after_high_water_mark(incoming, nothing, "loaded").count() == 2


def test_window_read_prunes_partitions(spark):
    path = scratch_dir(spark, "window")
    days = spark.sql("SELECT explode(sequence(date'2025-11-01', date'2026-03-31')) AS d").withColumns(
        {"year": F.year("d"), "month": F.month("d")}
    )
    sink.overwrite_table(days, path)
    out = tables.read_window(spark, path, "d", date(2025, 12, 15), date(2026, 2, 1))
    assert (out.agg(F.min("d")).first()[0], out.agg(F.max("d")).first()[0]) == (date(2025, 12, 15), date(2026, 1, 31))
    assert len(out.inputFiles()) <= len(spark.read.parquet(path).inputFiles())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_table_read_ignores_log_folders(spark):
    path = scratch_dir(spark, "log")
    sink.overwrite_table(rows(spark, (1, "a", 1, 1)), path)
    rows(spark, (2, "old", 1, 1)).write.parquet(f"{path}/_delta_log")
    assert [r.k for r in spark.read.parquet(path).collect()] == [1]


def test_empty_source_is_refused(spark):
    with pytest.raises(ValueError):
        sink.require_rows(spark.createDataFrame([], KEYED))
    assert sink.require_rows(rows(spark, (1, "a", 1, 1))).count() == 1


def test_csv_and_stage(spark):
    path = scratch_dir(spark, "csv")
    sink.write_csv(rows(spark, (1, "a", 1, 1)), path)
    assert spark.read.option("header", True).csv(path).first().v == "a"
    staged = stage(rows(spark, (1, "a", 1, 1)), "stage")
    assert staged.collect() == rows(spark, (1, "a", 1, 1)).collect()


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(shared)


def test_stream_equals_batch_and_repeats_insert_nothing(spark, tmp_path):
    landing = tmp_path / "landing"
    path = land(landing, [price("A", 5), price("A", 6, lmp=99), price("B", 5, mcc=None)])
    table, checkpoint = scratch_dir(spark, "prices"), scratch_dir(spark, "checkpoint")

    def run():
        stream = clean_price_stream(spark, path)
        upsert_stream(stream, table, checkpoint, PRICE_KEYS, ["lmp"], ["year", "month"]).awaitTermination()
        return sorted((r.node, r.start_time.hour, r.lmp, r.lmp_check_flag) for r in spark.read.parquet(table).collect())

    batch = reconcile_prices(feeds.read_feed(spark, path, "da_exante"))
    expected = sorted((r.node, r.start_time.hour, r.lmp, r.lmp_check_flag) for r in batch.collect())
    assert run() == expected == [("A", 5, 25.0, 0), ("A", 6, 99.0, 1)]
    land(landing, [price("A", 5, lmp=77), price("C", 7)])
    assert run() == [("A", 5, 25.0, 0), ("A", 6, 99.0, 1), ("C", 7, 25.0, 0)]
    # Same landing folder, new checkpoint: every key is stored already.
    checkpoint = scratch_dir(spark, "checkpoint")
    assert len(run()) == 3


def test_scratch_deletes_its_own_tables_only(spark):
    from pathlib import Path

    from gridlens.session import scratch, stage

    rows = spark.range(3)
    kept = stage(rows, "kept")
    with scratch(spark):
        inner = stage(rows, "inner")
        with scratch(spark):
            deeper, result = stage(rows, "deeper"), stage(rows, "result", outer=True)
            folders = [Path(df.inputFiles()[0].removeprefix("file:")).parent for df in (kept, inner, deeper, result)]
        assert [f.exists() for f in folders] == [True, True, False, True]
        assert result.count() == 3
    assert [f.exists() for f in folders] == [True, False, False, False]


def test_load_report_keeps_every_data_line(spark, tmp_path):
    from gridlens.sources.tables import read_load_report, unread_lines

    lines = [
        "Regional report,,,,", "MarketDay,HourEnding,LoadResource Zone,MTLF (MWh),ActualLoad (MWh)",
        "2024-01-02,1,LRZ1,10,11", '01/02/2024,2.0,LRZ1,"1,234.5",12', "2024-01-02 00:00:00,3,LRZ1,10,",
        "MarketDay,HourEnding,LoadResource Zone,MTLF (MWh),ActualLoad (MWh)", "some day,4,LRZ1,1,1",
    ]
    (tmp_path / "report.csv").write_text("\n".join(lines))
    report = read_load_report(spark, str(tmp_path / "report.csv"))
    rows = sorted(report.collect(), key=lambda r: r.HourEnding)
    assert [str(r.MarketDay) for r in rows] == ["2024-01-02"] * 3 + ["None"]
    assert [r.HourEnding for r in rows] == [1, 2, 3, 4] and rows[1][3] == 1234.5
    assert unread_lines(report) == 1


def test_upsert_with_null_keys_inserts_once(spark, tmp_path):
    from gridlens.sinks.tables import create_or_upsert

    rows = spark.createDataFrame([("a", 1, 2024, 1), (None, 2, 2024, 1), ("b", 3, None, None)], "k string, v int, year int, month int")
    path = str(tmp_path / "table")
    assert [create_or_upsert(spark, rows, path, ["k"], ["v"]) for _ in range(3)] == [3, 0, 0]


def test_stream_keeps_state_once(spark, tmp_path):
    """Two batches with repeats: one state row per key, one stored row per key."""
    from gridlens.streaming.prices import dedupe_stream, upsert_stream

    schema = "k string, start_time timestamp, v int, year int, month int"
    landing = str(tmp_path / "in")
    source = lambda: spark.readStream.schema(schema).parquet(landing)
    batches = [[("a", 1), ("a", 1), ("b", 2)], [("b", 2), ("c", 3), ("a", 1)]]
    counts = []
    for batch in batches:
        rows = spark.createDataFrame([(k, v) for k, v in batch], "k string, v int").selectExpr(
            "k", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, v) AS start_time", "v", "2024 AS year", "1 AS month"
        )
        rows.coalesce(1).write.mode("append").parquet(landing)
        query = upsert_stream(
            dedupe_stream(source(), ["k", "start_time"], "start_time"), str(tmp_path / "out"), str(tmp_path / "check"), ["k"], ["v"]
        )
        query.awaitTermination()
        counts.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert counts == [2, 3]
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
