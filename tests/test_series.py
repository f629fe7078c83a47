"""Chunked series operators against plain pandas on the whole series."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridlens.operators import series as s

SCHEMA = "node string, start_time timestamp_ntz, label string, x double"


@pytest.fixture(scope="module")
def table():
    """One node with most of the rows, gaps in time, runs crossing chunk limits, NULLs."""
    rng = random.Random(3)
    rows = []
    for node, n, labels in (("hot", 2500, "NNNNNE"), ("small", 40, "NES"), ("flat", 300, "N")):
        t, label = datetime(2024, 1, 1), "N"
        for _ in range(n):
            t += timedelta(hours=1 if rng.random() < 0.9 else rng.randint(2, 900))
            if rng.random() < 0.05:
                label = rng.choice(labels)
            rows.append((node, t, label, None if rng.random() < 0.3 else round(rng.gauss(0, 5), 3)))
    return pd.DataFrame(rows, columns=["node", "start_time", "label", "x"])


@pytest.fixture(scope="module")
def df(spark, table):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in table.itertuples(index=False, name=None)]
    rows = [(n, t.to_pydatetime(), label, x) for n, t, label, x in rows]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def collect(df, *columns):
    out = df.select("node", "start_time", *columns).toPandas()
    return out.sort_values(["node", "start_time"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def plain(table):
    return table.sort_values(["node", "start_time"]).reset_index(drop=True)


def same(ours, theirs):
    np.testing.assert_allclose(ours.astype(float), theirs.astype(float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("chunk", ["month", "day", "year"])
def test_position(df, plain, chunk):
    out = collect(s.with_position(df, ["node"], "start_time", chunk=chunk), "position")
    same(out.position, plain.groupby("node").cumcount() + 1)


@pytest.mark.parametrize("chunk", ["month", "day"])
def test_run_counters(df, plain, chunk):
    ours = s.run_counters(
        df, ["node"], "start_time", F.col("label"), "run", {"since": F.col("label") == "E"}, "start", chunk
    )
    out = collect(ours, "run", "since", "start")
    by_node = plain.groupby("node")
    changed = by_node["label"].shift(1) != plain["label"]
    block = changed.groupby(plain["node"]).cumsum()
    same(out.run, plain.groupby([plain["node"], block]).cumcount() + 1)
    marked = (plain["label"] == "E").astype(int).groupby(plain["node"]).cumsum()
    same(out.since, plain.groupby([plain["node"], marked]).cumcount())
    assert ours.columns == [*df.columns, "run", "start", "since"]


def test_run_counter_fixture(hours):
    df = hours(["N", "N", "E", "N", "N"], "label string")
    out = collect(
        s.run_counters(df, ["node"], "start_time", F.col("label"), "run", {"since": F.col("label") == "E"}),
        "run", "since",
    )
    assert list(out.run) == [1, 2, 1, 1, 2]
    assert list(out.since) == [0, 1, 0, 1, 2]


@pytest.mark.parametrize("chunk", ["month", "day"])
def test_elapsed_since(df, plain, chunk):
    out = collect(
        s.elapsed_since(df, ["node"], "start_time", {"h": F.col("label") == "E"}, chunk=chunk), "h"
    )
    last = plain["start_time"].where(plain["label"] == "E").groupby(plain["node"]).ffill()
    begin = plain.groupby("node")["start_time"].transform("min")
    same(out.h, (plain["start_time"] - last.fillna(begin)) / pd.Timedelta(hours=1))


def test_null_labels_form_runs(hours):
    df = hours([None, None, "a", None], "label string")
    out = collect(s.run_counters(df, ["node"], "start_time", F.col("label"), "run"), "run")
    assert list(out.run) == [1, 2, 1, 1]


def test_running_sum(df, plain):
    out = collect(s.running_sum(df, ["node"], "start_time", "x", "total"), "total")
    same(out.total, plain["x"].fillna(0).groupby(plain["node"]).cumsum())


@pytest.mark.parametrize("block_rows", [7, 64, 8192])
def test_rolling_std(df, plain, block_rows):
    out = collect(s.rolling_std(df, ["node"], "start_time", "x", "sd", block_rows=block_rows), "sd")
    expected = plain.groupby("node")["x"].rolling(6, min_periods=1).std().reset_index(drop=True)
    same(out.sd, expected)


@pytest.mark.parametrize("block_rows", [30, 8192])
def test_fills(df, plain, block_rows):
    out = collect(s.forward_fill(df, ["node"], "start_time", ["x"], 2, block_rows=block_rows), "x")
    same(out.x, plain.groupby("node")["x"].ffill(limit=2))
    out = collect(
        s.fill_gaps(df, ["node"], "start_time", ["x"], 1, 24, min_periods=5, block_rows=block_rows), "x"
    )
    mean = plain.groupby("node")["x"].rolling(24, min_periods=5).mean().reset_index(drop=True)
    same(out.x, plain.groupby("node")["x"].ffill(limit=1).fillna(mean))


def test_forward_fill_fixture(hours):
    values = [float(i) if not (3 <= i <= 10 or i == 15) else None for i in range(1, 20)]
    out = collect(s.forward_fill(hours(values), ["node"], "start_time", ["value"], 6), "value")
    got = [None if pd.isna(v) else v for v in out.value]
    assert got[2:10] == [2.0] * 6 + [None, None]
    assert got[14] == 14.0


def test_default_mean_never_fills(hours):
    values = [float(i) for i in range(30)] + [None] * 9
    out = collect(s.fill_gaps(hours(values), ["node"], "start_time", ["value"]), "value")
    assert int(out.value.isna().sum()) == 3


def test_spells(hours):
    temps = [-6.0, -7.0, 1.0, None, -9.0, -5.0, -8.0, -8.0]
    out = s.spells(hours(temps), ["node"], "start_time", F.col("value") < -5).collect()
    found = sorted((r.spell_start.hour, r.spell_end.hour, r.spell_rows) for r in out)
    assert found == [(0, 1, 2), (4, 4, 1), (6, 7, 2)]


def test_spells_cross_chunks(df, plain):
    out = s.spells(df, ["node"], "start_time", F.col("label") == "N", chunk="day").toPandas()
    inside = plain["label"] == "N"
    block = (inside != inside.groupby(plain["node"]).shift(1)).groupby(plain["node"]).cumsum()
    expected = plain[inside].groupby([plain["node"], block])["start_time"].agg(["min", "max", "count"])
    assert sorted(out.spell_rows) == sorted(expected["count"])
    assert sorted(out.spell_start) == sorted(expected["min"])
    assert sorted(out.spell_end) == sorted(expected["max"])


def test_reach_must_fit_a_block(hours):
    with pytest.raises(ValueError):
        s.rolling_std(hours([1.0]), ["node"], "start_time", "value", "sd", rows=10, block_rows=9)


def test_null_keys_and_times_keep_their_rows(spark):
    """Rows out equal rows in, and values equal those of a plain window."""
    from datetime import datetime

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from gridlens.operators import series

    rows = [("a", datetime(2024, 1, 1, h), float(h)) for h in range(4)] + [
        (None, datetime(2024, 1, 31, 23), 1.0), (None, datetime(2024, 2, 1), None), ("a", None, 9.0), (None, None, 8.0),
    ]
    df = spark.createDataFrame(rows, "node string, t timestamp_ntz, x double")
    w = Window.partitionBy("node").orderBy("t")
    want = sorted(
        map(str, df.select("node", "t", F.sum("x").over(w), F.row_number().over(w), F.last("x", True).over(w)).collect())
    )
    out = series.running_sum(df, ["node"], "t", "x", "total")
    out = series.with_position(out, ["node"], "t")
    out = series.forward_fill(out, ["node"], "t", ["x"], limit=3)
    assert sorted(str(tuple(r)) for r in out.select("node", "t", "total", "position", "x").collect()) == sorted(
        str(tuple(r)) for r in df.select("node", "t", F.sum("x").over(w), F.row_number().over(w), F.last("x", True).over(w)).collect()
    )
    assert len(want) == len(rows)
    counted = series.run_counters(df, ["node"], "t", F.col("x") > 2, run="run", since={"since": F.col("x") > 2})
    assert counted.count() == len(rows)
    assert series.elapsed_since(df, ["node"], "t", {"hours": F.col("x") > 2}).count() == len(rows)
    spell = series.spells(df, ["node"], "t", F.col("x") >= 0).groupBy("node").agg(F.sum("spell_rows")).collect()
    assert sorted((r[0] or "", r[1]) for r in spell) == [("", 2), ("a", 5)]
