"""Shards: every row once, even counts, even mixtures, gapless slots."""

import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from gridlens.llm import ranks, sharding
from gridlens.session import stage


@pytest.mark.parametrize("part", [200_000, 40])
def test_interleave(spark, monkeypatch, part):
    monkeypatch.setattr(ranks, "PART_ROWS", part)
    rows = [(i, f"text {i} é", "big" if i % 3 == 0 else f"s{i % 7}", 0) for i in range(700)]
    rows += [(None, None, None, 1), (None, "", "", 1), (5, rows[5][1], rows[5][2], 1), (5, rows[5][1], rows[5][2], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int")
    got = sharding.interleave(df, 24).collect()
    assert Counter((r.doc_id, r.source, r.size, r.text_crc32) for r in got) == Counter(
        (k, s, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, s, _ in rows
    )
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(24))
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    total = Counter(r.source for r in got)
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        mine = Counter(r.source for r in members)
        assert all(abs(mine[s] - total[s] * len(members) / len(rows)) <= 2 for s in total)
    again = sharding.interleave(df, 24).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    other = {(r.doc_id, r.shard, r.slot) for r in sharding.interleave(df, 24, seed=8).collect()}
    assert len(other & {(r.doc_id, r.shard, r.slot) for r in got}) < 60


def test_ranges_of_hot_keys(spark):
    """Rows without key, one repeated key and sources of one row each: no range holds many more rows than others."""
    rows = spark.range(24_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, 5).alias("doc_id"), F.lit("same").alias("text"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), "id")).otherwise("big").alias("source"),
    )
    placed = stage(rows.select(F.lit(0).alias("g"), F.lit(0.5).alias("f"), "source", F.monotonically_increasing_id().alias("row")), "hot")
    seen = []

    def kept(df, label, **how):
        seen.append((label, df))
        return stage(df, label, **how)

    ranks.stage, before = kept, ranks.stage
    try:
        out = ranks.numbered(placed, "g", ["f", "source", "row"], "hot", 1000)
    finally:
        ranks.stage = before
    assert sorted(r.pos for r in out.select("pos").collect()) == list(range(24_000))
    sizes = [r["count"] for r in dict(seen)["hot-order"].groupBy("_part").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 4000
    got = sharding.interleave(rows, 24).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.count_distinct("slot").alias("d")).collect()
    assert all((r.n, r.top, r.d) == (1000, 999, 1000) for r in got) and len(got) == 24


def test_small(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "x")], "doc_id long, text string, source string")
    assert [r.slot for r in sharding.interleave(df, 24).collect()] == [0, 0]
    assert sharding.interleave(df.limit(0), 24).count() == 0
