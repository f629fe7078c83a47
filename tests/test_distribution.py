"""Quantiles, histograms, ECDF and profiles against NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.operators import distribution as d


def frame(spark, groups):
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    return spark.createDataFrame(rows, "k string, x double")


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(11)
    return {
        "hot": [round(rng.gauss(0, 30), 2) for _ in range(3000)] + [1e9, -4e7],
        "ties": [5.0] * 900 + [float(i % 7) for i in range(400)],
        "offset": [1e6 + rng.random() for _ in range(500)],
        "one": [2.5],
        "two": [1.0, 2.0],
    }


PROBS = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p97": 0.97, "top": 1.0, "low": 0.0}


def test_quantiles_match_numpy(spark, groups):
    out = d.exact_quantiles(frame(spark, groups), ["k"], "x", PROBS, slices=64).collect()
    assert {r.k for r in out} == set(groups)
    for row in out:
        for name, p in PROBS.items():
            assert row[name] == pytest.approx(np.percentile(groups[row.k], p * 100), rel=1e-12, abs=1e-12)


def test_quantile_does_not_depend_on_slices(spark, groups):
    df = frame(spark, groups)
    results = [
        sorted(map(tuple, d.exact_quantiles(df, ["k"], "x", PROBS, slices=s).collect())) for s in (1, 7, 4096)
    ]
    assert results[0] == results[1] == results[2]


def test_nearest_rank_and_fixture(spark):
    values = [1.0, 2.0, 2.5, 4.0, 9.0, -30.0, 5.5, 7.0]
    df = frame(spark, {"a": values})
    assert d.exact_quantiles(df, [], "x", {"q": 0.25}, "nearest").first().q == 2.0
    row = d.exact_quantiles(df, [], "x", {"q": 0.25, "lo": 0.05, "hi": 0.95, "mid": 0.5}).first()
    assert row.q == 1.75
    assert row.lo == pytest.approx(-19.15)
    assert row.hi == pytest.approx(8.3)
    assert row.mid == 3.25


def test_missing_values_are_ignored(spark):
    df = spark.createDataFrame(
        [("a", None), ("a", float("nan")), ("a", 1.0), ("a", 3.0), ("b", None)], "k string, x double"
    )
    out = d.exact_quantiles(df, ["k"], "x", {"m": 0.5}).collect()
    assert [(r.k, r.m) for r in out] == [("a", 2.0)]
    assert d.exact_quantiles(df.where("k = 'b'"), [], "x", {"m": 0.5}).count() == 0
    with pytest.raises(ValueError):
        d.exact_quantiles(df, ["k"], "x", {"m": 0.5}, "median")


def test_histogram_matches_numpy(spark, groups):
    keep = {k: groups[k] for k in ("ties", "offset", "one")}
    out = d.equal_width_histogram(frame(spark, keep), "x", 20, ["k"], density=True, include_empty=True)
    for k, values in keep.items():
        rows = sorted(out.where(F.col("k") == k).collect(), key=lambda r: r.bin)
        counts, edges = np.histogram(values, bins=20)
        assert [r["count"] for r in rows] == list(counts)
        assert [r.bin_left for r in rows] == pytest.approx(list(edges[:-1]))
        assert [r.bin_center for r in rows] == pytest.approx(list((edges[:-1] + edges[1:]) / 2))
        assert [r.density for r in rows] == pytest.approx(list(np.histogram(values, bins=20, density=True)[0]))


def test_histogram_lists_only_filled_bins(spark):
    out = d.equal_width_histogram(frame(spark, {"a": [0.0, 10.0, 10.0]}), "x", 10).collect()
    assert sorted((r.bin, r["count"]) for r in out) == [(0, 1), (9, 2)]


def test_ecdf_ranks_ties_apart(spark):
    out = d.empirical_cdf(frame(spark, {"a": [1.0, 1.0, 2.0]}), ["k"], "x").collect()
    assert sorted((r.x, r["rank"], round(r.cdf, 6)) for r in out) == [
        (1.0, 1, 0.333333), (1.0, 2, 0.666667), (2.0, 3, 1.0)
    ]


def test_ecdf_of_skewed_groups(spark, groups):
    out = d.empirical_cdf(frame(spark, groups), ["k"], "x", slices=16, step=64)
    for k, values in groups.items():
        rows = sorted((r["rank"], r.x) for r in out.where(F.col("k") == k).collect())
        assert rows == list(enumerate(sorted(values), start=1))
    assert out.groupBy("k").agg(F.max("cdf").alias("m")).where("m = 1").count() == len(groups)


def test_profile_and_box(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0), (6.0, 8.0)], "a double, b double")
    out = {r.metric: r for r in d.profile(df, ["a", "b"], {"p50": 0.5}).collect()}
    assert (out["a"]["count"], out["a"].null_count, out["a"].p50) == (3, 0, 2.0)
    assert (out["b"]["count"], out["b"].null_count, out["b"].p50) == (2, 1, 6.0)
    assert out["a"].std == pytest.approx(2.6457513110645907)
    box = d.box_summary(frame(spark, {"a": [1.0, 2.0, 3.0, 4.0]}), ["k"], "x").first()
    assert (box["min"], box.q1, box.median, box.q3, box["max"], box["count"]) == (1.0, 1.75, 2.5, 3.25, 4.0, 4)


def test_histogram_bins_follow_the_edges(spark):
    """Hundredths from 0 to 1 in 100 bins, as NumPy puts them."""
    from gridlens.operators.distribution import equal_width_histogram

    values = [i / 100 for i in range(101)]
    df = spark.createDataFrame([(v,) for v in [*values, float("inf"), float("-inf"), None]], "x double")
    got = {r.bin: r["count"] for r in equal_width_histogram(df, "x", 100, include_empty=True).collect()}
    assert [got[i] for i in range(100)] == np.histogram(values, 100)[0].tolist()


def test_null_groups_and_infinities(spark):
    from gridlens.operators.distribution import box_summary, empirical_cdf, equal_width_histogram, exact_quantiles

    inf = float("inf")
    rows = [("a", 1.0), ("a", 2.0), ("a", inf), (None, 5.0), (None, 7.0), (None, -inf), ("b", inf), ("b", inf)]
    df = spark.createDataFrame(rows, "g string, x double")
    medians = {r.g: r.m for r in exact_quantiles(df, ["g"], "x", {"m": 0.5}).collect()}
    assert medians == {"a": 2.0, None: 5.0, "b": inf}
    ranks = sorted((r.g or "", r.x, r.rank) for r in empirical_cdf(df, ["g"], "x").collect())
    assert ranks == [("", -inf, 1), ("", 5.0, 2), ("", 7.0, 3), ("a", 1.0, 1), ("a", 2.0, 2), ("a", inf, 3), ("b", inf, 1), ("b", inf, 2)]
    boxes = {r.g: (r.min, r.median, r["count"]) for r in box_summary(df, ["g"], "x").collect()}
    assert boxes == {"a": (1.0, 2.0, 3), None: (-inf, 5.0, 3), "b": (inf, inf, 2)}
    counts = {}
    for r in equal_width_histogram(df, "x", 2, ["g"]).collect():
        counts[r.g] = counts.get(r.g, 0) + r["count"]
    assert counts == {"a": 2, None: 2}
