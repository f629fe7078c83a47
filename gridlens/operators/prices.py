"""Day-ahead against real-time prices: join, regimes, run lengths, missing hours, events."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.labels import EXTREME, EXTREME_PRICE, REGIMES, SCARCITY_REGIMES, price_regime
from gridlens.functions.numbers import no_nan
from gridlens.functions.timeparts import day_floor, in_window, iso_weekday
from gridlens.operators.distribution import exact_quantiles
from gridlens.operators.quality import any_null, latest_per_key
from gridlens.operators.series import DEFAULT_CHUNK, elapsed_since, run_counters

KEYS = ["node", "start_time"]


def dart_table(da: DataFrame, rt: DataFrame, newest_by: Sequence[str] | None = None) -> DataFrame:
    """Full join of DA and RT prices on (node, start_time), one row per key and side.

    Inputs carry ``node, start_time, lmp``. Of several rows of a key the one with the greatest
    ``newest_by`` (such as a load time) stays; without it, one that has a price. Keys are
    coalesced, so an hour seen on one side only keeps its node, time and calendar parts.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        priced = df.withColumn("lmp", no_nan(F.col("lmp")))
        one = latest_per_key(priced, KEYS, newest_by or ["lmp"])
        return one.select(*KEYS, F.col("lmp").alias(name))

    left, right = side(da, "lmp_da_exante"), side(rt, "lmp_rt_expost")
    return left.join(right, KEYS, "full").select(
        *KEYS,
        "lmp_da_exante",
        "lmp_rt_expost",
        (F.col("lmp_rt_expost") - F.col("lmp_da_exante")).alias("lmp_dart_spread"),
        F.month("start_time").alias("month"),
        F.year("start_time").alias("year"),
        iso_weekday(F.col("start_time")).alias("day_of_week"),
    )


def missing_by_day(dart: DataFrame) -> DataFrame:
    """Hours per day on which either price is missing."""
    gaps = dart.where(any_null(["lmp_da_exante", "lmp_rt_expost"]))
    return gaps.groupBy(day_floor(F.col("start_time")).alias("date")).agg(
        F.count(F.lit(1)).alias("missing_count")
    )


def with_regime(dart: DataFrame) -> DataFrame:
    return dart.withColumn("regime", price_regime(F.col("lmp_da_exante"), F.col("lmp_rt_expost")))


def with_regime_durations(df: DataFrame, elapsed: bool = False, chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Rows in the current regime, since the last extreme event, and since any scarcity.

    With ``elapsed`` the two ``hours_since`` columns measure time instead of counting rows.
    """
    since = {
        "hours_since_extreme": F.col("regime") == EXTREME,
        "hours_since_scarcity": F.col("regime").isin(*SCARCITY_REGIMES),
    }
    counted = run_counters(
        df, ["node"], "start_time", F.col("regime"), run="consecutive_regime_hours",
        since={} if elapsed else since, chunk=chunk,
    )
    return elapsed_since(counted, ["node"], "start_time", since, chunk=chunk) if elapsed else counted


def regime_shares(df: DataFrame) -> DataFrame:
    """Rows and share of rows per regime, from one pass without a shuffle of rows."""
    totals = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col("regime") == r).alias(r) for r in REGIMES]
    )
    long = totals.unpivot("_rows", list(REGIMES), "regime", "count").where(F.col("count") > 0)
    return long.select("regime", "count", (F.col("count") / F.col("_rows")).alias("share"))


def regime_duration_stats(durations: DataFrame) -> DataFrame:
    """Statistics of the running counter, and of completed run lengths, per node and regime.

    The last counter value of a run is its length: runs of length L contain the counter
    values 1..L, so the number of runs with length at least k is the number of rows with
    counter k, and lengths need no second look at row order.
    """
    keys = ["node", "regime"]
    counter = "consecutive_regime_hours"
    basic = durations.groupBy(*keys).agg(
        F.avg(counter).alias("avg_duration"),
        F.max(counter).alias("max_duration"),
        F.count_if(F.col(counter) == 1).alias("runs"),
        (F.count(F.lit(1)) / F.count_if(F.col(counter) == 1)).alias("avg_run_length"),
    )
    middle = exact_quantiles(durations, keys, counter, {"median_duration": 0.5})
    return basic.join(middle, keys)


def duration_matrix(durations: DataFrame) -> DataFrame:
    """Average duration by node with one column per regime, rounded to one digit."""
    counter = F.col("consecutive_regime_hours")
    return durations.groupBy("node").agg(
        *[F.round(F.avg(F.when(F.col("regime") == r, counter)), 1).alias(r) for r in REGIMES]
    )


def longest_runs(durations: DataFrame, top: int | None = None) -> DataFrame:
    """The longest run of each node and regime, longest first; with ``top`` only so many.

    Ties inside a group go to the earliest hour; ties in the ranking go by node and regime.
    """
    counter = "consecutive_regime_hours"
    best = durations.groupBy("node", "regime").agg(
        F.min_by(F.struct("start_time", counter), F.struct(-F.col(counter), "start_time")).alias("_best")
    )
    ordered = best.select("node", "regime", "_best.*").orderBy(F.desc(counter), "node", "regime")
    return ordered if top is None else ordered.limit(top)


def event_window(df: DataFrame, start: date, end: date, nodes: Sequence[str] | None = None) -> DataFrame:
    """Half-open date slice with the scarcity mask used for shading; all nodes by default."""
    rows = df.where(in_window(F.col("start_time"), start, end))
    if nodes is not None:
        rows = rows.where(F.col("node").isin(*nodes))
    mask = F.coalesce(F.col("lmp_rt_expost") > EXTREME_PRICE, F.lit(False))
    return rows.withColumn("scarcity", mask)
