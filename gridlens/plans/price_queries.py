"""Queries over prices, regimes, fuel mix and the combined set."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.labels import REGIMES, SCARCITY_REGIMES
from gridlens.operators import fuel as fuels
from gridlens.operators import prices
from gridlens.operators.distribution import equal_width_histogram, profile
from gridlens.plans.bindings import (
    ALL,
    DA,
    RT,
    event_fuel,
    event_prices,
    event_weather,
    sql,
)
from gridlens.plans.combined import combined_dataset, node_hours, write_combined
from gridlens.plans.registry import bin_sql, query, r, rounded
from gridlens.session import scratch_dir, stage, stage_all
from gridlens.sources.tables import read_window

# Percentiles of the price profile and the high-price cut.
PERCENTILES = (0.01, 0.03, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.97, 0.99)
HIGH_PRICE = 100

PRICE_COLUMNS = ("lmp_da_exante", "lmp_rt_expost", "lmp_dart_spread")
EVENT_START, EVENT_END = date(2024, 1, 13), date(2024, 1, 19)


def dart(spark, sf_dir) -> DataFrame:
    return prices.dart_table(event_prices(spark, sf_dir, DA), event_prices(spark, sf_dir, RT))


def stored_dart(spark, sf_dir) -> DataFrame:
    """Stored price table for operators that look at it more than once."""
    return stage(dart(spark, sf_dir), "dart")


def durations(spark, sf_dir) -> DataFrame:
    return prices.with_regime_durations(prices.with_regime(stored_dart(spark, sf_dir)))


def fuel_pair(spark, sf_dir) -> DataFrame:
    return fuels.fuel_mix_compare(event_fuel(spark, sf_dir, DA), event_fuel(spark, sf_dir, RT))


def hourly_tables(spark, sf_dir) -> dict[str, DataFrame]:
    """Stored price, weather and fuel tables of the market."""
    return stage_all(
        dart=dart(spark, sf_dir), weather=event_weather(spark, sf_dir), fuel=fuel_pair(spark, sf_dir)
    )


def features(spark, sf_dir) -> DataFrame:
    """Regimes with weather and fuel features per node hour."""
    return node_hours(**hourly_tables(spark, sf_dir))


@query(
    "dart",
    sql("dart", f"""SELECT node, start_time, lmp_da_exante, lmp_rt_expost, {r('lmp_dart_spread')} AS lmp_dart_spread,
 month(start_time)::INTEGER AS month, year(start_time)::INTEGER AS year, isodow(start_time)::INTEGER AS day_of_week
 FROM dart"""),
)
def dart_query(spark, sf_dir):
    """Full join of day-ahead and real-time prices with spread and calendar parts."""
    return rounded(dart(spark, sf_dir), keep=("lmp_da_exante", "lmp_rt_expost"))


@query(
    "missing_by_day",
    sql("dart", """SELECT date_trunc('day', start_time)::TIMESTAMP AS date, count(*) AS missing_count FROM dart
 WHERE lmp_da_exante IS NULL OR lmp_rt_expost IS NULL GROUP BY 1"""),
)
def missing_by_day(spark, sf_dir):
    """Hours per day with a missing price."""
    return prices.missing_by_day(dart(spark, sf_dir))


def _profile_sql() -> str:
    marks = ", ".join(f"{r(f'quantile_cont(x, {p})')} AS p{int(round(p * 100)):02d}" for p in PERCENTILES)
    return f"""SELECT metric, count(x) AS count, count(*) - count(x) AS null_count, {r('avg(x)')} AS mean,
 {r('stddev_samp(x)')} AS std, {r('min(x)')} AS min, {r('max(x)')} AS max, {marks} FROM
 (SELECT {', '.join(PRICE_COLUMNS)} FROM dart) UNPIVOT INCLUDE NULLS (x FOR metric IN ({', '.join(PRICE_COLUMNS)}))
 GROUP BY metric"""


@query("profile_percentiles", sql("dart", _profile_sql()))
def profile_percentiles(spark, sf_dir):
    """Profile of the three price columns with eleven exact percentiles."""
    marks = {f"p{int(round(p * 100)):02d}": p for p in PERCENTILES}
    return rounded(profile(stored_dart(spark, sf_dir), PRICE_COLUMNS, marks))


def _histogram_sql(source: str, bins: int, density: bool = False) -> str:
    extra = f", {r('count / (n * w)', 8)} AS density" if density else ""
    return f"""SELECT bin, {r('lo + bin * w')} AS bin_left, {r('lo + bin * w + w')} AS bin_right,
 {r('lo + bin * w + w / 2')} AS bin_center, count{extra} FROM
 (SELECT bin, any_value(lo) AS lo, any_value((hi - lo) / {bins}) AS w, any_value(n) AS n, count(*) AS count FROM
 (SELECT *, {bin_sql('x', 'lo', 'hi', bins)} AS bin FROM
 (SELECT x, min(x) OVER () AS lo, max(x) OVER () AS hi, count(*) OVER () AS n FROM ({source}))) GROUP BY bin)"""


@query("histogram", sql("dart", _histogram_sql("SELECT lmp_dart_spread AS x FROM dart WHERE lmp_dart_spread IS NOT NULL", 100)))
def histogram(spark, sf_dir):
    """Spread histogram with 100 equal bins."""
    return rounded(equal_width_histogram(stored_dart(spark, sf_dir), "lmp_dart_spread", 100))


@query(
    "threshold_subset",
    sql("dart", _histogram_sql(
        f"SELECT lmp_dart_spread AS x FROM dart WHERE lmp_dart_spread IS NOT NULL AND lmp_da_exante > {HIGH_PRICE}", 50)),
)
def threshold_subset(spark, sf_dir):
    """Spread histogram of the hours with a high day-ahead price."""
    high = stored_dart(spark, sf_dir).where(F.col("lmp_da_exante") > HIGH_PRICE)
    return rounded(equal_width_histogram(high, "lmp_dart_spread", 50))


@query(
    "regimes",
    sql("regimes", f"""SELECT regime, count(*) AS count, {r('count(*) / sum(count(*)) OVER ()')} AS share
 FROM regimes GROUP BY regime"""),
)
def regimes(spark, sf_dir):
    """Rows and share per regime."""
    return rounded(prices.regime_shares(prices.with_regime(dart(spark, sf_dir))))


@query(
    "regime_sets",
    sql("regimes", """SELECT node, count(*) FILTER (WHERE regime IN ('Normal Operations', 'Moderate Stress',
 'Over-Generation')) AS normal_hours, count(*) FILTER (WHERE regime NOT IN ('Normal Operations', 'Moderate Stress',
 'Over-Generation')) AS tail_hours FROM regimes GROUP BY node"""),
)
def regime_sets(spark, sf_dir):
    """Normal and tail hours per node by regime membership."""
    tail = F.col("regime").isin(*SCARCITY_REGIMES)
    return prices.with_regime(dart(spark, sf_dir)).groupBy("node").agg(
        F.count_if(~tail).alias("normal_hours"), F.count_if(tail).alias("tail_hours")
    )


COUNTERS = ("consecutive_regime_hours", "hours_since_extreme", "hours_since_scarcity")


@query("regime_durations", sql("durations", f"SELECT node, start_time, regime, {', '.join(COUNTERS)} FROM durations"))
def regime_durations(spark, sf_dir):
    """Run position and hours since the last extreme and scarcity events."""
    return durations(spark, sf_dir).select(
        "node", "start_time", "regime", *[F.col(c).cast("long").alias(c) for c in COUNTERS]
    )


@query(
    "regime_elapsed",
    sql("durations", """SELECT node, start_time, date_diff('hour', coalesce(max(CASE WHEN regime = 'Extreme Event' THEN start_time END)
 OVER w, min(start_time) OVER w), start_time) AS hours_since_extreme,
 date_diff('hour', coalesce(max(CASE WHEN regime IN ('Extreme Event', 'False Scarcity', 'Anticipated Scarcity',
 'Unanticipated Scarcity') THEN start_time END) OVER w, min(start_time) OVER w), start_time) AS hours_since_scarcity
 FROM durations WINDOW w AS (PARTITION BY node ORDER BY start_time ROWS UNBOUNDED PRECEDING)"""),
)
def regime_elapsed(spark, sf_dir):
    """Hours by the clock since the last extreme and scarcity events."""
    rows = prices.with_regime_durations(prices.with_regime(stored_dart(spark, sf_dir)), elapsed=True)
    return rows.select("node", "start_time", "hours_since_extreme", "hours_since_scarcity")


@query(
    "regime_duration_stats",
    sql("durations", f"""SELECT node, regime, {r('avg(consecutive_regime_hours)')} AS avg_duration,
 max(consecutive_regime_hours) AS max_duration, {r('median(consecutive_regime_hours)')} AS median_duration,
 count(*) FILTER (WHERE consecutive_regime_hours = 1) AS runs,
 {r('count(*) / count(*) FILTER (WHERE consecutive_regime_hours = 1)')} AS avg_run_length
 FROM durations GROUP BY node, regime"""),
)
def regime_duration_stats(spark, sf_dir):
    """Duration statistics per node and regime."""
    stats = rounded(prices.regime_duration_stats(stage(durations(spark, sf_dir), "durations")))
    return stats.withColumn("max_duration", F.col("max_duration").cast("long"))


@query(
    "duration_matrix",
    sql("durations", "SELECT node, " + ", ".join(
        f"{r(f'''avg(consecutive_regime_hours) FILTER (WHERE regime = '{x}')''', 1)} AS \"{x}\"" for x in REGIMES
    ) + " FROM durations GROUP BY node"),
)
def duration_matrix(spark, sf_dir):
    """Average duration by node, one column per regime."""
    return rounded(prices.duration_matrix(durations(spark, sf_dir)))


@query(
    "longest_runs",
    sql("durations", """SELECT node, regime, start_time, consecutive_regime_hours FROM
 (SELECT *, row_number() OVER (PARTITION BY node, regime ORDER BY consecutive_regime_hours DESC, start_time) AS k
 FROM durations) WHERE k = 1 ORDER BY consecutive_regime_hours DESC, node, regime LIMIT 10"""),
)
def longest_runs(spark, sf_dir):
    """Ten longest runs over the longest run of each node and regime."""
    top = prices.longest_runs(durations(spark, sf_dir), 10)
    return top.withColumn("consecutive_regime_hours", F.col("consecutive_regime_hours").cast("long"))


def _fuel_columns() -> str:
    exact = [f"{n}_{s}" for n in fuels.FUELS for s in ("DA", "RT")]
    derived = [f"{n}_{s}" for n in fuels.FUELS for s in ("Diff", "PctDiff")]
    return ", ".join(exact + [f"{r(c)} AS {c}" for c in derived] + list(fuels.FLAGS))


@query("fuel_compare", sql("fuel", f"SELECT start_time, {_fuel_columns()} FROM fuel"))
def fuel_compare(spark, sf_dir):
    """Day-ahead against real-time fuel mix with miss and low flags."""
    return rounded(fuels.with_fuel_flags(stage(fuel_pair(spark, sf_dir), "fuel")).drop("region"))


@query(
    "regime_by_temperature",
    sql("node_hours", "SELECT TemperatureBucket, " + ", ".join(
        f'{r(f"100.0::DOUBLE * \"{n}\" / total", 2)} AS "{n}"' for n in (*REGIMES, *fuels.FLAGS)
    ) + " FROM (SELECT *, " + " + ".join(f'"{n}"' for n in (*REGIMES, *fuels.FLAGS)) + """ AS total FROM
 (SELECT TemperatureBucket, """ + ", ".join(
        [f"count(*) FILTER (WHERE regime = '{n}') AS \"{n}\"" for n in REGIMES]
        + [f'count(*) FILTER (WHERE {n} = 1) AS "{n}"' for n in fuels.FLAGS]
    ) + " FROM node_hours WHERE TemperatureBucket IS NOT NULL GROUP BY 1))"),
)
def regime_by_temperature(spark, sf_dir):
    """Percent of regimes and flags per temperature bucket."""
    return rounded(fuels.regime_by_temperature(features(spark, sf_dir)))


def _mix_sql() -> str:
    avgs = ", ".join(f"avg({f}MW_RT) AS a{f}" for f in fuels.MIX)
    total = " + ".join(f"a{f}" for f in fuels.MIX)
    shown = ", ".join(f"{r(f'a{f}')} AS avg_{f}MW_RT" for f in fuels.MIX)
    pcts = ", ".join(f"{r(f'a{f} / total * 100', 2)} AS {f}Pct_RT" for f in fuels.MIX)
    return f"""SELECT TemperatureBucket, {shown}, {r('total')} AS TotalAvgMW_RT, {pcts}, {r('scarcity')} AS ScarcityPct
 FROM (SELECT *, {total} AS total FROM (SELECT TemperatureBucket, {avgs}, 100.0::DOUBLE * avg((regime IN
 ('Extreme Event', 'False Scarcity', 'Anticipated Scarcity', 'Unanticipated Scarcity'))::INTEGER) AS scarcity
 FROM node_hours WHERE TemperatureBucket IS NOT NULL GROUP BY 1))"""


@query("fuel_mix_by_temperature", sql("node_hours", _mix_sql()))
def fuel_mix_by_temperature(spark, sf_dir):
    """Average fuel mix, its percentages and scarcity share per temperature bucket."""
    return rounded(fuels.fuel_mix_by_temperature(features(spark, sf_dir)))


@query(
    "pct_of_seasonal_avg",
    sql("fuel_rt", f"""SELECT start_time, wind, {r('wind / (SELECT avg(wind) FROM fuel_rt WHERE month(start_time) IN (12, 1, 2)) * 100', 2)}
 AS WindPct FROM fuel_rt"""),
)
def pct_of_seasonal_avg(spark, sf_dir):
    """Wind output in percent of its winter mean."""
    mix = stage(event_fuel(spark, sf_dir, RT).select("start_time", "wind"), "wind")
    return rounded(fuels.pct_of_seasonal_avg(mix, "wind", "WindPct"))


_COMBINED = ("node", "start_time", "lmp_da_exante", "lmp_rt_expost", "lmp_da_expost", "regime",
             *COUNTERS, "Temperature", "WindSpeed", "TemperatureBucket", *fuels.FLAGS)


@query(
    "combined_dataset",
    sql("node_hours expost", f"""SELECT n.node, n.start_time, lmp_da_exante, lmp_rt_expost, e.lmp AS lmp_da_expost, regime,
 {', '.join(COUNTERS)}, Temperature, WindSpeed, TemperatureBucket, {', '.join(fuels.FLAGS)},
 {r('lmp_dart_spread')} AS lmp_dart_spread, {r('WindSpeedVolatility6h')} AS WindSpeedVolatility6h,
 {r('GasMW_PctDiff')} AS GasMW_PctDiff,
 {r('WindMW_RT / (SELECT avg(WindMW_RT) FROM node_hours WHERE month(start_time) IN (12, 1, 2)) * 100', 2)} AS WindMW_RT_PctOfSeasonalAvg
 FROM node_hours n LEFT JOIN expost e ON e.node = n.node AND e.start_time = n.start_time"""),
)
def combined_query(spark, sf_dir):
    """The combined analysis set."""
    rows = combined_dataset(expost=event_prices(spark, sf_dir, ALL), **hourly_tables(spark, sf_dir))
    picked = rows.select(
        *_COMBINED, "lmp_dart_spread", "WindSpeedVolatility6h", "GasMW_PctDiff", "WindMW_RT_PctOfSeasonalAvg"
    ).withColumns({c: F.col(c).cast("long") for c in COUNTERS})
    exact = ("lmp_da_exante", "lmp_rt_expost", "lmp_da_expost", "Temperature", "WindSpeed")
    return rounded(picked, keep=exact)


@query(
    "combined_table",
    sql("node_hours expost", f"""SELECT n.node, n.start_time, regime, e.lmp AS lmp_da_expost, Temperature, {r('WindMW_RT')} AS WindMW_RT,
 year(n.start_time)::INTEGER AS year, month(n.start_time)::INTEGER AS month, day(n.start_time)::INTEGER AS day,
 (SELECT count(*) FROM node_hours) AS rows_written
 FROM node_hours n LEFT JOIN expost e ON e.node = n.node AND e.start_time = n.start_time
 WHERE n.start_time >= '2024-01-13' AND n.start_time < '2024-01-19'"""),
)
def combined_table(spark, sf_dir):
    """The combined set stored by day, and the days of an event read back from it."""
    path = scratch_dir(spark, "combined-table")
    written = write_combined(combined_dataset(expost=event_prices(spark, sf_dir, ALL), **hourly_tables(spark, sf_dir)), path)
    rows = read_window(spark, path, "start_time", EVENT_START, EVENT_END).select(
        "node", "start_time", "regime", "lmp_da_expost", "Temperature", "WindMW_RT", "year", "month", "day",
        F.lit(written).cast("long").alias("rows_written"),
    )
    return rounded(rows, keep=("lmp_da_expost", "Temperature"))


@query(
    "event_window",
    sql("regimes", """SELECT node, start_time, lmp_da_exante, lmp_rt_expost, regime, coalesce(lmp_rt_expost > 180, FALSE) AS scarcity
 FROM regimes WHERE start_time >= '2024-01-13' AND start_time < '2024-01-19'"""),
)
def event_window(spark, sf_dir):
    """Hours of an event with the scarcity mask."""
    rows = prices.with_regime(dart(spark, sf_dir))
    return prices.event_window(rows, EVENT_START, EVENT_END).select(
        "node", "start_time", "lmp_da_exante", "lmp_rt_expost", "regime", "scarcity"
    )


_NODES = ("click", "signup")


@query(
    "event_window_nodes",
    sql("regimes", f"""SELECT node, start_time, lmp_da_exante, lmp_rt_expost, coalesce(lmp_rt_expost > 180, FALSE) AS scarcity
 FROM regimes WHERE start_time >= '2024-01-13' AND start_time < '2024-01-19' AND node IN {_NODES}"""),
)
def event_window_nodes(spark, sf_dir):
    """Hours of an event at some nodes."""
    rows = prices.event_window(dart(spark, sf_dir), EVENT_START, EVENT_END, _NODES)
    return rows.select("node", "start_time", "lmp_da_exante", "lmp_rt_expost", "scarcity")
