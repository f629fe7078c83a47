"""Queries over transmission rights and tail risk."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.numbers import ratio
from gridlens.functions.timeparts import hourly_calendar, is_winter, market_class, winter_season, with_partition_parts
from gridlens.operators import rights, risk
from gridlens.operators.distribution import empirical_cdf, equal_width_histogram
from gridlens.plans.bindings import (
    AUCTION_SEASON,
    BACKFILLED,
    EVENT_SEASON,
    HISTORY_END,
    part_auction,
    season_prices,
    season_weather,
    sql,
    table,
)
from gridlens.plans.registry import bin_sql, query, r, rounded
from gridlens.session import scratch_dir, stage
from gridlens.sinks.tables import overwrite_table

EVENT_START, EVENT_END = date(1999, 1, 10), date(1999, 1, 25)
GROUP = ["Source", "Sink", "Class"]
MW, HOURS = 77, 1008


def calendar(spark, sf_dir) -> DataFrame:
    """Every hour from the winter before the first line item to the winter after the last."""
    day = F.col("l_shipdate")
    span = table(spark, sf_dir, "lineitem").agg(
        F.make_date(F.year(F.min(day)) - 1, F.lit(12), F.lit(1)).alias("first"),
        F.date_sub(F.make_date(F.year(F.max(day)) + 1, F.lit(3), F.lit(1)), 1).alias("last"),
    )
    return hourly_calendar(span, "first", "last")


def positions(spark, sf_dir) -> DataFrame:
    return rights.weighted_positions(part_auction(spark, sf_dir))


def held(spark, sf_dir) -> DataFrame:
    return rights.backfill_positions(positions(spark, sf_dir), AUCTION_SEASON, BACKFILLED)


def stored_prices(spark, sf_dir) -> DataFrame:
    """Stored winter hours of the prices: source and sink side read the small table, not the line items."""
    return stage(season_prices(spark, sf_dir).where(is_winter(F.col("start_time"))), "season-prices")


def pnl(spark, sf_dir) -> DataFrame:
    hours = rights.class_hours(calendar(spark, sf_dir))
    return rights.hourly_pnl(held(spark, sf_dir), stored_prices(spark, sf_dir), hours)


def pnl_with_weather(spark, sf_dir) -> DataFrame:
    return pnl(spark, sf_dir).join(season_weather(spark, sf_dir), "start_time", "left")


def spreads(spark, sf_dir) -> DataFrame:
    paths = part_auction(spark, sf_dir).select("Source", "Sink").distinct()
    return rights.path_spreads(stored_prices(spark, sf_dir), paths)


def history(spark, sf_dir) -> DataFrame:
    """Spreads before the event season, stored because their users look more than once."""
    return stage(spreads(spark, sf_dir).where(F.col("WinterYear") < HISTORY_END), "history")


def samples(spark, sf_dir) -> DataFrame:
    """Stored spreads of history and event season, told apart by ``sample``."""
    season = F.col("WinterYear")
    name = F.when(season < HISTORY_END, "hist").when(season == EVENT_SEASON, "event")
    return stage(spreads(spark, sf_dir).withColumn("sample", name).where(F.col("sample").isNotNull()), "samples")


@query(
    "class_hours",
    sql("class_hours winter_prices", """SELECT WinterYear, Class, ClassHours, coalesce(observed, 0) AS observed FROM class_hours
 LEFT JOIN (SELECT WinterYear, Class, count(*) AS observed FROM winter_prices GROUP BY ALL) USING (WinterYear, Class)"""),
)
def class_hours(spark, sf_dir):
    """Peak and off-peak hours per season of the data, with the node hours observed in each."""
    ts = F.col("start_time")
    seen = season_prices(spark, sf_dir).where(is_winter(ts)).groupBy(
        winter_season(ts).alias("WinterYear"), market_class(ts).alias("Class")
    ).agg(F.count(F.lit(1)).alias("observed"))
    hours = rights.class_hours(calendar(spark, sf_dir))
    return hours.join(seen, ["WinterYear", "Class"], "left").fillna(0, ["observed"])


_POSITION = "Source, Sink, StartDate, EndDate, Type, Class, MW"


@query(
    "ftr_positions",
    sql("positions", f"SELECT {_POSITION}, {r('ClearingPrice')} AS ClearingPrice, WinterYear FROM positions"),
)
def ftr_positions(spark, sf_dir):
    """Positions with total MW and weighted price."""
    return rounded(positions(spark, sf_dir))


@query(
    "backfill_positions",
    sql("held", f"SELECT {_POSITION}, {r('ClearingPrice')} AS ClearingPrice, WinterYear FROM held"),
)
def backfill_positions(spark, sf_dir):
    """Positions with copies for seasons without an auction."""
    return rounded(held(spark, sf_dir))


@query(
    "top_positions",
    sql("positions", f"""SELECT {_POSITION}, {r('ClearingPrice')} AS ClearingPrice, WinterYear FROM positions
"""),
)
def top_positions(spark, sf_dir):
    """All positions, the largest first."""
    order = [F.desc("MW"), "Source", "Sink", "StartDate", "Type", "Class"]
    return rounded(positions(spark, sf_dir).orderBy(*order))


@query(
    "ftr_hourly_pnl",
    sql("pnl", f"""SELECT Source, Sink, Class, Type, WinterYear, start_time, MW, ClassHours, {r('PriceSpread')} AS PriceSpread,
 {r('HourlyCost')} AS HourlyCost, {r('HourlyCongestionRevenue')} AS HourlyCongestionRevenue,
 {r('HourlyProfitLoss')} AS HourlyProfitLoss, {r('TotalCost', 4)} AS TotalCost FROM pnl"""),
)
def ftr_hourly_pnl(spark, sf_dir):
    """Hourly spread, cost, revenue and profit of every position."""
    rows = pnl(spark, sf_dir).select(
        "Source", "Sink", "Class", "Type", "WinterYear", "start_time", "MW", "ClassHours", "PriceSpread",
        "HourlyCost", "HourlyCongestionRevenue", "HourlyProfitLoss",
        (F.round("TotalCost", 4) + F.lit(0.0)).alias("TotalCost"),
    )
    return rounded(rows, keep=("TotalCost",))


@query(
    "ftr_summary",
    sql("pnl", f"""SELECT Source, Sink, Class, WinterYear,
 {r('first(TotalCost ORDER BY MW DESC, ClearingPrice DESC)', 4)} AS TotalCost,
 {r('first(ClearingPrice ORDER BY MW DESC, ClearingPrice DESC)', 4)} AS PricePaidPerMW,
 first(MW ORDER BY MW DESC) AS MWHeld,
 {r('sum(HourlyCongestionRevenue)', 4)} AS TotalCongestionRevenue, {r('sum(HourlyProfitLoss)', 4)} AS TotalProfitLoss,
 {r('avg(HourlyProfitLoss)', 4)} AS AvgHourlyProfitLoss, {r('stddev_samp(HourlyProfitLoss)', 4)} AS StdHourlyProfitLoss,
 {r('skewness(HourlyProfitLoss)', 4)} AS SkewnessHourlyProfitLoss,
 {r('kurtosis(HourlyProfitLoss)', 4)} AS KurtosisHourlyProfitLoss,
 {r('max(HourlyProfitLoss)', 4)} AS MaxHourlyProfitLoss, {r('min(HourlyProfitLoss)', 4)} AS MinHourlyProfitLoss
 FROM pnl GROUP BY Source, Sink, Class, WinterYear"""),
)
def ftr_summary(spark, sf_dir):
    """Profit statistics per path, class and season."""
    return rounded(rights.summarise_paths(pnl(spark, sf_dir), held(spark, sf_dir)), 4)


@query(
    "ftr_summary_by_season",
    sql("pnl", f"""SELECT WinterYear, {r('sum(total)', 4)} AS TotalProfitLoss, {r('min(low)', 4)} AS MinProfitLoss,
 {r('max(high)', 4)} AS MaxProfitLoss, {r('min(total)', 4)} AS MinTotalProfitLoss, {r('max(total)', 4)} AS MaxTotalProfitLoss
 FROM (SELECT WinterYear, sum(HourlyProfitLoss) AS total, min(HourlyProfitLoss) AS low, max(HourlyProfitLoss) AS high
 FROM pnl GROUP BY Source, Sink, Class, WinterYear) GROUP BY WinterYear"""),
)
def ftr_summary_by_season(spark, sf_dir):
    """Seasonal totals of the path summary."""
    return rounded(rights.summarise_seasons(pnl(spark, sf_dir)), 4)


@query(
    "ftr_event_pnl",
    sql("pnl", f"""SELECT Source, Sink, Class, WinterYear, {r('sum(HourlyProfitLoss)', 4)} AS TotalProfitLoss FROM pnl
 WHERE start_time >= '1999-01-10' AND start_time < '1999-01-25' GROUP BY ALL"""),
)
def ftr_event_pnl(spark, sf_dir):
    """Profit per path inside an event, best first; of the stored prices only the event's partitions are read."""
    path = scratch_dir(spark, "season-prices")
    overwrite_table(with_partition_parts(season_prices(spark, sf_dir), "start_time").drop("day"), path)
    hours = rights.class_hours(calendar(spark, sf_dir))
    return rounded(rights.event_profit(held(spark, sf_dir), spark.read.parquet(path), hours, EVENT_START, EVENT_END), 4)


_SERIES_SQL = """wind AS (SELECT start_time, WinterYear, 100 * WindSpeed / avg(WindSpeed) OVER (PARTITION BY WinterYear) AS Wind
 FROM (SELECT *, (year(start_time) - CASE WHEN month(start_time) IN (1, 2) THEN 1 ELSE 0 END)::INTEGER AS WinterYear
 FROM season_weather WHERE month(start_time) IN (12, 1, 2))),
 hours AS (SELECT Source, Sink, p.WinterYear, start_time, sum(HourlyProfitLoss) AS p, max(Temperature) AS t, max(Wind) AS w
 FROM pnl p LEFT JOIN wind USING (start_time) GROUP BY ALL),
 flagged AS (SELECT *, sum(p) OVER (PARTITION BY Source, Sink, WinterYear ORDER BY start_time ROWS UNBOUNDED PRECEDING) AS c,
 coalesce(t < -5, FALSE) AS cold, coalesce(lag(t < -5) OVER (PARTITION BY Source, Sink, WinterYear ORDER BY start_time), FALSE) AS was FROM hours),
 series AS (SELECT *, CASE WHEN cold THEN sum((cold AND NOT was)::INTEGER) OVER (PARTITION BY Source, Sink, WinterYear
 ORDER BY start_time ROWS UNBOUNDED PRECEDING) END::INTEGER AS Spell FROM flagged)"""


def _with_series(body: str) -> str:
    return sql("pnl", "SELECT 1").replace("\nSELECT 1", f",\n{_SERIES_SQL}\n{body}")


def path_series(spark, sf_dir) -> DataFrame:
    """Hours of every path and season; wind in percent of the season's mean."""
    weather = season_weather(spark, sf_dir).where(is_winter(F.col("start_time")))
    weather = stage(weather.withColumn("_season", winter_season(F.col("start_time"))), "season-weather")
    means = weather.groupBy("_season").agg(F.avg("WindSpeed").alias("_mean"))
    wind = weather.join(means, "_season").select("start_time", "Temperature", (ratio(F.col("WindSpeed"), F.col("_mean")) * 100).alias("Wind"))
    return rights.path_series(pnl(spark, sf_dir).join(wind, "start_time", "left"))


@query(
    "ftr_path_series",
    _with_series(f"""SELECT Source, Sink, WinterYear, start_time, {r('p', 4)} AS HourlyProfitLoss, {r('t', 4)} AS Temperature,
 {r('w', 4)} AS Wind, {r('c', 4)} AS CumulativeProfitLoss, Spell FROM series"""),
)
def ftr_path_series(spark, sf_dir):
    """Hourly profit, running profit, drivers and cold spells of every path and season."""
    return rounded(path_series(spark, sf_dir), 4)


def _driver_sql(driver: str) -> str:
    return r(f"CASE WHEN stddev_pop({driver}) > 0 AND stddev_pop(p) > 0 THEN corr({driver}, p) END", 4)


@query(
    "ftr_path_report",
    _with_series(f"""SELECT Source, Sink, WinterYear, count(*) AS Hours, count(*) FILTER (WHERE p > 0) AS ProfitableHours,
 {r('sum(p)', 3)} AS TotalProfitLoss, {r('avg(p)', 3)} AS AvgHourlyProfitLoss, {r('max(p)', 3)} AS MaxHourlyProfitLoss,
 {r('min(p)', 3)} AS MinHourlyProfitLoss, {r('min(c)', 3)} AS LowestCumulative, {r('max(c)', 3)} AS HighestCumulative,
 coalesce(max(Spell), 0) AS ColdSpells, count(Spell) AS ColdHours, {r('sum(p) FILTER (WHERE cold)', 3)} AS ColdProfitLoss,
 {_driver_sql('t')} AS corr_Temperature, {_driver_sql('w')} AS corr_Wind, {r('avg(w)', 3)} AS avg_Wind, {r('min(w)', 3)} AS min_Wind,
 {r('max(w)', 3)} AS max_Wind FROM series GROUP BY Source, Sink, WinterYear"""),
)
def ftr_path_report(spark, sf_dir):
    """Profit, cold spells and drivers of every path and season, from the series in one pass."""
    report = rights.path_report(path_series(spark, sf_dir))
    correlations = ("corr_Temperature", "corr_Wind")
    return rounded(rounded(report, 3, keep=correlations), 4)


_PARTICIPANTS = ("Brand#2", "Brand#11", "Brand#23")


@query(
    "participant_positions",
    sql("auction", f"""SELECT {_POSITION.replace('MW', 'sum(MW) AS MW')}, {r('sum(ClearingPrice * MW) / nullif(sum(MW), 0)')} AS ClearingPrice,
 season AS WinterYear FROM auction WHERE MarketParticipant IN {_PARTICIPANTS} GROUP BY ALL"""),
)
def participant_positions(spark, sf_dir):
    """Positions of some market participants only."""
    return rounded(rights.weighted_positions(part_auction(spark, sf_dir), _PARTICIPANTS))


@query(
    "ftr_cumulative",
    sql("pnl", f"""SELECT Source, Sink, WinterYear, start_time, {r('p', 4)} AS HourlyProfitLoss,
 {r('sum(p) OVER (PARTITION BY Source, Sink, WinterYear ORDER BY start_time ROWS UNBOUNDED PRECEDING)', 4)} AS CumulativeProfitLoss
 FROM (SELECT Source, Sink, WinterYear, start_time, sum(HourlyProfitLoss) AS p FROM pnl GROUP BY ALL)"""),
)
def ftr_cumulative(spark, sf_dir):
    """Running profit per path and season."""
    return rounded(rights.cumulative_pnl(stage(rights.path_hours(pnl(spark, sf_dir)), "path-hours")), 4)


@query(
    "cold_spells",
    sql("season_prices season_weather", """SELECT node, min(start_time) AS spell_start, max(start_time) AS spell_end, count(*) AS spell_rows
 FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY start_time)
 - row_number() OVER (PARTITION BY node, cold ORDER BY start_time) AS island FROM
 (SELECT p.node, start_time, coalesce(Temperature < -5, FALSE) AS cold FROM season_prices p
 LEFT JOIN season_weather w USING (start_time))) WHERE cold GROUP BY node, island"""),
)
def cold_spells(spark, sf_dir):
    """Stretches of consecutive node hours below -5 degrees."""
    hours = season_prices(spark, sf_dir).join(season_weather(spark, sf_dir), "start_time", "left")
    return rights.cold_spells(stage(hours.select("node", "start_time", "Temperature"), "hours"), ["node"])


def _corr_sql(driver: str) -> str:
    varies = f"stddev_pop({driver}) > 0 AND stddev_pop(HourlyProfitLoss) > 0"
    return r(f"CASE WHEN {varies} THEN corr({driver}, HourlyProfitLoss) END", 4)


@query(
    "ftr_correlation",
    sql("pnl", f"""SELECT Source, Sink, Class, WinterYear, {_corr_sql('Temperature')} AS corr_Temperature,
 {_corr_sql('WindSpeed')} AS corr_WindSpeed,
 count(*) FILTER (WHERE HourlyProfitLoss > 0) AS ProfitableHours, count(*) AS Hours,
 {r('avg(Temperature)', 4)} AS avg_Temperature, {r('avg(WindSpeed)', 4)} AS avg_WindSpeed,
 {r('min(Temperature)', 4)} AS min_Temperature, {r('min(WindSpeed)', 4)} AS min_WindSpeed,
 {r('max(Temperature)', 4)} AS max_Temperature, {r('max(WindSpeed)', 4)} AS max_WindSpeed
 FROM pnl GROUP BY Source, Sink, Class, WinterYear"""),
)
def ftr_correlation(spark, sf_dir):
    """Correlation of profit with temperature and wind."""
    return rounded(rights.path_drivers(pnl_with_weather(spark, sf_dir), ["Temperature", "WindSpeed"]), 4)


_HIST = f"(SELECT * FROM spreads WHERE WinterYear < {HISTORY_END})"
_EVENT = f"(SELECT * FROM spreads WHERE WinterYear = {EVENT_SEASON})"


def _limits_sql(source: str) -> str:
    return f"""SELECT Source, Sink, Class, quantile_cont(PriceSpread, 0.05) AS lo, quantile_cont(PriceSpread, 0.95) AS hi
 FROM {source} GROUP BY ALL"""


def _metrics_sql(source: str) -> str:
    return f"""SELECT Source, Sink, Class, avg(x) AS mean, median(x) AS median, stddev_pop(x) AS sd, skewness(x) AS skew,
 kurtosis(x) AS kurt, avg(x) FILTER (WHERE x <= lo) AS cvar_lo, avg(x) FILTER (WHERE x >= hi) AS cvar_hi,
 any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n, count(*) FILTER (WHERE x <= lo) AS n_lo,
 count(*) FILTER (WHERE x >= hi) AS n_hi, min(x) AS worst, kurtosis_pop(x) AS kurt_pop,
 avg((x - m) * (x - m) * (x - m)) / nullif(pow(stddev_pop(x), 3), 0) AS skew_pop
 FROM (SELECT s.Source, s.Sink, s.Class, s.PriceSpread AS x, l.lo, l.hi,
 avg(s.PriceSpread) OVER (PARTITION BY s.Source, s.Sink, s.Class) AS m FROM {source} s
 JOIN ({_limits_sql(source)}) l USING (Source, Sink, Class)) GROUP BY Source, Sink, Class"""


_EXPECTED = "0.05::DOUBLE * cvar_lo + 0.95::DOUBLE * mean"


@query(
    "cvar_metrics",
    sql("spreads", f"""SELECT Source, Sink, Class, {r('mean', 4)} AS Mean_Spread, {r('median', 4)} AS Median_Spread,
 {r('sd', 4)} AS Std_Spread, {r('skew', 4)} AS Skewness_Spread, {r('kurt', 4)} AS Kurtosis_Spread,
 {r(_EXPECTED, 4)} AS CVaR_Value, {r('cvar_lo', 4)} AS CVaR_Left_Tail, {r('cvar_hi', 4)} AS CVaR_Right_Tail,
 {r('lo', 4)} AS Left_Tail_Threshold, {r('hi', 4)} AS Right_Tail_Threshold, n AS n_observations,
 n_lo AS n_left_tail_events, n_hi AS n_right_tail_events FROM ({_metrics_sql(_HIST)})"""),
)
def cvar_metrics(spark, sf_dir):
    """Thirteen tail metrics of the historical spreads per path and class."""
    metrics = risk.cvar_metrics(history(spark, sf_dir), GROUP, "PriceSpread", 0.95)
    return rounded(metrics.select(*GROUP, *risk.METRICS), 4)


@query(
    "cvar_price",
    sql("spreads", f"""SELECT Source, Sink, Class, {r(f'({_EXPECTED}) * {MW} * {HOURS}', 3)} AS CVaR_FTR_Price,
 {r(f'mean * {MW} * {HOURS}', 3)} AS Mean_Spread_Price,
 {r(f'({_EXPECTED}) * {MW} * {HOURS} - mean * {MW} * {HOURS}', 3)} AS Risk_Premium FROM ({_metrics_sql(_HIST)})"""),
)
def cvar_price(spark, sf_dir):
    """Price of a 77 MW, 1008-hour right under the tail scenario and the mean."""
    metrics = risk.cvar_metrics(history(spark, sf_dir), GROUP, "PriceSpread", 0.95)
    return rounded(risk.cvar_price(metrics, GROUP, F.lit(MW), F.lit(HOURS)), 3)


@query(
    "normal_var_gap",
    sql("spreads", f"""SELECT Source, Sink, Class, {r('lo', 4)} AS var_95,
 {r('mean - sd * 1.6448536269514722::DOUBLE', 4)} AS normal_var_95,
 {r('lo - (mean - sd * 1.6448536269514722::DOUBLE)', 4)} AS var_gap FROM ({_metrics_sql(_HIST)})"""),
)
def normal_var_gap(spark, sf_dir):
    """VaR against that of a normal distribution."""
    metrics = risk.cvar_metrics(history(spark, sf_dir), GROUP, "PriceSpread", 0.95)
    return rounded(risk.normal_var_gap(metrics, GROUP), 4)


def _side_sql(source: str, name: str) -> str:
    return f"""SELECT Source, Sink, Class, mean AS {name}_mean, median AS {name}_median, lo AS {name}_var,
 cvar_lo AS {name}_cvar, worst AS {name}_worst, skew_pop AS {name}_skewness, kurt_pop AS {name}_kurtosis
 FROM ({_metrics_sql(source)})"""


_SIDE = ("mean", "median", "var", "cvar", "worst", "skewness", "kurtosis")


@query(
    "tail_compare",
    sql("spreads", f"""WITH h AS ({_side_sql(_HIST, 'hist')}), e AS ({_side_sql(_EVENT, 'event')}),
 b AS (SELECT Source, Sink, Class, avg((PriceSpread <= hist_cvar)::INTEGER) AS beyond_cvar,
 avg((PriceSpread <= hist_var)::INTEGER) AS beyond_var, count(*) AS event_hours
 FROM {_EVENT} JOIN h USING (Source, Sink, Class) GROUP BY ALL)
 SELECT Source, Sink, Class, {', '.join(f"{r(f'{p}_{s}', 4)} AS {p}_{s}" for p in ('hist', 'event') for s in _SIDE)},
 {r('beyond_cvar', 4)} AS share_beyond_hist_cvar, {r('beyond_var', 4)} AS share_beyond_hist_var, event_hours,
 {r('event_mean - hist_mean', 4)} AS mean_shift, {r('event_cvar - hist_cvar', 4)} AS cvar_gap,
 {r('abs(event_var / nullif(hist_var, 0))', 4)} AS var_ratio, {r('abs(event_cvar / nullif(hist_cvar, 0))', 4)} AS cvar_ratio,
 {r('abs(event_worst / nullif(hist_worst, 0))', 4)} AS worst_ratio
 FROM h JOIN e USING (Source, Sink, Class) JOIN b USING (Source, Sink, Class)""").replace("\nWITH h AS", ",\nh AS"),
)
def tail_compare(spark, sf_dir):
    """Event spreads against history."""
    return rounded(risk.tail_compare(samples(spark, sf_dir), GROUP, "PriceSpread", "sample", 0.95), 4)


@query(
    "event_outcome",
    sql("spreads", f"""SELECT Source, Sink, Class, {r(f'sum(PriceSpread) * {MW}', 3)} AS actual_pnl,
 {r(f'sum(PriceSpread) * {MW} * {HOURS}', 2)} AS scaled_pnl FROM {_EVENT} GROUP BY ALL"""),
)
def event_outcome(spark, sf_dir):
    """Result of holding a right through the event season."""
    season = spreads(spark, sf_dir).where(F.col("WinterYear") == EVENT_SEASON)
    out = risk.event_outcome(season, GROUP, "PriceSpread", MW, HOURS)
    scaled = (F.round("scaled_pnl", 2) + F.lit(0.0)).alias("scaled_pnl")
    return rounded(out.select(*GROUP, "actual_pnl", scaled), 3, keep=("scaled_pnl",))


@query(
    "ecdf",
    sql("spreads", f"""SELECT Class, {r('PriceSpread')} AS PriceSpread,
 row_number() OVER (PARTITION BY Class ORDER BY PriceSpread) AS rank,
 {r('row_number() OVER (PARTITION BY Class ORDER BY PriceSpread) / count(*) OVER (PARTITION BY Class)')} AS cdf FROM {_HIST}"""),
)
def ecdf(spark, sf_dir):
    """Empirical distribution of the historical spreads per class."""
    return rounded(empirical_cdf(history(spark, sf_dir), ["Class"], "PriceSpread"))


def _bars_sql(source: str, bins: int) -> str:
    return f"""SELECT Class, bin, any_value(lo) AS lo, any_value((hi - lo) / {bins}) AS w, any_value(n) AS n, count(*) AS count
 FROM (SELECT *, {bin_sql('x', 'lo', 'hi', bins)} AS bin FROM (SELECT Class,
 PriceSpread AS x, min(PriceSpread) OVER c AS lo, max(PriceSpread) OVER c AS hi, count(*) OVER c AS n
 FROM {source} WINDOW c AS (PARTITION BY Class))) GROUP BY Class, bin"""


_BIN_SQL = f"""bin, {r('lo + bin * w')} AS bin_left, {r('lo + bin * w + w')} AS bin_right,
 {r('lo + bin * w + w / 2')} AS bin_center, count"""


@query(
    "histogram_tail",
    sql("spreads", f"""SELECT Class, {_BIN_SQL}, {r('v')} AS var, lo + bin * w <= v AS in_tail FROM ({_bars_sql(_HIST, 80)})
 JOIN (SELECT Class, quantile_cont(PriceSpread, 0.05) AS v FROM {_HIST} GROUP BY Class) USING (Class)"""),
)
def histogram_tail(spark, sf_dir):
    """Spread histogram with the tail bars marked."""
    return rounded(risk.histogram_tail(history(spark, sf_dir), ["Class"], "PriceSpread"))


@query(
    "histogram_density",
    sql("spreads", " UNION ALL ".join(
        f"SELECT '{name}' AS sample, Class, {_BIN_SQL}, {r('count / (n * w)', 8)} AS density FROM ({_bars_sql(source, 80)})"
        for name, source in (("hist", _HIST), ("event", _EVENT)))),
)
def histogram_density(spark, sf_dir):
    """Density histograms of history and event on their own ranges."""
    bars = equal_width_histogram(samples(spark, sf_dir), "PriceSpread", 80, ["sample", "Class"], density=True)
    density = (F.round("density", 8) + F.lit(0.0)).alias("density")
    return rounded(bars.select(*[c for c in bars.columns if c != "density"], density), keep=("density",))
