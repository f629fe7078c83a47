"""Transmission rights: auction positions, hourly profit and loss, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.numbers import correlation, ratio, sample_kurtosis, sample_skewness
from gridlens.functions.timeparts import in_window, is_winter, market_class, prune_to_window, winter_season
from gridlens.operators.series import DEFAULT_CHUNK, running_sum, spells
from gridlens.session import stage

POSITION_KEYS = ["Source", "Sink", "StartDate", "EndDate", "Type", "Class"]
PATH = ["Source", "Sink", "Class", "WinterYear"]
DATE_FORMAT = "M/d/yyyy"
PATH_SEASON = ["Source", "Sink", "WinterYear"]
# Positions of one source, class and season that one task joins with their hours.
POSITIONS_AT_ONCE = 5_000


def class_hours(calendar: DataFrame, ts: str = "start_time", iso_weekday_compat: bool = False) -> DataFrame:
    """Winter hours per season and class."""
    hours = calendar.where(is_winter(F.col(ts)))
    return hours.groupBy(
        winter_season(F.col(ts)).alias("WinterYear"),
        market_class(F.col(ts), iso_weekday_compat).alias("Class"),
    ).agg(F.count(F.lit(1)).alias("ClassHours"))


def weighted_positions(auction: DataFrame, participants: Sequence[str] | None = None) -> DataFrame:
    """Total MW and MW-weighted clearing price per position, with its season.

    ``participants`` limits the auction to some market participants; by default all count.
    """
    rows = auction
    if participants is not None:
        rows = rows.where(F.col("MarketParticipant").isin(*participants))
    weighted = F.sum(F.col("ClearingPrice") * F.col("MW"))
    return (
        rows.groupBy(*POSITION_KEYS)
        .agg(F.sum("MW").alias("MW"), ratio(weighted, F.sum("MW")).alias("ClearingPrice"))
        .withColumn("WinterYear", F.year(F.to_date("StartDate", DATE_FORMAT)))
    )


def backfill_positions(positions: DataFrame, season: int, seasons: Sequence[int]) -> DataFrame:
    """Add copies of one season's positions for seasons that have none, with shifted dates."""
    own = F.array("WinterYear")
    copied = F.concat(own, F.array(*[F.lit(s) for s in seasons]))
    spread = positions.withColumn(
        "_season", F.explode(F.when(F.col("WinterYear") == season, copied).otherwise(own))
    )
    is_copy = F.col("_season") != F.col("WinterYear")

    def moved(column: str, old_year: int, new_year: Column) -> Column:
        shifted = F.replace(F.col(column), F.lit(str(old_year)), new_year.cast("string"))
        return F.when(is_copy, shifted).otherwise(F.col(column))

    return spread.withColumns(
        {
            "StartDate": moved("StartDate", season, F.col("_season")),
            "EndDate": moved("EndDate", season + 1, F.col("_season") + 1),
            "WinterYear": F.col("_season"),
        }
    ).drop("_season")


def path_spreads(prices: DataFrame, paths: DataFrame) -> DataFrame:
    """Hourly sink minus source price of each (Source, Sink) pair in ``paths``, winter only.

    Paths are stored, so that they are broadcast where they are small and no price is shuffled by
    a handful of nodes.
    """
    paths = stage(paths, "paths")
    winter = prices.where(is_winter(F.col("start_time")))
    source = winter.select(F.col("node").alias("Source"), "start_time", F.col("lmp").alias("lmp_source"))
    sink = winter.select(F.col("node").alias("Sink"), "start_time", F.col("lmp").alias("lmp_sink"))
    joined = paths.join(source, "Source").join(sink, ["Sink", "start_time"])
    return joined.select(
        "Source", "Sink", "start_time",
        market_class(F.col("start_time")).alias("Class"),
        winter_season(F.col("start_time")).alias("WinterYear"),
        (F.col("lmp_sink") - F.col("lmp_source")).alias("PriceSpread"),
    )


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], limit: int) -> DataFrame:
    """Inner join of a stored ``left`` whose keys may have very many rows each.

    The rows of each key are counted; those of a key with more than ``limit`` are dealt to as many
    parts as that takes, and its ``right`` rows are copied to each part. So no task gets more than about
    ``limit`` left rows of a key, however few keys there are. Left rows differ in some column.
    """
    parts = F.ceil(F.count(F.lit(1)) / F.lit(limit)).cast("int")
    split = stage(left.groupBy(*on).agg(parts.alias("_parts")).where("_parts > 1"), "split-keys")
    place = F.pmod(F.xxhash64(*left.columns), F.col("_parts")).cast("int")
    dealt = left.join(split, list(on), "left").withColumn("_part", F.coalesce(place, F.lit(0))).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    copied = right.join(split, list(on), "left").withColumn("_part", copies).drop("_parts")
    return dealt.join(copied, [*on, "_part"]).drop("_part")


def hourly_pnl(positions: DataFrame, prices: DataFrame, hours: DataFrame, limit: int = POSITIONS_AT_ONCE) -> DataFrame:
    """One row per position and winter hour of its class and season.

    ``prices`` holds ``node, start_time, lmp`` and any feature columns, which come from the
    source node. Positions and class hours are small aggregates: they are stored, so that Spark
    joins them by their real size and does not shuffle prices by (node, class, season). Beyond ``limit``
    positions a key may have many of them: its positions are then dealt out over parts (:func:`spread_join`).
    """
    positions, hours = stage(positions, "positions"), stage(hours, "class-hours")
    winter = prices.where(is_winter(F.col("start_time")))
    ts = F.col("start_time")
    source = (
        winter.withColumnsRenamed({"node": "Source", "lmp": "lmp_source"})
        .withColumns({"Class": market_class(ts), "WinterYear": winter_season(ts)})
        .join(hours, ["WinterYear", "Class"], "left")
    )
    sink = winter.select(F.col("node").alias("Sink"), "start_time", F.col("lmp").alias("lmp_sink"))
    by = ["Source", "Class", "WinterYear"]
    many = positions.limit(limit + 1).count() > limit
    held = (spread_join(positions, source, by, limit) if many else positions.join(source, by)).join(sink, ["Sink", "start_time"])
    total = F.col("ClearingPrice") * F.col("MW")
    return held.withColumns(
        {
            "PriceSpread": F.col("lmp_sink") - F.col("lmp_source"),
            "TotalCost": total,
            "HourlyCost": ratio(total, F.col("ClassHours")),
        }
    ).withColumns(
        {
            "HourlyCongestionRevenue": F.col("PriceSpread") * F.col("MW"),
            "HourlyProfitLoss": F.col("PriceSpread") * F.col("MW") - F.col("HourlyCost"),
        }
    )


def summarise_paths(pnl: DataFrame, positions: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Profit statistics per path, class and season.

    Positions that share a path are taken together; cost, price and MW are those of the
    largest one, which is the first after ordering by MW. ``extra_keys`` (position columns)
    keeps them apart. The hourly rows are only hash-aggregated.
    """
    profit = F.col("HourlyProfitLoss")
    keys = [*PATH, *extra_keys]
    largest = F.max_by(F.struct("MW", "ClearingPrice"), F.struct("MW", "ClearingPrice"))
    first = positions.groupBy(*keys).agg(largest.alias("_first")).select(
        *keys,
        (F.col("_first.ClearingPrice") * F.col("_first.MW")).alias("TotalCost"),
        F.col("_first.ClearingPrice").alias("PricePaidPerMW"),
        F.col("_first.MW").alias("MWHeld"),
    )
    totals = pnl.groupBy(*keys).agg(
        F.sum("HourlyCongestionRevenue").alias("TotalCongestionRevenue"),
        F.sum(profit).alias("TotalProfitLoss"),
        F.avg(profit).alias("AvgHourlyProfitLoss"),
        F.stddev_samp(profit).alias("StdHourlyProfitLoss"),
        sample_skewness(profit).alias("SkewnessHourlyProfitLoss"),
        sample_kurtosis(profit).alias("KurtosisHourlyProfitLoss"),
        F.max(profit).alias("MaxHourlyProfitLoss"),
        F.min(profit).alias("MinHourlyProfitLoss"),
    )
    return totals.join(first, keys)


def summarise_seasons(pnl: DataFrame) -> DataFrame:
    """Season totals with the extreme hours and the extreme paths."""
    profit = F.col("HourlyProfitLoss")
    paths = pnl.groupBy(*PATH).agg(
        F.sum(profit).alias("_total"), F.min(profit).alias("_low"), F.max(profit).alias("_high")
    )
    return paths.groupBy("WinterYear").agg(
        F.sum("_total").alias("TotalProfitLoss"),
        F.min("_low").alias("MinProfitLoss"),
        F.max("_high").alias("MaxProfitLoss"),
        F.min("_total").alias("MinTotalProfitLoss"),
        F.max("_total").alias("MaxTotalProfitLoss"),
    )


def event_pnl(pnl: DataFrame, start: date, end: date, top: int | None = None) -> DataFrame:
    """Profit per path inside a half-open window, best first; ``top`` limits the report."""
    ranked = (
        pnl.where(in_window(F.col("start_time"), start, end))
        .groupBy(*PATH)
        .agg(F.sum("HourlyProfitLoss").alias("TotalProfitLoss"))
        .orderBy(F.desc("TotalProfitLoss"), *PATH)
    )
    return ranked if top is None else ranked.limit(top)


def event_profit(
    positions: DataFrame, prices: DataFrame, hours: DataFrame, start: date, end: date, top: int | None = None
) -> DataFrame:
    """:func:`event_pnl` from stored prices of which only the event's are read.

    Where ``prices`` is partitioned by year and month, the window selects partitions before anything else
    happens to them.
    """
    window = prices.where(in_window(F.col("start_time"), start, end))
    if {"year", "month"} <= set(prices.columns):
        window = prune_to_window(prices, "start_time", start, end).drop("year", "month")
    return event_pnl(hourly_pnl(positions, window, hours), start, end, top)


def path_series(pnl: DataFrame, temperature: str = "Temperature", wind: str = "Wind", limit: float = -5) -> DataFrame:
    """Every hour of a path and season: profit, running profit, drivers, and the number of its cold spell.

    Hours are unique on a path, so a path's season is at most some two thousand rows, which one sort
    serves; positions are added up by hour before that. ``Spell`` is NULL in hours that are not colder than
    ``limit``.
    """
    hours = pnl.groupBy(*PATH_SEASON, "start_time").agg(
        F.sum("HourlyProfitLoss").alias("HourlyProfitLoss"), F.max(temperature).alias("Temperature"), F.max(wind).alias("Wind")
    )
    order = Window.partitionBy(*PATH_SEASON).orderBy("start_time")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    cold = F.coalesce(F.col("Temperature") < limit, F.lit(False))
    marked = hours.withColumns({
        "CumulativeProfitLoss": F.sum("HourlyProfitLoss").over(so_far),
        "_cold": cold, "_begins": cold & ~F.coalesce(F.lag(cold).over(order), F.lit(False)),
    })
    spell = F.when(F.col("_cold"), F.count_if("_begins").over(so_far))
    return marked.withColumn("Spell", spell.cast("int")).drop("_cold", "_begins")


def path_report(series: DataFrame) -> DataFrame:
    """Statistics of :func:`path_series` per path and season; the rows are already together, nothing is exchanged."""
    profit = F.col("HourlyProfitLoss")
    return series.groupBy(*PATH_SEASON).agg(
        F.count(F.lit(1)).alias("Hours"), F.count_if(profit > 0).alias("ProfitableHours"),
        F.sum(profit).alias("TotalProfitLoss"), F.avg(profit).alias("AvgHourlyProfitLoss"),
        F.max(profit).alias("MaxHourlyProfitLoss"), F.min(profit).alias("MinHourlyProfitLoss"),
        F.min("CumulativeProfitLoss").alias("LowestCumulative"), F.max("CumulativeProfitLoss").alias("HighestCumulative"),
        F.coalesce(F.max("Spell"), F.lit(0)).alias("ColdSpells"), F.count("Spell").alias("ColdHours"),
        F.sum(F.when(F.col("Spell").isNotNull(), profit)).alias("ColdProfitLoss"),
        correlation(F.col("Temperature"), profit).alias("corr_Temperature"), correlation(F.col("Wind"), profit).alias("corr_Wind"),
        F.avg("Wind").alias("avg_Wind"), F.min("Wind").alias("min_Wind"), F.max("Wind").alias("max_Wind"),
    )


def path_hours(pnl: DataFrame, value: str = "HourlyProfitLoss") -> DataFrame:
    """Profit of all positions on a path per hour, so that hours are unique on a path."""
    return pnl.groupBy("Source", "Sink", "WinterYear", "start_time").agg(F.sum(value).alias(value))


def cumulative_pnl(hours: DataFrame, chunk: str = DEFAULT_CHUNK) -> DataFrame:
    """Running profit per path and season in time order."""
    keys = ["Source", "Sink", "WinterYear"]
    return running_sum(hours, keys, "start_time", "HourlyProfitLoss", "CumulativeProfitLoss", chunk)


def cold_spells(
    df: DataFrame, keys: Sequence[str], ts: str = "start_time", limit: float = -5, chunk: str = DEFAULT_CHUNK
) -> DataFrame:
    """Stretches of consecutive rows colder than ``limit``."""
    return spells(df, keys, ts, F.col("Temperature") < limit, chunk)


def path_drivers(pnl: DataFrame, drivers: Sequence[str], keys: Sequence[str] = PATH) -> DataFrame:
    """Correlation of hourly profit with each driver, and profitable hours."""
    profit = F.col("HourlyProfitLoss")
    return pnl.groupBy(*keys).agg(
        *[correlation(F.col(d), profit).alias(f"corr_{d}") for d in drivers],
        F.count_if(profit > 0).alias("ProfitableHours"),
        F.count(F.lit(1)).alias("Hours"),
        *[F.avg(d).alias(f"avg_{d}") for d in drivers],
        *[F.min(d).alias(f"min_{d}") for d in drivers],
        *[F.max(d).alias(f"max_{d}") for d in drivers],
    )
