"""Domain views over the test tables, in Spark and as SQL common table expressions.

``events`` is an hourly market of one month: the event type is the node, rows of the first
half of an hour are day-ahead, those of the second half real-time. ``lineitem`` is a market
of several winters with three nodes and seven hours a day; ``part`` is the auction. Values
are aggregated as fixed-point numbers, so both engines get the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions.numbers import exact_avg, exact_sum
from gridlens.functions.timeparts import OFF_PEAK, PEAK, hour_floor

DA, RT, ALL = "DA", "RT", "ALL"
NODES = ("A", "N", "R")
FUEL_OF_TYPE = {"click": "coal", "error": "gas", "purchase": "nuclear", "signup": "solar", "view": "wind"}
HISTORY_END, EVENT_SEASON = 2000, 2000
# A prime: quotients have no finite decimals, so rounding meets no ties.
PRICE_SCALE = 997
AUCTION_SEASON, BACKFILLED = 1999, (1994, 1995, 1996, 2000)


# Declared schemas: no job is spent on looking at file footers.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
}


def sum_of_cents(x: Column) -> Column:
    """The test tables hold values of two decimals."""
    return exact_sum(x, 2)


def avg_of_cents(x: Column) -> Column:
    return exact_avg(x, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def market_half(df: DataFrame, market: str) -> DataFrame:
    if market == ALL:
        return df
    first_half = F.minute("ts") < 30
    return df.where(first_half if market == DA else ~first_half)


def event_prices(spark: SparkSession, sf_dir: str, market: str) -> DataFrame:
    """node, start_time, lmp of one market; one row per key."""
    rows = market_half(table(spark, sf_dir, "events"), market)
    return rows.groupBy(F.col("event_type").alias("node"), hour_floor(F.col("ts")).alias("start_time")).agg(
        avg_of_cents(F.col("value")).alias("lmp")
    )


def _of_type(name: str) -> Column:
    return F.when(F.col("event_type") == name, F.col("value"))


def event_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """start_time (UTC), Temperature, WindSpeed."""
    return table(spark, sf_dir, "events").groupBy(hour_floor(F.col("ts")).alias("start_time")).agg(
        (avg_of_cents(_of_type("view")) - 30).alias("Temperature"),
        avg_of_cents(_of_type("click")).alias("WindSpeed"),
    )


def event_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """timestamp and the five imputed variables of one station."""
    return table(spark, sf_dir, "events").groupBy(hour_floor(F.col("ts")).alias("timestamp")).agg(
        (avg_of_cents(_of_type("view")) - 30).alias("temperature_2m"),
        (avg_of_cents(_of_type("purchase")) * 0.5).alias("relative_humidity_2m"),
        (avg_of_cents(_of_type("signup")) - 60).alias("dewpoint_2m"),
        avg_of_cents(_of_type("error")).alias("precipitation"),
        avg_of_cents(_of_type("click")).alias("wind_speed_10m"),
    )


def event_fuel(spark: SparkSession, sf_dir: str, market: str) -> DataFrame:
    """region, start_time, totalMw and five fuels."""
    rows = market_half(table(spark, sf_dir, "events"), market)
    return rows.groupBy(F.lit("NORTH").alias("region"), hour_floor(F.col("ts")).alias("start_time")).agg(
        sum_of_cents(F.col("value")).alias("totalMw"),
        *[sum_of_cents(_of_type(kind)).alias(fuel) for kind, fuel in FUEL_OF_TYPE.items()],
    )


def event_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datetime, LoadActual, LoadForecast."""
    first_half = F.minute("ts") < 30
    return table(spark, sf_dir, "events").groupBy(hour_floor(F.col("ts")).alias("Datetime")).agg(
        sum_of_cents(F.when(first_half, F.col("value"))).alias("LoadActual"),
        sum_of_cents(F.when(~first_half, F.col("value"))).alias("LoadForecast"),
    )


def line_hour() -> Column:
    """Hour of a line item: three hours per line number."""
    return F.col("l_shipdate") + F.make_dt_interval(
        F.lit(0), F.col("l_linenumber") * 3, F.lit(0), F.lit(0.0)
    )


def season_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, start_time, lmp over several winters."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("node"), line_hour().alias("start_time")
    ).agg((avg_of_cents(F.col("l_extendedprice")) / PRICE_SCALE).alias("lmp"))


def season_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """start_time, Temperature, WindSpeed over several winters."""
    return table(spark, sf_dir, "lineitem").groupBy(line_hour().alias("start_time")).agg(
        (avg_of_cents(F.col("l_quantity")) * 2 - 40).alias("Temperature"),
        (avg_of_cents(F.col("l_discount")) * 100).alias("WindSpeed"),
    )


def part_auction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auction rows: every part is one award."""
    season = (F.col("p_size") % 3 + 1997).cast("int")
    source = (F.col("p_partkey") % 3).cast("int")
    step = (F.floor(F.col("p_partkey") / 3) % 2).cast("int")
    nodes = F.array(*[F.lit(n) for n in NODES])
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("MarketParticipant"),
        F.element_at(nodes, source + 1).alias("Source"),
        F.element_at(nodes, (source + 1 + step) % 3 + 1).alias("Sink"),
        F.concat(F.lit("12/1/"), season).alias("StartDate"),
        F.concat(F.lit("2/28/"), season + 1).alias("EndDate"),
        F.col("p_type").alias("Type"),
        F.when(F.col("p_size") <= 25, PEAK).otherwise(OFF_PEAK).alias("Class"),
        F.col("p_size").cast("double").alias("MW"),
        (F.col("p_retailprice") / 7).alias("ClearingPrice"),
    )


# SQL side: name -> (names it builds on, body). Written independently of the Spark plans.
_AVG = "sum({0}::DECIMAL(18,2))::DOUBLE / nullif(count({0}), 0)"
_SUM = "sum({0}::DECIMAL(18,2))::DOUBLE"


def _typed(kind: str) -> str:
    return f"CASE WHEN event_type = '{kind}' THEN value END"


def _price_cte(condition: str) -> str:
    return (
        f"SELECT event_type AS node, date_trunc('hour', ts) AS start_time, {_AVG.format('value')} AS lmp "
        f"FROM events WHERE {condition} GROUP BY ALL"
    )


def _fuel_cte(condition: str) -> str:
    fuels = ", ".join(f"{_SUM.format('(' + _typed(k) + ')')} AS {f}" for k, f in FUEL_OF_TYPE.items())
    return (
        f"SELECT date_trunc('hour', ts) AS start_time, {_SUM.format('value')} AS totalMw, {fuels} "
        f"FROM events WHERE {condition} GROUP BY ALL"
    )


CLASS_SQL = """CASE WHEN (month({0}) = 12 AND day({0}) = 25) OR (month({0}) = 1 AND day({0}) = 1) THEN 'Off-peak'
 WHEN isodow({0}) IN (6, 7) THEN 'Off-peak' WHEN hour({0}) >= 6 AND hour({0}) < 22 THEN 'Peak' ELSE 'Off-peak' END"""
SEASON_SQL = "(year({0}) - CASE WHEN month({0}) IN (1, 2) THEN 1 ELSE 0 END)::INTEGER"
BUCKET_SQL = """CASE WHEN {0} IS NULL THEN NULL WHEN {0} <= {1} THEN 'Extreme Cold' WHEN {0} <= 10 THEN 'Very Cold'
 WHEN {0} <= 32 THEN 'Cold' WHEN {0} <= 50 THEN 'Cool' WHEN {0} <= 70 THEN 'Mild'
 WHEN {0} <= 85 THEN 'Hot' ELSE 'Extreme Hot' END"""

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "da": ((), _price_cte("minute(ts) < 30")),
    "rt": ((), _price_cte("minute(ts) >= 30")),
    "expost": ((), _price_cte("TRUE")),
    "dart": (
        ("da", "rt"),
        """SELECT coalesce(da.node, rt.node) AS node, coalesce(da.start_time, rt.start_time) AS start_time,
 da.lmp AS lmp_da_exante, rt.lmp AS lmp_rt_expost, rt.lmp - da.lmp AS lmp_dart_spread
 FROM da FULL JOIN rt ON da.node = rt.node AND da.start_time = rt.start_time""",
    ),
    "regimes": (
        ("dart",),
        """SELECT *, CASE
 WHEN lmp_rt_expost > 180 THEN 'Extreme Event'
 WHEN lmp_da_exante > 80 AND lmp_rt_expost < lmp_da_exante - 40 THEN 'False Scarcity'
 WHEN lmp_da_exante > 80 AND lmp_rt_expost > 80 AND abs(lmp_dart_spread) <= 40 THEN 'Anticipated Scarcity'
 WHEN lmp_rt_expost > 100 AND lmp_dart_spread > 40 THEN 'Unanticipated Scarcity'
 WHEN lmp_da_exante < 5 OR lmp_rt_expost < 5 THEN 'Over-Generation'
 WHEN lmp_da_exante BETWEEN 50 AND 80 OR lmp_rt_expost BETWEEN 50 AND 100 OR abs(lmp_dart_spread) > 15
 THEN 'Moderate Stress' ELSE 'Normal Operations' END AS regime FROM dart""",
    ),
    "marked": (
        ("regimes",),
        """SELECT *, CASE WHEN lag(regime) OVER w IS DISTINCT FROM regime THEN 1 ELSE 0 END AS changed,
 CASE WHEN regime = 'Extreme Event' THEN 1 ELSE 0 END AS extreme,
 CASE WHEN regime IN ('Extreme Event', 'False Scarcity', 'Anticipated Scarcity', 'Unanticipated Scarcity')
 THEN 1 ELSE 0 END AS scarce FROM regimes WINDOW w AS (PARTITION BY node ORDER BY start_time)""",
    ),
    "blocks": (
        ("marked",),
        """SELECT *, sum(changed) OVER w AS run_block, sum(extreme) OVER w AS extreme_block,
 sum(scarce) OVER w AS scarce_block FROM marked
 WINDOW w AS (PARTITION BY node ORDER BY start_time ROWS UNBOUNDED PRECEDING)""",
    ),
    "durations": (
        ("blocks",),
        """SELECT node, start_time, lmp_da_exante, lmp_rt_expost, lmp_dart_spread, regime,
 row_number() OVER (PARTITION BY node, run_block ORDER BY start_time) AS consecutive_regime_hours,
 row_number() OVER (PARTITION BY node, extreme_block ORDER BY start_time) - 1 AS hours_since_extreme,
 row_number() OVER (PARTITION BY node, scarce_block ORDER BY start_time) - 1 AS hours_since_scarcity FROM blocks""",
    ),
    "weather_utc": (
        (),
        f"""SELECT date_trunc('hour', ts) AS utc, {_AVG.format('(' + _typed('view') + ')')} - 30 AS Temperature,
 {_AVG.format('(' + _typed('click') + ')')} AS WindSpeed FROM events GROUP BY ALL""",
    ),
    "weather": (
        ("weather_utc",),
        """SELECT utc - INTERVAL 5 HOUR AS start_time, Temperature, WindSpeed FROM weather_utc""",
    ),
    "features": (
        ("weather",),
        f"""SELECT start_time, Temperature, WindSpeed,
 stddev_samp(WindSpeed) OVER (ORDER BY start_time ROWS 5 PRECEDING) AS WindSpeedVolatility6h,
 {BUCKET_SQL.format('Temperature', -5)} AS TemperatureBucket FROM weather""",
    ),
    "station": (
        (),
        f"""SELECT date_trunc('hour', ts) AS timestamp, {_AVG.format('(' + _typed('view') + ')')} - 30 AS temperature_2m,
 ({_AVG.format('(' + _typed('purchase') + ')')}) * 0.5::DOUBLE AS relative_humidity_2m,
 {_AVG.format('(' + _typed('signup') + ')')} - 60 AS dewpoint_2m,
 {_AVG.format('(' + _typed('error') + ')')} AS precipitation,
 {_AVG.format('(' + _typed('click') + ')')} AS wind_speed_10m FROM events GROUP BY ALL""",
    ),
    "fuel_da": ((), _fuel_cte("minute(ts) < 30")),
    "fuel_rt": ((), _fuel_cte("minute(ts) >= 30")),
    "fuel_pair": (
        ("fuel_da", "fuel_rt"),
        "SELECT start_time, "
        + ", ".join(
            f"d.{c} AS {n}_DA, r.{c} AS {n}_RT, r.{c} - d.{c} AS {n}_Diff, r.{c} / nullif(d.{c}, 0) AS {n}_PctDiff"
            for n, c in (
                ("TotalMW", "totalMw"), ("CoalMW", "coal"), ("GasMW", "gas"),
                ("WindMW", "wind"), ("SolarMW", "solar"), ("NuclearMW", "nuclear"),
            )
        )
        + " FROM fuel_da d JOIN fuel_rt r USING (start_time)",
    ),
    "low_cut": (
        ("fuel_pair",),
        """SELECT (SELECT v FROM (SELECT WindMW_RT AS v, row_number() OVER (ORDER BY WindMW_RT) AS k,
 count(*) OVER () AS n FROM fuel_pair WHERE WindMW_RT IS NOT NULL) WHERE k = round((n - 1) * 0.25::DOUBLE) + 1) AS wind_low,
 (SELECT v FROM (SELECT GasMW_RT AS v, row_number() OVER (ORDER BY GasMW_RT) AS k,
 count(*) OVER () AS n FROM fuel_pair WHERE GasMW_RT IS NOT NULL) WHERE k = round((n - 1) * 0.25::DOUBLE) + 1) AS gas_low""",
    ),
    "fuel": (
        ("fuel_pair", "low_cut"),
        """SELECT *, CASE WHEN WindMW_PctDiff <= 0.8 THEN 1 ELSE 0 END AS WindMissFlag,
 CASE WHEN GasMW_PctDiff <= 0.8 THEN 1 ELSE 0 END AS GasMissFlag,
 CASE WHEN WindMW_RT <= (SELECT wind_low FROM low_cut) THEN 1 ELSE 0 END AS LowWindFlag,
 CASE WHEN GasMW_RT <= (SELECT gas_low FROM low_cut) THEN 1 ELSE 0 END AS LowGasFlag FROM fuel_pair""",
    ),
    "node_hours": (
        ("durations", "features", "fuel"),
        """SELECT d.*, f.* EXCLUDE (start_time), u.* EXCLUDE (start_time) FROM durations d
 LEFT JOIN features f USING (start_time) LEFT JOIN fuel u USING (start_time)""",
    ),
    "loads": (
        (),
        f"""SELECT date_trunc('hour', ts) AS Datetime,
 {_SUM.format('(CASE WHEN minute(ts) < 30 THEN value END)')} AS LoadActual,
 {_SUM.format('(CASE WHEN minute(ts) >= 30 THEN value END)')} AS LoadForecast FROM events GROUP BY ALL""",
    ),
    "errors": (
        ("loads", "weather_utc"),
        f"""SELECT l.*, w.Temperature, w.WindSpeed, {BUCKET_SQL.format('w.Temperature', -10)} AS TemperatureBucket,
 LoadForecast - LoadActual AS Error, LoadForecast < LoadActual AS IsUnderForecast,
 abs(LoadForecast - LoadActual) AS AbsoluteError,
 abs(LoadForecast - LoadActual) / nullif(LoadActual, 0) * 100 AS AbsolutePercentageError
 FROM loads l FULL JOIN weather_utc w ON l.Datetime = w.utc""",
    ),
    "complete": (
        ("errors",),
        """SELECT * FROM errors WHERE LoadActual IS NOT NULL AND LoadForecast IS NOT NULL AND Temperature IS NOT NULL""",
    ),
    "lines": ((), "SELECT *, l_shipdate + to_hours(l_linenumber * 3) AS start_time FROM lineitem"),
    "season_prices": (
        ("lines",),
        f"""SELECT l_returnflag AS node, start_time, {_AVG.format('l_extendedprice')} / {PRICE_SCALE} AS lmp
 FROM lines GROUP BY ALL""",
    ),
    "season_weather": (
        ("lines",),
        f"""SELECT start_time, ({_AVG.format('l_quantity')}) * 2 - 40 AS Temperature,
 ({_AVG.format('l_discount')}) * 100 AS WindSpeed FROM lines GROUP BY ALL""",
    ),
    "winter_prices": (
        ("season_prices",),
        f"""SELECT *, {SEASON_SQL.format('start_time')} AS WinterYear, {CLASS_SQL.format('start_time')} AS Class
 FROM season_prices WHERE month(start_time) IN (12, 1, 2)""",
    ),
    "auction": (
        (),
        """SELECT p_brand AS MarketParticipant, substr('ANR', (p_partkey % 3)::INTEGER + 1, 1) AS Source,
 substr('ANR', ((p_partkey % 3 + 1 + (p_partkey // 3) % 2) % 3)::INTEGER + 1, 1) AS Sink,
 '12/1/' || (1997 + p_size % 3) AS StartDate, '2/28/' || (1998 + p_size % 3) AS EndDate, p_type AS Type,
 CASE WHEN p_size <= 25 THEN 'Peak' ELSE 'Off-peak' END AS Class, p_size::DOUBLE AS MW,
 p_retailprice / 7 AS ClearingPrice, (1997 + p_size % 3)::INTEGER AS season FROM part""",
    ),
    "positions": (
        ("auction",),
        """SELECT Source, Sink, StartDate, EndDate, Type, Class, sum(MW) AS MW,
 sum(ClearingPrice * MW) / nullif(sum(MW), 0) AS ClearingPrice, season AS WinterYear FROM auction GROUP BY ALL""",
    ),
    "held": (
        ("positions",),
        f"""SELECT * FROM positions UNION ALL
 SELECT Source, Sink, replace(StartDate, '{AUCTION_SEASON}', y::VARCHAR), replace(EndDate, '{AUCTION_SEASON + 1}', (y + 1)::VARCHAR),
 Type, Class, MW, ClearingPrice, y::INTEGER FROM positions, unnest({list(BACKFILLED)}) AS t(y)
 WHERE WinterYear = {AUCTION_SEASON}""",
    ),
    "calendar": (
        (),
        """SELECT unnest(range((SELECT make_timestamp(year(min(l_shipdate)) - 1, 12, 1, 0, 0, 0) FROM lineitem),
 (SELECT make_timestamp(year(max(l_shipdate)) + 1, 3, 1, 0, 0, 0) FROM lineitem), INTERVAL 1 HOUR)) AS h""",
    ),
    "class_hours": (
        ("calendar",),
        f"""SELECT {SEASON_SQL.format('h')} AS WinterYear, {CLASS_SQL.format('h')} AS Class, count(*) AS ClassHours
 FROM calendar WHERE month(h) IN (12, 1, 2) GROUP BY ALL""",
    ),
    "pnl": (
        ("held", "winter_prices", "class_hours", "season_weather"),
        """SELECT q.*, PriceSpread * MW AS HourlyCongestionRevenue, PriceSpread * MW - HourlyCost AS HourlyProfitLoss
 FROM (SELECT p.*, s.start_time, s.lmp AS lmp_source, k.lmp AS lmp_sink, c.ClassHours, w.Temperature, w.WindSpeed,
 k.lmp - s.lmp AS PriceSpread, p.ClearingPrice * p.MW AS TotalCost, p.ClearingPrice * p.MW / c.ClassHours AS HourlyCost
 FROM held p JOIN winter_prices s ON s.node = p.Source AND s.Class = p.Class AND s.WinterYear = p.WinterYear
 JOIN winter_prices k ON k.node = p.Sink AND k.start_time = s.start_time
 LEFT JOIN class_hours c ON c.WinterYear = p.WinterYear AND c.Class = p.Class
 LEFT JOIN season_weather w ON w.start_time = s.start_time) q""",
    ),
    "spreads": (
        ("auction", "winter_prices"),
        """SELECT p.Source, p.Sink, s.start_time, s.Class, s.WinterYear, k.lmp - s.lmp AS PriceSpread
 FROM (SELECT DISTINCT Source, Sink FROM auction) p JOIN winter_prices s ON s.node = p.Source
 JOIN winter_prices k ON k.node = p.Sink AND k.start_time = s.start_time""",
    ),
}


def sql(names: str, body: str) -> str:
    """``body`` with the named views and everything they build on in front."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    views = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in ordered)
    return f"WITH {views}\n{body}"
