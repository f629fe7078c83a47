"""Queries over sources, sinks, quality rules and time functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions.timeparts import (
    ISO_MINUTES,
    ISO_SECONDS,
    add_years,
    in_window,
    lookback_window,
    utc_to_market,
    winter_window,
    with_partition_parts,
)
from gridlens.operators import quality
from gridlens.operators.weather import HOURLY_VARIABLES, KEY_VARIABLES
from gridlens.plans.bindings import (
    DA,
    RT,
    SCHEMAS,
    event_fuel,
    event_prices,
    event_station,
    line_hour,
    part_auction,
    sql,
    table,
)
from gridlens.plans.registry import query, r, rounded
from gridlens.session import scratch_dir
from gridlens.sinks import tables as sink
from gridlens.sources.feeds import FEEDS, FUEL_COLUMNS, read_feed, read_nodes
from gridlens.sinks.ingest import ingest_feed, ingest_window, report_table
from gridlens.sources.tables import after_stored_mark, read_rounds
from gridlens.sources.weather import read_weather
from gridlens.streaming.prices import BATCH, PRICE_KEYS, dedupe_stream, ingest_available, upsert_stream

STORED_UNTIL, INCOMING_FROM = date(1999, 1, 1), date(1998, 7, 1)


def _interval(start: str):
    """Landed interval of the hour in column ``start``."""
    text = F.date_format(start, ISO_SECONDS)
    end = F.date_format(F.col(start) + F.expr("INTERVAL 1 HOUR"), ISO_SECONDS)
    return F.struct(
        text.alias("start"), end.alias("end"), F.lit("hourly").alias("resolution"),
        F.hour(start).cast("string").alias("value"),
    )


def _land(records: DataFrame, page_keys: list[str], path: str, by_day: bool = False) -> None:
    """Write one JSON page per key; a page holds the hours of one day, so at most 24 records."""
    pages = records.groupBy(*page_keys).agg(F.collect_list("record").alias("data"))
    text = F.to_json(F.struct("data")).alias("value")
    if by_day:
        pages.select(text, F.col("_d").alias("landed")).write.mode("append").partitionBy("landed").text(path)
    else:
        pages.select(text).write.mode("append").text(path)


def _land_into(rows: DataFrame, feed: str, entity, fields: list, path: str, by_day: bool = False) -> None:
    """Add hourly rows as pages of a feed to a landing folder, with ``by_day`` in a folder per day."""
    spec = FEEDS[feed]
    parts = [] if spec.entity_constant else [F.col(entity).alias(spec.entity)]
    parts += [_interval("start_time").alias(spec.interval), *fields]
    records = rows.select(
        F.col(entity).alias("_e"), F.to_date("start_time").alias("_d"), F.struct(*parts).alias("record")
    )
    _land(records, ["_e", "_d"], path, by_day)


def _land_days(spark: SparkSession, rows: DataFrame, feed: str, entity, fields: list, label: str) -> str:
    """Land hourly rows as pages of a feed; the folder they are in."""
    path = scratch_dir(spark, label)
    _land_into(rows, feed, entity, fields, path)
    return path


def _day_pages(spark: SparkSession, rows: DataFrame, feed: str, entity, fields: list, label: str) -> DataFrame:
    """Land hourly rows as pages of a feed and read them back."""
    return read_feed(spark, _land_days(spark, rows, feed, entity, fields, label), feed)


_TIMES = """start_time, start_time + INTERVAL 1 HOUR AS end_time, 'hourly' AS resolution,
 hour(start_time)::VARCHAR AS interval_value"""
_PARTS = "year(start_time)::INTEGER AS year, month(start_time)::INTEGER AS month, day(start_time)::INTEGER AS day"


@query(
    "lmp_clean",
    f"""SELECT l_orderkey, l_linenumber, lmp, {r('mec')} AS mec, {r('mcc')} AS mcc, {r('mlc')} AS mlc,
 {r('lmp_check')} AS lmp_check, (abs(lmp_check) > 0.05::DOUBLE)::INTEGER AS lmp_check_flag
 FROM (SELECT *, mec + mcc + mlc - lmp AS lmp_check FROM (SELECT l_orderkey, l_linenumber,
 floor(l_extendedprice) AS lmp, l_extendedprice * 0.7::DOUBLE AS mec,
 CASE WHEN l_discount > 0 THEN l_extendedprice * 0.2::DOUBLE END AS mcc,
 l_extendedprice * 0.1::DOUBLE AS mlc FROM lineitem))
 WHERE lmp IS NOT NULL AND mec IS NOT NULL AND mcc IS NOT NULL AND mlc IS NOT NULL""",
)
def lmp_clean(spark, sf_dir):
    """Null filter and component reconciliation of prices."""
    price = F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.floor(price).cast("double").alias("lmp"),
        (price * 0.7).alias("mec"), F.when(F.col("l_discount") > 0, price * 0.2).alias("mcc"),
        (price * 0.1).alias("mlc"),
    )
    return rounded(quality.reconcile_prices(rows))


@query(
    "quality_nonneg",
    """SELECT event_type, count(*) AS rows_before, count(*) FILTER (WHERE value >= 0) AS rows_after,
 count(*) - count(*) FILTER (WHERE value >= 0) AS rows_removed FROM events GROUP BY event_type""",
)
def quality_nonneg(spark, sf_dir):
    """Rows kept and removed by the not-null, not-negative rule."""
    return quality.rule_counts(table(spark, sf_dir, "events"), F.col("value") >= 0, ["event_type"])


@query(
    "capacity_flag",
    """SELECT l_orderkey, l_linenumber, l_extendedprice AS load,
 (l_extendedprice > 20304)::INTEGER AS capacity_flag FROM lineitem WHERE l_extendedprice > 0""",
)
def capacity_flag(spark, sf_dir):
    """Positive loads with a flag above the installed capacity."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("load")
    )
    return quality.with_capacity_flag(quality.keep_positive(rows, "load"), "load", "capacity_flag")


@query(
    "json_flatten",
    sql("da", f"""SELECT node, {_TIMES}, 'F' AS preliminary_final, lmp, lmp * 0.25::DOUBLE AS mcc,
 lmp * 0.5::DOUBLE AS mec, lmp * 0.25::DOUBLE AS mlc, 'da_exante' AS price_type, {_PARTS} FROM da"""),
)
def json_flatten(spark, sf_dir):
    """Landed price pages, flattened and typed."""
    return _day_pages(spark, event_prices(spark, sf_dir, DA), "da_exante", "node", _price_fields(), "prices")


def _price_fields() -> list:
    """Price record whose components add up to the price exactly."""
    parts = [(F.col("lmp") * s).alias(n) for n, s in (("mcc", 0.25), ("mec", 0.5), ("mlc", 0.25))]
    return [F.lit("F").alias("preliminaryFinal"), "lmp", *parts]


# Three deliveries of the streamed market's month: each begins with a day of the one before it at another price, the
# last one also has the first two days of one node, by then behind the watermark.
_FIRST, _SECOND, _THIRD, _HELD = (date(2024, 1, d) for d in (1, 11, 21, 3))
_REPEATED = {2: (date(2024, 1, 10), _SECOND), 3: (date(2024, 1, 20), _THIRD)}
_LATE_NODE, _LATENESS = "click", "3 days 30 minutes"

# Deliveries as SQL: the component gap of some hours, and a missing component in others.
_DELIVERED = f"""delivered AS (
 SELECT *, 0.0::DOUBLE AS raised, CASE WHEN node = '{_LATE_NODE}' AND start_time < '{_HELD}' THEN 3 WHEN start_time < '{_SECOND}' THEN 1
  WHEN start_time < '{_THIRD}' THEN 2 ELSE 3 END AS batch FROM da
 UNION ALL SELECT *, 1, 2 FROM da WHERE start_time >= '{_REPEATED[2][0]}' AND start_time < '{_SECOND}'
 UNION ALL SELECT *, 1, 3 FROM da WHERE start_time >= '{_REPEATED[3][0]}' AND start_time < '{_THIRD}'),
 parts AS (SELECT node, start_time, batch, raised, lmp + raised AS lmp, (lmp + raised) * 0.5::DOUBLE
  + CASE WHEN hour(start_time) % 6 = 5 THEN 1 ELSE 0 END AS mec,
  NOT (hour(start_time) = 3 AND day(start_time) % 5 = 0) AS complete FROM delivered),
 flagged AS (SELECT *, CASE WHEN hour(start_time) % 6 = 5 THEN 1 ELSE 0 END AS bad,
  batch = 3 AND start_time < '{_HELD}' AS late FROM parts)"""


def _deliveries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Price rows of the three deliveries."""
    rows = event_prices(spark, sf_dir, DA)
    ts = F.col("start_time")
    held = (F.col("node") == _LATE_NODE) & (ts < F.lit(_HELD))

    def again(batch: int) -> DataFrame:
        return rows.where(in_window(ts, *_REPEATED[batch])).withColumn("lmp", F.col("lmp") + 1)

    return [
        rows.where(in_window(ts, _FIRST, _SECOND) & ~held),
        rows.where(in_window(ts, _SECOND, _THIRD)).unionByName(again(2)),
        rows.where((ts >= F.lit(_THIRD)) | held).unionByName(again(3)),
    ]


def _uneven_fields(price: str = "lmp") -> list:
    """Price record of which some hours do not reconcile and others miss a component."""
    ts, lmp = F.col("start_time"), F.col(price)
    extra = F.when(F.hour(ts) % 6 == 5, 1).otherwise(0)
    missing = (F.hour(ts) == 3) & (F.dayofmonth(ts) % 5 == 0)
    return [
        F.lit("F").alias("preliminaryFinal"), lmp.alias("lmp"), F.when(~missing, lmp * 0.25).alias("mcc"),
        (lmp * 0.5 + extra).alias("mec"), (lmp * 0.25).alias("mlc"),
    ]


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[str, list[tuple[int, ...]]]:
    """Land the deliveries one after the other and stream each; the table and a row of counters per delivery."""
    landing, path, checkpoint = (scratch_dir(spark, label) for label in ("landing", "stream", "checkpoint"))
    log = []
    for number, rows in enumerate(_deliveries(spark, sf_dir), 1):
        _land_into(rows, "da_exante", "node", _uneven_fields(), landing)
        for _, *counts in ingest_available(spark, landing, path, checkpoint, "da_exante", _LATENESS):
            log.append((number, *counts))
    return path, log


@query(
    "stream_price_ingest",
    sql("da", f"""SELECT * FROM da""").replace("\nSELECT * FROM da", f""",
 {_DELIVERED}
 SELECT node, start_time, lmp, {r('mec')} AS mec, bad::DOUBLE AS lmp_check, bad AS lmp_check_flag, 'da_exante' AS price_type, {_PARTS}
 FROM flagged WHERE raised = 0 AND complete AND NOT late"""),
)
def stream_price_ingest(spark, sf_dir):
    """Price pages delivered three times, streamed through flattening, quality rules, deduplication and upsert."""
    path, _ = _streamed(spark, sf_dir)
    stored = spark.read.parquet(path).withColumn("lmp_check", F.round("lmp_check", 6) + F.lit(0.0))
    return rounded(stored.select(
        "node", "start_time", "lmp", "mec", "lmp_check", "lmp_check_flag", "price_type", "year", "month", "day"
    ), keep=("lmp", "lmp_check"))


@query(
    "stream_batch_log",
    sql("da", f"""SELECT * FROM da""").replace("\nSELECT * FROM da", f""",
 {_DELIVERED}
 SELECT batch::BIGINT AS batch, count(*) AS rows_read, count(*) FILTER (WHERE complete) AS rows_kept,
 count(*) FILTER (WHERE NOT complete) AS rows_removed, count(*) FILTER (WHERE complete AND bad = 1) AS rows_mismatched,
 count(*) FILTER (WHERE complete AND late) AS rows_late, count(*) FILTER (WHERE complete AND raised = 1) AS rows_repeated,
 count(*) FILTER (WHERE complete AND raised = 0 AND NOT late) AS rows_inserted FROM flagged GROUP BY batch"""),
)
def stream_batch_log(spark, sf_dir):
    """Rows read, kept, removed, mismatched, late, repeated and inserted by each of three streamed deliveries."""
    _, log = _streamed(spark, sf_dir)
    return spark.createDataFrame(log, BATCH).drop("state_rows")


def _fuel_sql(view: str, tag: str) -> str:
    fuels = ", ".join(
        f"{c} AS {c}" if c in ("coal", "gas", "nuclear", "wind", "solar") else f"NULL::DOUBLE AS {c}"
        for c in FUEL_COLUMNS
    )
    return f"SELECT 'NORTH' AS region, {_TIMES}, totalMw, {fuels}, '{tag}' AS demand_type, {_PARTS} FROM {view}"


@query(
    "fuel_scan",
    sql("fuel_da fuel_rt", _fuel_sql("fuel_da", "da_fuel_mix") + " UNION ALL " + _fuel_sql("fuel_rt", "rt_fuel_mix")),
)
def fuel_scan(spark, sf_dir):
    """Day-ahead and real-time fuel mix pages with their second nested struct."""
    frames = []
    for market, feed in ((DA, "da_fuel_mix"), (RT, "rt_fuel_mix")):
        mix = event_fuel(spark, sf_dir, market)
        known = [F.col(c) if c in mix.columns else F.lit(None).cast("double").alias(c) for c in FUEL_COLUMNS]
        fields = ["totalMw", F.struct(*known).alias("fuelTypes")]
        frames.append(_day_pages(spark, mix, feed, "region", fields, feed))
    return frames[0].unionByName(frames[1])


_MID, _OVERLAP = date(2024, 1, 16), date(2024, 1, 11)

# Two landings of a feed: the first half of the month, then all from some days before it on, each value raised by one.
_LANDINGS = f"""landed AS (SELECT *, 1 AS run FROM base WHERE start_time < '{_MID}'
 UNION ALL SELECT * REPLACE (value + 1 AS value), 2 FROM base WHERE start_time >= '{_OVERLAP}')"""
_PRICE_BASE = """base AS (SELECT node AS entity, start_time, lmp AS value, NOT (hour(start_time) = 3 AND day(start_time) % 5 = 0) AS keep,
 hour(start_time) % 6 = 5 AS bad FROM da)"""


def _amount_base(view: str, entity: str, column: str) -> str:
    """SQL of an amount feed: present, negative in some hours and missing in others."""
    return f"""base AS (SELECT '{entity}' AS entity, start_time, {column} AS value,
 coalesce({column} >= 0, FALSE) AND hour(start_time) % 8 NOT IN (1, 2) AS keep, FALSE AS bad FROM {view})"""


def _ingest_sql(view: str, base: str, feed: str, sink_kind: str) -> str:
    """SQL of two runs' reports and of the table after each."""
    held = {
        "upsert": "(run = 1 OR (n = 2 AND start_time >= '{mid}'))", "overwrite": "run = n", "append": "(run = n OR start_time < '{over}')",
        "overwrite_partitions": "(run = n OR start_time < '{over}')",
    }[sink_kind].format(mid=_MID, over=_OVERLAP)
    fresh = "(run = n AND (n = 1 OR start_time >= '{mid}'))".format(mid=_MID) if sink_kind == "upsert" else "run = n"
    return sql(view, f"""SELECT * FROM {view}""").replace(f"\nSELECT * FROM {view}", f""",
 {base}, {_LANDINGS}
 SELECT n AS run, '{feed}' AS feed, '{sink_kind}' AS sink, count(*) FILTER (WHERE run = n) AS rows_read,
 count(*) FILTER (WHERE run = n AND keep) AS rows_kept, count(*) FILTER (WHERE run = n AND NOT keep) AS rows_removed,
 count(*) FILTER (WHERE run = n AND keep AND bad) AS rows_mismatched, count(*) FILTER (WHERE keep AND {fresh}) AS rows_written,
 count(*) FILTER (WHERE keep AND run <= n AND {held}) AS stored_rows,
 {r(f'sum(value) FILTER (WHERE keep AND run <= n AND {held})', 4)} AS stored_sum
 FROM landed, (VALUES (1), (2)) t(n) GROUP BY n""")


def _ingest_runs(spark, rows: DataFrame, feed: str, entity, fields: list, value: str, sink_kind: str | None = None) -> DataFrame:
    """Land rows twice, each landing in a folder of its own, run the job after each; the reports and the table's state."""
    path = scratch_dir(spark, feed)
    ts, out = F.col("start_time"), []
    later = rows.where(ts >= F.lit(_OVERLAP)).withColumn("_value", F.col("_value") + 1)
    for run, landed in enumerate((rows.where(ts < F.lit(_MID)), later), 1):
        landing = _land_days(spark, landed, feed, entity, fields, f"{feed}-{run}")
        report = ingest_feed(spark, landing, path, feed, sink_kind)
        state = spark.read.parquet(path).agg(F.count(F.lit(1)), F.round(F.sum(value), 4)).first()
        out.append(report_table(spark, [report]).drop("days").select(
            F.lit(run).alias("run"), "*", F.lit(state[0]).cast("long").alias("stored_rows"), (F.lit(state[1]) + F.lit(0.0)).alias("stored_sum")
        ))
    return out[0].unionByName(out[1])


def _amount(column: str = "_value"):
    """A measure that is negative in some hours and missing in others."""
    hour = F.hour("start_time") % 8
    return F.when(hour == 1, -F.col(column)).when(hour != 2, F.col(column))


@query("ingest_upsert", _ingest_sql("da", _PRICE_BASE, "da_exante", "upsert"))
def ingest_upsert(spark, sf_dir):
    """Prices: rule with component check, stored rows stay, unknown hours are added; counters of the same pass."""
    rows = event_prices(spark, sf_dir, DA).withColumnRenamed("lmp", "_value")
    return _ingest_runs(spark, rows, "da_exante", "node", _uneven_fields("_value"), "lmp")


@query("ingest_overwrite", _ingest_sql("fuel_da", _amount_base("fuel_da", "NORTH", "coal"), "da_cleared_demand", "overwrite"))
def ingest_overwrite(spark, sf_dir):
    """Day-ahead demand: missing and negative amounts removed, the table replaced."""
    rows = event_fuel(spark, sf_dir, DA).withColumnRenamed("coal", "_value")
    fields = [_amount().alias("fixed"), F.col("gas").alias("priceSens"), F.col("wind").alias("virtual")]
    return _ingest_runs(spark, rows, "da_cleared_demand", "region", fields, "fixed")


@query(
    "ingest_partitions",
    _ingest_sql("fuel_rt", _amount_base("fuel_rt", "MISO", "totalMw"), "rt_cleared_demand", "overwrite_partitions"),
)
def ingest_partitions(spark, sf_dir):
    """Real-time demand: only the days that were landed are replaced."""
    rows = event_fuel(spark, sf_dir, RT).withColumnRenamed("totalMw", "_value")
    return _ingest_runs(spark, rows, "rt_cleared_demand", "region", [_amount().alias("demand")], "demand", "overwrite_partitions")


@query("ingest_append", _ingest_sql("fuel_rt", _amount_base("fuel_rt", "NORTH", "totalMw"), "rt_fuel_mix", "append"))
def ingest_append(spark, sf_dir):
    """Fuel mix with landed rows winning over stored ones."""
    rows = event_fuel(spark, sf_dir, RT).withColumnRenamed("totalMw", "_value")
    known = [F.col(c) if c in rows.columns else F.lit(None).cast("double").alias(c) for c in FUEL_COLUMNS]
    fields = [_amount().alias("totalMw"), F.struct(*known).alias("fuelTypes")]
    return _ingest_runs(spark, rows, "rt_fuel_mix", "region", fields, "totalMw", "append")


@query(
    "newest_load",
    sql("da", """SELECT node, start_time, lmp + CASE WHEN day(start_time) % 2 = 0 THEN 0 ELSE 100 END AS lmp, 0 AS lmp_check_flag FROM da"""),
)
def newest_load(spark, sf_dir):
    """Two landings of the same hours in one folder: the later one's lower price stays."""
    rows = event_prices(spark, sf_dir, DA)
    landing, path = scratch_dir(spark, "landing"), scratch_dir(spark, "prices")
    _land_into(rows.withColumn("lmp", F.col("lmp") + 100), "da_exante", "node", _price_fields(), landing)
    _land_into(rows.where(F.dayofmonth("start_time") % 2 == 0), "da_exante", "node", _price_fields(), landing)
    ingest_feed(spark, landing, path, "da_exante")
    return spark.read.parquet(path).select("node", "start_time", "lmp", "lmp_check_flag")


_TODAY = (date(2024, 1, 8), date(2024, 1, 12), date(2024, 1, 12))
_LOOKBACK = (5, 7, 7)


@query(
    "ingest_window",
    sql("da", "SELECT * FROM da").replace("\nSELECT * FROM da", f""",
 {_PRICE_BASE}, taken AS (SELECT *, CASE WHEN day(start_time) BETWEEN 3 AND 7 THEN 1 WHEN day(start_time) BETWEEN 8 AND 11 THEN 2 END AS run FROM base)
 SELECT n AS run, 'da_exante' AS feed, 'window' AS sink, count(*) FILTER (WHERE run = n) AS rows_read,
 count(*) FILTER (WHERE run = n AND keep) AS rows_kept, count(*) FILTER (WHERE run = n AND NOT keep) AS rows_removed,
 count(*) FILTER (WHERE run = n AND keep AND bad) AS rows_mismatched, count(*) FILTER (WHERE run = n AND keep) AS rows_written,
 [5, 4, 0][n] AS days, count(*) FILTER (WHERE run <= n AND keep) AS stored_rows
 FROM taken, (VALUES (1), (2), (3)) t(n) GROUP BY n"""),
)
def ingest_window_query(spark, sf_dir):
    """Lookback windows on three days: each run fetches only days that are not stored; the last finds none."""
    landing, path = scratch_dir(spark, "landing"), scratch_dir(spark, "prices")
    _land_into(event_prices(spark, sf_dir, DA), "da_exante", "node", _uneven_fields(), landing, by_day=True)
    out = []
    for run, (today, days) in enumerate(zip(_TODAY, _LOOKBACK), 1):
        report = ingest_window(spark, landing, path, "da_exante", *lookback_window(days, today))
        stored = spark.read.parquet(path).count()
        out.append(report_table(spark, [report]).select(F.lit(run).alias("run"), "*", F.lit(stored).cast("long").alias("stored_rows")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "demand_scan",
    sql("fuel_da fuel_rt", f"""SELECT 'NORTH' AS region, {_TIMES}, coal AS fixed, gas AS priceSens, wind AS virtual,
 NULL::DOUBLE AS demand, 'da_cleared_demand' AS demand_type, {_PARTS} FROM fuel_da WHERE coal >= 0
 UNION ALL SELECT 'MISO', {_TIMES}, NULL, NULL, NULL, totalMw, 'rt_cleared_demand', {_PARTS}
 FROM fuel_rt WHERE totalMw >= 0"""),
)
def demand_scan(spark, sf_dir):
    """Day-ahead demand by region and real-time demand of the whole market."""
    ahead = _day_pages(
        spark, event_fuel(spark, sf_dir, DA), "da_cleared_demand", "region",
        [F.col("coal").alias("fixed"), F.col("gas").alias("priceSens"), F.col("wind").alias("virtual")],
        "da-demand",
    )
    real = _day_pages(
        spark, event_fuel(spark, sf_dir, RT), "rt_cleared_demand", "region",
        [F.col("totalMw").alias("demand")], "rt-demand",
    )
    return quality.keep_non_negative(ahead, "fixed").unionByName(
        quality.keep_non_negative(real, "demand"), allowMissingColumns=True
    )


@query(
    "generation_scan",
    sql("fuel_da fuel_rt", f"""SELECT 'NORTH' AS region, {_TIMES}, totalMw AS supply,
 'da_cleared_generation_phys' AS demand_type, {_PARTS} FROM fuel_da WHERE totalMw >= 0
 UNION ALL SELECT 'NO_REGION', {_TIMES}, nuclear, 'da_cleared_generation_virtual', {_PARTS}
 FROM fuel_rt WHERE nuclear >= 0"""),
)
def generation_scan(spark, sf_dir):
    """Physical generation by region and virtual generation without one."""
    physical = _day_pages(
        spark, event_fuel(spark, sf_dir, DA), "da_cleared_generation_phys", "region",
        [F.col("totalMw").alias("supply")], "phys",
    )
    virtual = _day_pages(
        spark, event_fuel(spark, sf_dir, RT), "da_cleared_generation_virtual", "region",
        [F.col("nuclear").alias("supply")], "virtual",
    )
    return quality.keep_non_negative(physical.unionByName(virtual), "supply")


@query(
    "node_list",
    """SELECT page_fetched, nodeType, count(*) AS nodes, min(name) AS first_name FROM
 (SELECT c_name AS name, c_mktsegment AS nodeType, (c_custkey // 1000 + 1)::INTEGER AS page_fetched FROM customer)
 GROUP BY ALL""",
)
def node_list(spark, sf_dir):
    """Node pages read with their page number; node types per page."""
    path = scratch_dir(spark, "nodes")
    record = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("nodeType"))
    (
        table(spark, sf_dir, "customer")
        .select(
            F.to_json(F.struct(F.array(record).alias("data"))).alias("value"),
            (F.floor(F.col("c_custkey") / 1000) + 1).cast("int").alias("page_fetched"),
        )
        .hint("rebalance", "page_fetched")
        .write.partitionBy("page_fetched")
        .text(path)
    )
    nodes = read_nodes(spark, path, "name string, nodeType string")
    return nodes.groupBy("page_fetched", "nodeType").agg(
        F.count(F.lit(1)).alias("nodes"), F.min("name").alias("first_name")
    )


@query(
    "arrays_inline",
    sql("station", """SELECT timestamp, 'KMSP' AS station_id, 44.882::DOUBLE AS latitude, -93.2218::DOUBLE AS longitude,
 temperature_2m, relative_humidity_2m, dewpoint_2m, precipitation, wind_speed_10m, rain,
 year(timestamp)::INTEGER AS year, month(timestamp)::INTEGER AS month, day(timestamp)::INTEGER AS day
 FROM (SELECT *, NULL::DOUBLE AS rain FROM station)"""),
)
def arrays_inline(spark, sf_dir):
    """Column-oriented weather documents, one per month, turned into rows."""
    station = event_station(spark, sf_dir)
    # A document holds the hours of one month, so at most 744 elements per array.
    hours = F.sort_array(F.collect_list(F.struct("timestamp", *KEY_VARIABLES)))
    monthly = station.groupBy(F.date_trunc("month", "timestamp").alias("_m")).agg(hours.alias("_h"))
    arrays = [
        F.transform("_h", lambda h: F.date_format(h["timestamp"], ISO_MINUTES)).alias("time"),
        *[F.col(f"_h.{v}").alias(v) for v in HOURLY_VARIABLES if v in KEY_VARIABLES],
    ]
    path = scratch_dir(spark, "weather")
    monthly.select(F.to_json(F.struct(F.struct(*arrays).alias("hourly")))).write.text(path)
    return read_weather(spark, path).select(
        "timestamp", "station_id", "latitude", "longitude", *KEY_VARIABLES, "rain", "year", "month", "day"
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return with_partition_parts(rows, "o_orderdate").drop("day")


def _stored(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir).where(F.col("o_orderdate") < F.lit(STORED_UNTIL))


def _incoming(spark, sf_dir) -> DataFrame:
    """Later orders with a changed price, so that a kept row shows which side it came from."""
    rows = _orders(spark, sf_dir).where(F.col("o_orderdate") >= F.lit(INCOMING_FROM))
    return rows.withColumn("o_totalprice", F.col("o_totalprice") + 1)


_ORDER_PARTS = "o_orderdate, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month"


@query(
    "insert_only_upsert",
    f"""SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, {_ORDER_PARTS} FROM orders s
 WHERE o_orderdate >= '1998-07-01' AND NOT EXISTS (SELECT 1 FROM orders t
 WHERE t.o_orderdate < '1999-01-01' AND t.o_orderkey = s.o_orderkey)""",
)
def insert_only_upsert(spark, sf_dir):
    """Rows an insert-only upsert adds: incoming keys that are not stored."""
    unique = quality.latest_per_key(_incoming(spark, sf_dir), ["o_orderkey"], ["o_orderdate"])
    return sink.new_rows(unique, _stored(spark, sf_dir), ["o_orderkey"], ["year", "month"])


@query(
    "create_or_upsert",
    f"""SELECT o_orderkey, CASE WHEN o_orderdate < '1999-01-01' THEN o_totalprice ELSE o_totalprice + 1 END
 AS o_totalprice, {_ORDER_PARTS} FROM orders""",
)
def create_or_upsert(spark, sf_dir):
    """A table created by the first load; stored rows survive the second."""
    path = scratch_dir(spark, "orders")
    for rows in (_stored(spark, sf_dir), _incoming(spark, sf_dir)):
        sink.create_or_upsert(spark, rows, path, ["o_orderkey"], ["o_orderdate"])
    return spark.read.parquet(path)


@query(
    "append_dedupe",
    f"""SELECT o_orderkey, CASE WHEN o_orderdate < '1998-07-01' THEN o_totalprice ELSE o_totalprice + 1 END
 AS o_totalprice, {_ORDER_PARTS} FROM orders""",
)
def append_dedupe(spark, sf_dir):
    """Append in which incoming rows replace stored ones."""
    path = scratch_dir(spark, "orders")
    sink.overwrite_table(_stored(spark, sf_dir), path)
    sink.append_deduped(spark, _incoming(spark, sf_dir), path, ["o_orderkey"])
    return spark.read.parquet(path)


@query(
    "partition_overwrite",
    f"""SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1998 THEN o_totalprice * 2 ELSE o_totalprice END
 AS o_totalprice, {_ORDER_PARTS} FROM orders""",
)
def partition_overwrite(spark, sf_dir):
    """Only the partitions of one year are replaced."""
    path = scratch_dir(spark, "orders")
    rows = _orders(spark, sf_dir)
    sink.overwrite_table(rows, path)
    doubled = rows.where("year = 1998").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    sink.overwrite_partitions(doubled, path)
    return spark.read.parquet(path)


@query(
    "high_water_mark",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >
 (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < '1999-01-01')""",
)
def high_water_mark(spark, sf_dir):
    """Incoming rows later than the newest stored one, found in the newest stored partition."""
    path = scratch_dir(spark, "orders")
    sink.overwrite_table(_stored(spark, sf_dir), path)
    rows = after_stored_mark(spark, _incoming(spark, sf_dir), path, "o_orderdate")
    return rows.select("o_orderkey", "o_orderdate")


@query(
    "date_window",
    """SELECT year(o_orderdate)::INTEGER AS year,
 count(*) FILTER (WHERE o_orderdate >= '1997-12-01' AND o_orderdate < '1998-03-01') AS in_winter,
 count(*) FILTER (WHERE o_orderdate >= '1998-06-20' AND o_orderdate < '1998-07-01') AS in_lookback,
 count(*) FILTER (WHERE o_orderdate BETWEEN '1997-01-01' AND '1998-06-30') AS in_closed,
 count(*) FILTER (WHERE year(o_orderdate) BETWEEN 1997 AND 1999) AS in_years FROM orders GROUP BY 1""",
)
def date_window(spark, sf_dir):
    """Orders inside a winter season, a lookback, a closed window and a year range."""
    day, today = F.col("o_orderdate"), date(1998, 7, 1)
    return table(spark, sf_dir, "orders").groupBy(F.year(day).alias("year")).agg(
        F.count_if(in_window(day, *winter_window(1997, today))).alias("in_winter"),
        F.count_if(in_window(day, *lookback_window(11, today))).alias("in_lookback"),
        F.count_if(day.between(F.lit(date(1997, 1, 1)), F.lit(date(1998, 6, 30)))).alias("in_closed"),
        F.count_if(F.year(day).between(1997, 1999)).alias("in_years"),
    )


@query("dedupe_rows", "SELECT DISTINCT * FROM lineitem")
def dedupe_rows(spark, sf_dir):
    """Whole-row deduplication."""
    return table(spark, sf_dir, "lineitem").dropDuplicates()


@query(
    "null_filters",
    sql("errors", """SELECT count(*) AS hours,
 count(*) FILTER (WHERE LoadActual IS NULL OR LoadForecast IS NULL) AS either_null,
 count(*) FILTER (WHERE LoadActual IS NOT NULL AND LoadForecast IS NOT NULL AND Temperature IS NOT NULL) AS complete
 FROM errors"""),
)
def null_filters(spark, sf_dir):
    """Hours with either load missing, and complete hours."""
    from gridlens.plans.load_queries import load_weather

    rows = load_weather(spark, sf_dir)
    either = quality.any_null(["LoadActual", "LoadForecast"])
    complete = ~quality.any_null(["LoadActual", "LoadForecast", "Temperature"])
    return rows.agg(
        F.count(F.lit(1)).alias("hours"), F.count_if(either).alias("either_null"),
        F.count_if(complete).alias("complete"),
    )


@query(
    "null_counts_by_day",
    sql("station", """SELECT date_trunc('day', timestamp)::TIMESTAMP AS day, count(*) AS total_count,
 count(*) - count(temperature_2m) AS null_temperature_2m, count(*) - count(wind_speed_10m) AS null_wind_speed_10m,
 count(*) - count(precipitation) AS null_precipitation FROM station GROUP BY 1"""),
)
def null_counts_by_day(spark, sf_dir):
    """Missing values per day and variable."""
    daily = event_station(spark, sf_dir).withColumn(
        "day", F.date_trunc("day", "timestamp").cast("timestamp_ntz")
    )
    return quality.null_counts(daily, ["temperature_2m", "wind_speed_10m", "precipitation"], ["day"])


_FLAGS = """dewpoint_2m > temperature_2m AS dew_gt_temp_flag,
 temperature_2m < -60 OR temperature_2m > 120 AS temp_out_of_bounds_flag, wind_speed_10m < 0 AS neg_wind_speed_flag,
 wind_speed_10m > 200 AS excessive_wind_speed_flag,
 relative_humidity_2m < 0 OR relative_humidity_2m > 100 AS rh_out_of_bounds_flag"""
_ALL_VALUES = " AND ".join(f"{v} IS NOT NULL" for v in KEY_VARIABLES)


def _flagged(spark, sf_dir) -> DataFrame:
    rows = event_station(spark, sf_dir).dropna(subset=list(KEY_VARIABLES))
    return rows.withColumns(
        quality.weather_flags("temperature_2m", "dewpoint_2m", "wind_speed_10m", "relative_humidity_2m")
    )


FLAG_NAMES = [
    "dew_gt_temp_flag", "temp_out_of_bounds_flag", "neg_wind_speed_flag",
    "excessive_wind_speed_flag", "rh_out_of_bounds_flag",
]


@query(
    "bounds_flags",
    sql("station", f"""SELECT timestamp, {', '.join(KEY_VARIABLES)}, {', '.join(FLAG_NAMES)} FROM
 (SELECT *, {_FLAGS} FROM station WHERE {_ALL_VALUES})
 WHERE NOT (dew_gt_temp_flag OR temp_out_of_bounds_flag OR neg_wind_speed_flag OR rh_out_of_bounds_flag)"""),
)
def bounds_flags(spark, sf_dir):
    """Weather rows without an impossible value; excessive wind is kept."""
    errors = [f for f in FLAG_NAMES if f != "excessive_wind_speed_flag"]
    return quality.drop_flagged(_flagged(spark, sf_dir), errors)


@query(
    "anomaly_rates",
    sql("station", "SELECT flag, flagged, " + r("CASE WHEN n > 0 THEN 100.0::DOUBLE * flagged / n ELSE 0 END") + f""" AS pct FROM (
 UNPIVOT (SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {f}) AS {f}' for f in FLAG_NAMES)}
 FROM (SELECT {_FLAGS} FROM station WHERE {_ALL_VALUES})) ON {', '.join(FLAG_NAMES)} INTO NAME flag VALUE flagged)"""),
)
def anomaly_rates(spark, sf_dir):
    """Count and percent of rows per anomaly flag."""
    return rounded(quality.flag_rates(_flagged(spark, sf_dir), FLAG_NAMES))


@query(
    "parquet_scan",
    """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
 WHERE o_orderdate >= '1997-12-01' AND o_orderdate < '1998-03-01'""",
)
def parquet_scan(spark, sf_dir):
    """Time slice of a partitioned table written from the whole of orders, partitions pruned."""
    from gridlens.sources.tables import read_window

    path = scratch_dir(spark, "orders")
    sink.overwrite_table(_orders(spark, sf_dir), path)
    window = read_window(spark, path, "o_orderdate", date(1997, 12, 1), date(1998, 3, 1))
    return window.select("o_orderkey", "o_orderdate", "o_totalprice")


@query(
    "csv_rounds",
    sql("auction", f"""SELECT season AS year, (MW::INTEGER // 3 % 3 + 1)::INTEGER AS round, Source, Sink, Class, StartDate,
 count(*) AS awards, sum(MW) AS mw, {r('sum(ClearingPrice)', 4)} AS price_sum FROM auction GROUP BY ALL"""),
)
def csv_rounds(spark, sf_dir):
    """Three rounds of three years written as CSV from one scan, read back in one scan that tells them apart by path."""
    folder = scratch_dir(spark, "auction")
    awards = part_auction(spark, sf_dir)
    number = (F.floor(F.col("MW") / 3) % 3 + 1).cast("string")
    named = awards.withColumn("file", F.concat(F.lit("auction_"), F.substring("StartDate", -4, 4), F.lit("_round_"), number))
    named.hint("rebalance", "file").write.partitionBy("file").option("header", True).csv(folder)
    grouped = read_rounds(spark, f"{folder}/*").groupBy("year", "round", "Source", "Sink", "Class", "StartDate").agg(
        F.count(F.lit(1)).alias("awards"), F.sum("MW").alias("mw"),
        F.sum("ClearingPrice").alias("price_sum"),
    )
    return rounded(grouped, 4)


@query(
    "tz_convert",
    sql("lines", """SELECT start_time, start_time - CASE WHEN start_time >= spring AND start_time < autumn
 THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS market_time, rows FROM (SELECT start_time, count(*) AS rows,
 make_timestamp(year(start_time), 4, 1, 7, 0, 0)
 + to_days(((7 - isodow(make_date(year(start_time), 4, 1))) % 7)::INTEGER) AS spring,
 make_timestamp(year(start_time), 10, 31, 6, 0, 0)
 - to_days((isodow(make_date(year(start_time), 10, 31)) % 7)::INTEGER) AS autumn
 FROM lines GROUP BY start_time)"""),
)
def tz_convert(spark, sf_dir):
    """UTC hours on the market's wall clock, daylight saving included."""
    hours = table(spark, sf_dir, "lineitem").groupBy(line_hour().alias("start_time")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return hours.select("start_time", utc_to_market(F.col("start_time")).alias("market_time"), "rows")


@query(
    "add_years",
    """SELECT o_orderkey, o_orderdate - INTERVAL 3 YEAR AS three_back,
 o_orderdate + INTERVAL 1 YEAR AS one_ahead FROM orders""",
)
def add_years_query(spark, sf_dir):
    """Dates shifted by whole years with the 29 February fallback."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        add_years(day, -3).cast("timestamp_ntz").alias("three_back"),
        add_years(day, 1).cast("timestamp_ntz").alias("one_ahead"),
    )


@query(
    "stream_dedupe",
    """SELECT DISTINCT event_type AS node, date_trunc('hour', ts) AS start_time,
 year(ts)::INTEGER AS year, month(ts)::INTEGER AS month FROM events""",
)
def stream_dedupe(spark, sf_dir):
    """Events streamed through deduplication and the insert-only sink; the stored keys."""
    events = spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    hours = events.select(
        F.col("event_type").alias("node"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start_time"),
    )
    keyed = with_partition_parts(hours, "start_time").drop("day")
    unique = dedupe_stream(keyed, PRICE_KEYS, "start_time", lateness="60 days")
    path, checkpoint = scratch_dir(spark, "stream"), scratch_dir(spark, "checkpoint")
    upsert_stream(unique, path, checkpoint, PRICE_KEYS, ["start_time"]).awaitTermination()
    return spark.read.parquet(path)
