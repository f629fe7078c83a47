"""CSV reports and Parquet tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.functions.timeparts import prune_to_window
from gridlens.operators.load import ACTUAL, FORECAST, ZONE

REPORT_SCHEMA = f"MarketDay string, HourEnding string, `{ZONE}` string, `{FORECAST}` string, `{ACTUAL}` string"
AUCTION_SCHEMA = (
    "MarketParticipant string, Source string, Sink string, StartDate string, EndDate string, "
    "Type string, Class string, MW double, ClearingPrice double"
)

# Errors that mean that no table is there yet: no folder, or one without data files.
NOT_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


# Date forms of report exports, tried in order.
DAY_FORMS = ("yyyy-MM-dd", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd")


def _number(name: str) -> Column:
    """Text as a number; marks between thousands are skipped."""
    return F.regexp_replace(F.trim(F.col(f"`{name}`")), ",", "").try_cast("double")


def _shape(form: str) -> str:
    """Pattern of the texts that a date form can read; a single letter stands for one or two digits."""
    runs = [m.group() for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", form)]

    def piece(run: str) -> str:
        if run.startswith("'"):
            return re.escape(run.strip("'"))
        if not run[0].isalpha():
            return re.escape(run)
        if run[0] not in "yMdHhms" or run.startswith("MMM"):
            return ".+"
        return r"\d{1,2}" if len(run) == 1 else rf"\d{{{len(run)}}}"

    return "^" + "".join(map(piece, runs)) + "$"


def _day(text: Column, forms: Sequence[str]) -> Column:
    """The first form that reads the text. Its shape is looked at first: a failing parse costs far more."""
    return F.coalesce(*[F.when(text.rlike(_shape(form)), F.try_to_date(text, form)) for form in forms])


def read_load_report(spark: SparkSession, paths, day_forms: Sequence[str] = DAY_FORMS) -> DataFrame:
    """Load report exports without preamble and repeated header rows.

    Everything is read as text. Dropped are lines with nothing beside the first field and lines that
    repeat the header; every other line is data. A day in none of ``day_forms`` is NULL, so such lines
    can be counted (:func:`unread_lines`) instead of being lost.
    """
    lines = spark.read.schema(REPORT_SCHEMA).option("header", False).csv(paths)
    first, *others = [F.col(f"`{c}`") for c in lines.columns]
    empty = F.coalesce(*others).isNull()
    header = F.coalesce(F.lower(F.regexp_replace(first, r"[^A-Za-z]", "")) == "marketday", F.lit(False))
    day = _day(F.trim(first), day_forms)
    return lines.where(~empty & ~header).select(
        day.alias("MarketDay"),
        _number("HourEnding").cast("int").alias("HourEnding"),
        ZONE,
        *[_number(c).alias(c) for c in (FORECAST, ACTUAL)],
    )


def unread_lines(report: DataFrame) -> int:
    """Data lines of a report whose day or hour could not be read."""
    return report.where(F.col("MarketDay").isNull() | F.col("HourEnding").isNull()).count()


def auction_paths(folder: str, template: str, years, rounds) -> list[str]:
    """File names of several auction rounds; ``template`` uses ``{year}`` and ``{round}``."""
    return [f"{folder}/{template.format(year=y, round=r)}" for r in rounds for y in years]


def read_auctions(spark: SparkSession, paths) -> DataFrame:
    """All rounds in one scan with a fixed schema."""
    return spark.read.schema(AUCTION_SCHEMA).option("header", True).csv(paths)


# Year and round in the name of an auction file or of its folder.
AUCTION_NAME = r"(\d{2,4})_round_(\d+)"


def read_rounds(spark: SparkSession, paths, name: str = AUCTION_NAME) -> DataFrame:
    """Awards of any number of auction files in one scan, with the ``year`` and ``round`` that a file's path names.

    ``paths`` may hold glob patterns. Files whose path does not fit ``name`` keep their awards, with NULL in both.
    """
    rows = read_auctions(spark, paths)
    found = [F.regexp_extract(F.col("_metadata.file_path"), name, k) for k in (1, 2)]
    return rows.select(
        "*", *[F.when(text != "", text.cast("int")).alias(column) for text, column in zip(found, ("year", "round"))]
    )


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored under ``path``; an unreadable table raises when it is read."""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in NOT_THERE:
            raise
        return False
    return True


def read_window(spark: SparkSession, path: str, ts: str, start: date, end: date) -> DataFrame:
    """Half-open time slice of a table partitioned by year and month, partitions pruned."""
    return prune_to_window(spark.read.parquet(path), ts, start, end)


def _newest_folders(spark: SparkSession, path: str, partition_by: Sequence[str]) -> Iterator[str]:
    """Folders of a table's partitions, the newest first, found by listing one branch after the other."""
    if not partition_by:
        yield path
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [entry.getPath().getName() for entry in files.listStatus(folder)] if files.exists(folder) else []
    values = [int(n.partition("=")[2]) for n in names if re.fullmatch(rf"{re.escape(partition_by[0])}=\d+", n)]
    for value in sorted(values, reverse=True):
        yield from _newest_folders(spark, f"{path}/{partition_by[0]}={value}", partition_by[1:])


def stored_mark(spark: SparkSession, path: str, ts: str, partition_by: Sequence[str] = ("year", "month")) -> datetime | None:
    """The greatest stored time of a table that is partitioned by calendar parts of it; None if there is none.

    Partition values alone say where it is, so one partition is listed and read, however long the history;
    an older one only where the newest holds no time.
    """
    for folder in _newest_folders(spark, path.rstrip("/"), partition_by):
        newest = newest_in(spark, folder, ts).first()[0]
        if newest is not None:
            return newest
    return None


def newest_in(spark: SparkSession, folder: str, ts: str) -> DataFrame:
    """The greatest time in one folder, as a row."""
    return spark.read.schema(f"`{ts}` timestamp_ntz").parquet(folder).agg(F.max(ts).alias(ts))


def after_stored_mark(
    spark: SparkSession, incoming: DataFrame, path: str, ts: str, partition_by: Sequence[str] = ("year", "month")
) -> DataFrame:
    """Rows later than the newest of a stored table. The mark is a constant, so it reaches the scan of ``incoming``."""
    mark = stored_mark(spark, path, ts, partition_by)
    return incoming if mark is None else incoming.where(F.col(ts) > F.lit(mark.isoformat(sep=" ")).cast("timestamp_ntz"))


def after_high_water_mark(incoming: DataFrame, stored: DataFrame, ts: str) -> DataFrame:
    """Rows later than the newest stored one; all rows when nothing is stored."""
    newest = stored.agg(F.max(ts)).scalar()
    return incoming.where(newest.isNull() | (F.col(ts) > newest))
