"""Query registry: a Spark callable per key and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.session import apply_session_conf

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL counterpart."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(apply_session_conf(spark), sf_dir)

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column not in ``keep``; adding 0.0 turns -0.0 into 0.0."""
    columns = [
        (F.round(F.col(f"`{name}`"), digits) + F.lit(0.0)).alias(name)
        if kind == "double" and name not in keep
        else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ]
    return df.select(*columns)


def r(expression: str, digits: int = 6) -> str:
    """SQL text of the same rounding."""
    return f"(round({expression}, {digits}) + 0.0::DOUBLE)"


def bin_sql(x: str, low: str, high: str, bins: int) -> str:
    """SQL text of a histogram bin: equal widths, then the bin whose computed edges hold the value."""
    slot, width = f"least(floor(({x} - {low}) / ({high} - {low}) * {bins}), {bins - 1})", f"(({high} - {low}) / {bins})"
    return (
        f"({slot} - CASE WHEN {slot} > 0 AND {x} < {low} + {slot} * {width} THEN 1 ELSE 0 END"
        f" + CASE WHEN {slot} < {bins - 1} AND {x} >= {low} + ({slot} + 1) * {width} THEN 1 ELSE 0 END)::BIGINT"
    )
