"""Ordered operators over (entity, time) series that never sort a whole entity in one task.

A plain window over an entity puts all its rows into one task. The operators here cut every
series into calendar chunks, work inside the chunks, and carry a one-row summary per chunk
forward. Only the summaries are ordered per entity, so an entity that holds a third of all
rows is spread over as many tasks as it has chunks. Results equal those of the plain window.

``order`` must be unique inside an entity; ``chunk`` is a ``date_trunc`` unit. Rows with a NULL key form an
entity of their own and rows with a NULL time come first, as in a plain window; chunks are joined on
structs, in which NULL equals NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = "month"
BLOCK_ROWS = 8192


PLACE = ["_entity", "_chunk"]


def _chunked(df: DataFrame, keys: Sequence[str], order: str, chunk: str) -> DataFrame:
    return df.withColumns(
        {
            "_entity": F.struct(F.lit(0), *keys),
            "_chunk": F.struct(F.date_trunc(chunk, F.col(order))),
        }
    )


def _local(order: str):
    return Window.partitionBy(*PLACE).orderBy(order)


def _before():
    """All earlier chunks of the entity."""
    return Window.partitionBy("_entity").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def with_position(
    df: DataFrame, keys: Sequence[str], order: str, out: str = "position", chunk: str = DEFAULT_CHUNK
) -> DataFrame:
    """1-based row number of each row inside its entity."""
    rows = _chunked(df, keys, order, chunk)
    sizes = rows.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *PLACE, F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_offset")
    )
    numbered = rows.withColumn("_row", F.row_number().over(_local(order)))
    return (
        numbered.join(offsets, PLACE)
        .withColumn(out, F.col("_offset") + F.col("_row"))
        .drop(*PLACE, "_offset", "_row")
    )


def with_bounded_frame(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    reach: int,
    columns,
    block_rows: int = BLOCK_ROWS,
    chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Add window columns that look at most ``reach`` rows back.

    ``columns(window)`` returns ``{name: Column}`` for a partitioned, ordered window without
    a frame. Series are cut into blocks of ``block_rows`` rows; the last ``reach`` rows of a
    block are copied in front of the next one and dropped again afterwards.
    """
    if reach >= block_rows:
        raise ValueError("reach must be smaller than block_rows")
    placed = with_position(df, keys, order, "_position", chunk)
    block = F.floor((F.col("_position") - 1) / block_rows)
    near_end = (F.col("_position") - 1) % block_rows >= block_rows - reach
    own = F.struct(block.alias("_block"), F.lit(False).alias("_copy"))
    ahead = F.struct((block + 1).alias("_block"), F.lit(True).alias("_copy"))
    spread = placed.select(
        "*", F.inline(F.when(near_end, F.array(own, ahead)).otherwise(F.array(own)))
    )
    window = Window.partitionBy(*keys, "_block").orderBy("_position")
    return (
        spread.withColumns(columns(window))
        .where(~F.col("_copy"))
        .drop("_position", "_block", "_copy")
    )


def rolling_std(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, rows: int = 6, **kw
) -> DataFrame:
    """Sample standard deviation of the last ``rows`` rows; NULL for a single value."""
    return with_bounded_frame(
        df, keys, order, rows - 1,
        lambda w: {out: F.stddev_samp(value).over(w.rowsBetween(-(rows - 1), 0))}, **kw,
    )


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], limit: int = 6, **kw
) -> DataFrame:
    """Fill NULLs with the last value of at most ``limit`` rows back."""
    return with_bounded_frame(
        df, keys, order, limit,
        lambda w: {v: F.last(v, ignorenulls=True).over(w.rowsBetween(-limit, 0)) for v in values}, **kw,
    )


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    limit: int = 6,
    mean_rows: int = 24,
    min_periods: int | None = None,
    **kw,
) -> DataFrame:
    """Forward fill, then the rolling mean of the unfilled column for what is still NULL.

    The mean counts the current row, so with the default ``min_periods`` (all of
    ``mean_rows``) it never applies to a NULL row; a smaller value makes it effective.
    """
    needed = mean_rows if min_periods is None else min_periods

    def columns(w):
        out = {}
        for v in values:
            frame = w.rowsBetween(-(mean_rows - 1), 0)
            mean = F.when(F.count(v).over(frame) >= needed, F.avg(v).over(frame))
            out[v] = F.coalesce(F.last(v, ignorenulls=True).over(w.rowsBetween(-limit, 0)), mean)
        return out

    return with_bounded_frame(df, keys, order, max(limit, mean_rows - 1), columns, **kw)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, chunk: str = DEFAULT_CHUNK
) -> DataFrame:
    """Running total of ``value`` in time order; NULL values add nothing."""
    rows = _chunked(df, keys, order, chunk)
    amount = F.coalesce(F.col(value), F.lit(0))
    totals = rows.groupBy(*PLACE).agg(F.sum(amount).alias("_total"))
    carried = totals.select(
        *PLACE, F.coalesce(F.sum("_total").over(_before()), F.lit(0)).alias("_carry")
    )
    inside = _local(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_inside", F.sum(amount).over(inside))
        .join(carried, PLACE)
        .withColumn(out, F.col("_carry") + F.col("_inside"))
        .drop(*PLACE, "_inside", "_carry")
    )


def run_counters(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    label: Column,
    run: str,
    since: Mapping[str, Column] | None = None,
    run_start: str | None = None,
    chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Position inside runs of equal labels, and rows since the last marked row.

    ``run`` counts 1, 2, ... and restarts at every label change. Each ``since`` column is 0
    on a marked row and counts rows from there; before the first mark it counts from the
    start of the series. ``run_start`` names an optional column with the position of the
    run's first row, which identifies the run.
    """
    since = dict(since or {})
    marks = {f"_mark_{i}": flag for i, flag in enumerate(since.values())}
    local = _local(order)
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    row = F.row_number().over(local)
    changed = (row > 1) & ~F.lag("_label").over(local).eqNullSafe(F.col("_label"))

    labelled = _chunked(df, keys, order, chunk).withColumns({"_label": label, **marks})
    numbered = labelled.withColumns({"_row": row, "_changed": changed})
    last_rows = {"_change_row": F.max(F.when(F.col("_changed"), F.col("_row"))).over(so_far)}
    for mark in marks:
        last_rows[f"{mark}_row"] = F.max(F.when(F.col(mark), F.col("_row"))).over(so_far)
    inside = numbered.withColumns(last_rows)

    summary = numbered.groupBy(*PLACE).agg(
        F.max("_row").alias("_n"),
        F.min_by("_label", "_row").alias("_first"),
        F.max_by("_label", "_row").alias("_last"),
        F.max(F.when(F.col("_changed"), F.col("_row"))).alias("_change_end"),
        *[F.max(F.when(F.col(m), F.col("_row"))).alias(f"{m}_end") for m in marks],
    )
    before = _before()
    chunk_order = Window.partitionBy("_entity").orderBy("_chunk")
    placed = summary.withColumns(
        {
            "_offset": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_fresh": F.lag("_n").over(chunk_order).isNull()
            | ~F.lag("_last").over(chunk_order).eqNullSafe(F.col("_first")),
        }
    )
    first_row = F.when(F.col("_fresh"), F.lit(1))
    ends = {"_change_end": F.col("_offset") + F.coalesce(F.col("_change_end"), first_row)}
    ends.update({f"{m}_end": F.col("_offset") + F.col(f"{m}_end") for m in marks})
    ended = placed.withColumns(ends)
    carried = ended.select(
        *PLACE,
        "_offset",
        F.when(F.col("_fresh"), F.col("_offset") + 1)
        .otherwise(F.max("_change_end").over(before))
        .alias("_change_carry"),
        *[F.max(f"{m}_end").over(before).alias(f"{m}_carry") for m in marks],
    )

    position = F.col("_offset") + F.col("_row")
    start = F.coalesce(F.col("_offset") + F.col("_change_row"), F.col("_change_carry"))
    result = {run: position - start + 1}
    if run_start:
        result[run_start] = start
    for name, mark in zip(since, marks):
        last = F.coalesce(F.col("_offset") + F.col(f"{mark}_row"), F.col(f"{mark}_carry"), F.lit(1))
        result[name] = position - last
    return inside.join(carried, PLACE).select(
        *df.columns, *[column.alias(name) for name, column in result.items()]
    )


def elapsed_since(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    since: Mapping[str, Column],
    unit: str = "HOUR",
    chunk: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Time since the last marked row, in whole units; before the first mark, since the first row.

    Differs from counting rows where hours are missing from the series.
    """
    marks = {f"_mark_{i}": flag for i, flag in enumerate(since.values())}
    rows = _chunked(df, keys, order, chunk).withColumns(marks)
    marked = {m: F.max(F.when(F.col(m), F.col(order))) for m in marks}
    summary = rows.groupBy(*PLACE).agg(
        F.min(order).alias("_first"), *[last.alias(f"{m}_last") for m, last in marked.items()]
    )
    before = _before()
    whole = Window.partitionBy("_entity")
    carried = summary.select(
        *PLACE,
        F.min("_first").over(whole).alias("_begin"),
        *[F.max(f"{m}_last").over(before).alias(f"{m}_carry") for m in marks],
    )
    so_far = _local(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({f"{m}_here": last.over(so_far) for m, last in marked.items()})
    elapsed = [
        F.timestamp_diff(
            unit, F.coalesce(F.col(f"{m}_here"), F.col(f"{m}_carry"), F.col("_begin")), F.col(order)
        ).alias(name)
        for name, m in zip(since, marks)
    ]
    return inside.join(carried, PLACE).select(*df.columns, *elapsed)


def spells(
    df: DataFrame, keys: Sequence[str], order: str, inside: Column, chunk: str = DEFAULT_CHUNK
) -> DataFrame:
    """First time, last time and length of every unbroken stretch of rows where ``inside`` holds."""
    flagged = df.select(*keys, order, F.coalesce(inside, F.lit(False)).alias("_inside"))
    runs = run_counters(
        flagged, keys, order, F.col("_inside"), run="_run", run_start="_start", chunk=chunk
    )
    return (
        runs.where("_inside")
        .groupBy(*keys, "_start")
        .agg(
            F.min(order).alias("spell_start"),
            F.max(order).alias("spell_end"),
            F.count(F.lit(1)).alias("spell_rows"),
        )
        .drop("_start")
    )
