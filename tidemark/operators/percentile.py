"""Past-only percentiles: how a value compares with what came before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import window_of
from tidemark.operators.scan import BLOCK_ROWS, running_sum
from tidemark.session import cut_lineage


def _count_at_or_below(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda v: v <= x))


def past_percentile(value: str, by: Sequence[str], warmup: int, order: str = "month") -> Column:
    """Share (0-100) of strictly earlier rows at or below this value; ties count.

    NULL for the first ``warmup`` rows. For monthly series, where the history of a
    row is bounded by the calendar; see ``past_percentile_long`` for long series.
    """
    w = window_of(by, order)
    past = F.collect_list(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    n = F.row_number().over(w)
    share = F.try_divide(_count_at_or_below(past, F.col(value)) * 100.0, n - 1)
    return F.when(n > warmup, share)


def trailing_percentile(value: str, by: Sequence[str], lookback: int, warmup: int, order: str = "month") -> Column:
    """Same against the previous ``lookback`` rows only; the denominator is ``lookback``."""
    w = window_of(by, order)
    past = F.collect_list(value).over(w.rowsBetween(-lookback, -1))
    share = _count_at_or_below(past, F.col(value)) * 100.0 / lookback
    return F.when(F.row_number().over(w) > warmup, share)


def past_percentile_long(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    pos: str,
    max_log2: int | None,
    warmup: int,
    alias: str,
    base_log2: int = 8,
    plain_levels: int = 16,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact past percentile for long series, without comparing all pairs of rows.

    ``pos`` is a unique integer order, gaps and negative numbers allowed; rows without one
    raise. The tree spans all positions of the data: its height comes from the smallest and the
    largest, and ``max_log2`` can only make it taller.
    Inside blocks
    of 2**base_log2 positions earlier rows are counted directly. Beyond that, row j comes
    before row i exactly once in the binary tree of positions: at the level where j lies in
    the left half and i in the right half of the same node. So each row goes to one node
    per level, and the running number of left-half rows in value order is what each
    right-half row needs. Nodes below ``plain_levels`` hold at most 2**plain_levels rows;
    larger nodes run block by block. Work is n log n rows. The input is used three times,
    so it is written out once first.
    """
    df = cut_lineage(df)
    low, high, rows, missing = df.agg(F.min(pos), F.max(pos), F.count(pos), F.count_if(F.col(pos).isNull())).first()
    if missing:
        raise ValueError(f"{missing} rows have no {pos}")
    max_log2 = max(max_log2 or 0, (int(high - low) if rows else 0).bit_length())
    given, pos = pos, "_pos"
    df = df.withColumn(pos, F.col(given).cast("long") - F.lit(int(low or 0)))
    block = Window.partitionBy(*by, F.expr(f"shiftright({pos}, {base_log2})")).orderBy(pos)
    before = block.rowsBetween(Window.unboundedPreceding, -1)
    near = _count_at_or_below(F.collect_list(value).over(before), F.col(value))
    out = df.select("*", near.alias("_near_hits"), F.count(value).over(before).alias("_near_past"))
    if max_log2 > base_log2:
        out = out.join(_far_counts(df, value, by, pos, base_log2, max_log2, plain_levels, block_rows), [*by, pos], "left")
    else:
        out = out.select("*", F.lit(0).alias("_far_hits"), F.lit(0).alias("_far_past"))
    past = F.col("_near_past") + F.coalesce("_far_past", F.lit(0))
    found = F.col("_near_hits") + F.coalesce("_far_hits", F.lit(0))
    share = F.when(past >= max(warmup, 1), F.try_divide(found * 100.0, past))
    return out.withColumn(alias, share).drop("_near_hits", "_near_past", "_far_hits", "_far_past", pos)


def _far_counts(
    df: DataFrame, value: str, by: Sequence[str], pos: str, base_log2: int, max_log2: int, plain_levels: int, block_rows: int
) -> DataFrame:
    """Earlier rows in other blocks: how many, and how many at or below the value."""
    levels = F.explode(F.sequence(F.lit(base_log2), F.lit(max_log2 - 1)))
    tree = df.select(*by, pos, F.col(value).alias("_x"), levels.alias("_level")).select(
        *by, pos, "_x", "_level",
        F.expr(f"shiftright({pos}, _level + 1)").alias("_node"),
        (F.expr(f"shiftright({pos}, _level)") % 2).alias("_right"),
    )
    node = [*by, "_level", "_node"]
    # One row per node and distinct value, so ties count for every right-half row.
    per_value = tree.groupBy(*node, "_x").agg(F.sum(1 - F.col("_right")).alias("_left"))
    out_cols = [*node, "_x", "_at_or_below", "_earlier"]
    ordered = Window.partitionBy(*node).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        per_value.where(F.col("_level") < plain_levels)
        .withColumn("_at_or_below", F.sum("_left").over(ordered))
        .withColumn("_earlier", F.sum("_left").over(Window.partitionBy(*node)))
        .select(*out_cols)
    )
    if max_log2 > plain_levels:
        big = per_value.where(F.col("_level") >= plain_levels)
        totals = big.groupBy(*node).agg(F.sum("_left").alias("_earlier"))
        run = running_sum(big, node, "_x", "_left", "_at_or_below", block_rows).join(totals, node)
        counted = counted.unionByName(run.select(*out_cols))
    return (
        tree.where(F.col("_right") == 1)
        .join(counted, [*node, "_x"])
        .groupBy(*by, pos)
        .agg(F.sum("_at_or_below").alias("_far_hits"), F.sum("_earlier").alias("_far_past"))
    )
