"""Ordered scans that stay even when one key owns most of the rows.

A plain keyed window puts all rows of a key in one task. These helpers cut a key
into blocks of consecutive positions, scan inside the blocks in parallel, and
carry one small summary row per block from block to block.

The input is used in two steps, so it must come out the same each time: stored data, or
values that do not depend on the order of floating-point sums. ``rank_rows``, which ranks
such sums, stores its input itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

BLOCK_ROWS = 65_536


def carry_forward(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    value: Column,
    alias: str,
    include_current: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Latest non-NULL ``value`` at an earlier (or the same) integer ``order``."""
    d = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / block_rows))
    frame_end = 0 if include_current else -1
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, frame_end)
    blocks = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    present = F.when(F.col("_v").isNotNull(), F.col(order))
    summary = (
        d.groupBy(*by, "_b")
        .agg(F.max_by("_v", present).alias("_last"))
        .select(*by, "_b", F.last("_last", ignorenulls=True).over(blocks).alias("_carry"))
    )
    local = d.withColumn("_local", F.last("_v", ignorenulls=True).over(inside))
    return (
        local.join(summary, [*by, "_b"], "left")
        .withColumn(alias, F.coalesce("_local", "_carry"))
        .drop("_v", "_b", "_local", "_carry")
    )


TIE_BYTES, TIE_CHUNKS = 6, 8  # of a text tie-breaker: bytes to one number, and how many numbers


def _numbers(df: DataFrame, name: str) -> list[Column]:
    """A column as numbers in its own order, each to split what equals in those before it; missing values first."""
    kind, c = df.schema[name].dataType.typeName(), F.col(name)
    if kind in ("string", "varchar", "char"):
        chunk = lambda i: F.hex(F.substring(F.encode(c, "UTF-8"), TIE_BYTES * i + 1, TIE_BYTES))
        parts = [F.conv(F.rpad(chunk(i), 2 * TIE_BYTES, "0"), 16, 10).cast("double") for i in range(TIE_CHUNKS)]
    elif kind == "date":
        parts = [F.unix_date(c).cast("double")]
    elif kind.startswith("timestamp"):
        parts = [F.unix_micros(c.cast("timestamp")).cast("double")]
    elif kind in ("byte", "short", "integer", "long", "float", "double", "boolean") or kind.startswith("decimal"):
        parts = [c.cast("double")]
    else:
        parts = []
    return [F.coalesce(x, F.lit(float("-inf"))) for x in parts]


def block_ids(df: DataFrame, by: Sequence[str], order: str, block_rows: int = BLOCK_ROWS, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``_b``: blocks of each key that ascend with a numeric ``order``, then with ``ties``.

    A key of up to twice ``block_rows`` rows is one block. A larger one is cut into as many as its rows ask for, at
    approximate percentiles of the order (a mergeable sketch). Equal values share a block; one that is still too large is cut
    again by the first of ``ties``, and so on, so rows of one value, or without any, spread as well (rows that equal in
    all of them, or in the first bytes of a text, stay together). A sketch can differ between two runs of one task, so the
    cut points (a row for each large block) are written out: every step and every retry uses the same blocks.
    """
    d = df.withColumn("_b", F.array().cast("array<int>"))
    for level in [F.col(order).cast("double"), *(x for t in ties for x in _numbers(df, t))]:
        large = cut_lineage(d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 2 * block_rows))
        most = large.agg(F.max("_rows")).first()[0]
        if not most:
            break
        n = -(-most // block_rows)
        cuts = d.join(large.drop("_rows"), [*by, "_b"], "left_semi").groupBy(*by, "_b")
        cuts = cut_lineage(cuts.agg(F.percentile_approx(level, [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("_cuts")))
        below = F.coalesce(F.size(F.filter("_cuts", lambda c: c < level)), F.lit(0))  # noqa: B023  used within this turn
        d = d.join(cuts, [*by, "_b"], "left").withColumn("_b", F.concat("_b", F.array(below))).drop("_cuts")
    return d


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    value: str,
    alias: str,
    block_rows: int = BLOCK_ROWS,
    include_current: bool = True,
) -> DataFrame:
    """Running sum over a numeric order that is unique inside each key, block by block."""
    d = block_ids(df, by, order, block_rows)
    inside = Window.partitionBy(*by, "_b").orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    blocks = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        d.groupBy(*by, "_b")
        .agg(F.sum(value).alias("_s"))
        .select(*by, "_b", F.sum("_s").over(blocks).alias("_carry"))
    )
    local = d.withColumn("_local", F.sum(value).over(inside))
    return (
        local.join(summary, [*by, "_b"], "left")
        .withColumn(alias, F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0)))
        .drop("_b", "_local", "_carry")
    )


def running_max(df: DataFrame, by: Sequence[str], order: str, value: str, alias: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running maximum (current row included), block by block."""
    d = block_ids(df, by, order, block_rows)
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        d.groupBy(*by, "_b")
        .agg(F.max(value).alias("_s"))
        .select(*by, "_b", F.max("_s").over(blocks).alias("_carry"))
    )
    local = d.withColumn("_local", F.max(value).over(inside))
    return (
        local.join(summary, [*by, "_b"], "left")
        .withColumn(alias, F.greatest("_local", "_carry"))
        .drop("_b", "_local", "_carry")
    )


def rank_rows(
    df: DataFrame, by: Sequence[str], order: Column, ties: Sequence[str], alias: str, block_rows: int = BLOCK_ROWS, also_sum: str | None = None
) -> DataFrame:
    """Row number by a numeric order, then by ``ties``; block by block, so any group size works, also if all values tie.

    With ``also_sum`` the running sum of that column in rank order is added as
    ``running_<column>``. Rows without an order value come last.
    """
    # Rows without an order value stand in the last blocks.
    d = cut_lineage(df.withColumn("_o", F.coalesce(order.cast("double"), F.lit(float("inf")))))
    d = block_ids(d, by, "_o", block_rows, ties)
    inside = Window.partitionBy(*by, "_b").orderBy("_o", *ties).rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(also_sum).alias("_s")] if also_sum else [])
    carried = [F.coalesce(F.sum("_n").over(blocks), F.lit(0)).alias("_before")]
    if also_sum:
        carried.append(F.coalesce(F.sum("_s").over(blocks), F.lit(0.0)).alias("_so_far"))
    summary = d.groupBy(*by, "_b").agg(*sums).select(*by, "_b", *carried)
    out = d.withColumn("_rn", F.count(F.lit(1)).over(inside))
    if also_sum:
        out = out.withColumn("_rs", F.sum(also_sum).over(inside))
    out = out.join(summary, [*by, "_b"]).withColumn(alias, (F.col("_rn") + F.col("_before")).cast("int"))
    if also_sum:
        out = out.withColumn(f"running_{also_sum}", F.col("_rs") + F.col("_so_far"))
    return out.drop("_o", "_b", "_rn", "_before", "_rs", "_so_far")
