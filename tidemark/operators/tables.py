"""Joins, aggregates, top-k and set operations in keyed form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import rank_rows


def inline_rows(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small literal table (rules, limits, periods)."""
    return spark.createDataFrame(list(rows), schema)


def expand(df: DataFrame, *dims: tuple[str, Sequence]) -> DataFrame:
    """Every combination of each row with literal values: (column, values) per dimension.

    The values are literals in the plan, so a grid is a row expansion: no join, no shuffle.
    """
    for name, values in dims:
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def expand_structs(df: DataFrame, *dims: Sequence[Column]) -> DataFrame:
    """Like ``expand`` for dimensions whose cases carry values of the row (structs)."""
    for i, cases in enumerate(dims):
        df = df.withColumn(f"_d{i}", F.explode(F.array(*cases)))
        df = df.select(*[c for c in df.columns if c != f"_d{i}"], f"_d{i}.*")
    return df


def outer_merge(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of both sides, keys coalesced."""
    return a.join(b, list(on), "full_outer")


def align(a: DataFrame, b: DataFrame, on: Sequence[str], x: str, y: str) -> DataFrame:
    """Keys where both sides have a value."""
    both = a.select(*on, F.col(x).alias("x")).join(b.select(*on, F.col(y).alias("y")), list(on))
    return both.dropna(subset=["x", "y"])


def enrich(df: DataFrame, register: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add the register's columns; rows without an entry stay."""
    return df.join(register, list(on), "left")


def with_total(df: DataFrame, value: str, by: Sequence[str], alias: str = "total") -> DataFrame:
    """The group's total beside each row: aggregate first, then join the small result."""
    if not by:
        return df.withColumn(alias, df.agg(F.sum(value)).scalar())
    return df.join(df.groupBy(*by).agg(F.sum(value).alias(alias)), list(by))


def pick_cells(grid: DataFrame, by: Sequence[str], rules: Mapping[str, tuple[str, Column, str]]) -> DataFrame:
    """Named cells of a case grid: alias -> (min or max, condition, column)."""
    fns = {"min": F.min, "max": F.max}
    return grid.groupBy(*by).agg(
        *[fns[fn](F.when(cond, F.col(c))).alias(a) for a, (fn, cond, c) in rules.items()]
    )


def list_values(df: DataFrame, by: Sequence[str], col: str, alias: str, sep: str = ", ", most: int = 10_000) -> DataFrame:
    """Distinct values in order as one text per group, for reports over short lists.

    A group of more than ``most`` values stops the job before any list is made; ``distinct_rows`` gives such values as rows.
    """
    distinct = distinct_rows(df, by, [col])
    long = distinct.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).limit(1).collect()
    if long:
        raise ValueError(f"more than {most} values of {col}: {long[0].asDict()}")
    return distinct.groupBy(*by).agg(F.expr(f"listagg({col}, '{sep}') within group (order by {col})").alias(alias))


def distinct_rows(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Distinct values of each group, a row each."""
    return df.select(*by, *cols).distinct()


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def bucket_stats(df: DataFrame, by: Sequence[str], month: str, value: str, width: int) -> DataFrame:
    """Lowest, median and highest value per bucket of ``width`` years."""
    bucket = (F.floor(F.year(month) / width) * width).cast("int")
    return df.groupBy(*by, bucket.alias("bucket")).agg(
        F.min(value).alias("lowest"),
        F.percentile(value, F.lit(0.5).cast("double")).alias("median"),
        F.max(value).alias("highest"),
    )


def peak(df: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """Largest and smallest value with the key where they occur (earliest key on ties)."""
    # Order by value, then by the key backwards, so a tie gives the first month as idxmax does.
    early = -F.unix_date(key)
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.max(value).alias("peak"),
        F.max_by(key, F.struct(F.col(value), early)).alias("peak_at"),
        F.min(value).alias("low"),
        F.min_by(key, F.struct(F.col(value), F.unix_date(key))).alias("low_at"),
    )


def census(df: DataFrame, by: Sequence[str], distinct: str, value: str) -> DataFrame:
    """Rows, distinct entities and mean value per group."""
    # Two steps instead of count(distinct): both shuffles carry partial sums only.
    return (
        df.groupBy(*by, distinct)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"), F.count(value).alias("_c"))
        .groupBy(*by)
        .agg(
            F.sum("_n").alias("rows"),
            F.count(distinct).alias("entities"),
            F.try_divide(F.sum("_s"), F.sum("_c")).alias("mean_value"),
        )
    )


def latest(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """Values in the row with the largest ``order``; an aggregate, never a global sort."""
    return df.groupBy(*by).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in cols])


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group. Spark keeps k rows per group and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def stack(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def append_total(df: DataFrame, label_col: str, label: str, sums: Sequence[str]) -> DataFrame:
    """Add one row with the sums; other columns are NULL."""
    total = df.agg(*[F.sum(c).alias(c) for c in sums]).withColumn(label_col, F.lit(label))
    return df.unionByName(total, allowMissingColumns=True)


def ordered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fixed row order for a sink; never inside a chain of operators."""
    return df.orderBy(*keys)


def rank_placeable(df: DataFrame, flag: str, value: str, ties: Sequence[str] = (), alias: str = "rank") -> DataFrame:
    """Rank by value among rows with flag = 1; NULL for the others, which are not ranked at all.

    Ranks are found block by block (see ``scan.rank_rows``), so no task holds all entities.
    """
    ranked = rank_rows(df.where(F.col(flag) == 1), [], -F.col(value), list(ties), alias)
    rest = df.where(F.coalesce(F.col(flag) != 1, F.lit(True))).withColumn(alias, F.lit(None).cast("int"))
    return ranked.unionByName(rest.select(ranked.columns))
