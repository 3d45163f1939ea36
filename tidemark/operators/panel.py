"""Calendars, monthly panels, changes and ratios.

Size bound used throughout: after ``to_monthly`` a series has at most one row
per calendar month (about 12,000 rows for a thousand years), whatever the number
of raw rows behind it. Windows keyed by series therefore hold a bounded number
of rows even if one series owns a third of the raw data; the raw data itself is
only ever reduced by partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.stats import corr


def month_of(c: Column | str) -> Column:
    """First day of the month of a date or timestamp."""
    return F.trunc(F.col(c).cast("date") if isinstance(c, str) else c.cast("date"), "month")


def window_of(by: Sequence[str], order: str = "month") -> WindowSpec:
    """The one window a keyed series operator needs, so Spark sorts once."""
    return Window.partitionBy(*by).orderBy(order)


def to_monthly(
    daily: DataFrame, by: Sequence[str], date: str = "date", value: str = "value"
) -> DataFrame:
    """Mean, days with a value, last valued day and the value on that day, per month."""
    return (
        daily.where(F.col(value).isNotNull())
        .groupBy(*by, month_of(date).alias("month"))
        .agg(
            F.avg(value).alias("value"),
            F.count(F.lit(1)).alias("n_days"),
            F.max(date).alias("last_day"),
            F.max_by(value, date).alias("month_end"),
        )
    )


def drop_incomplete_last(monthly: DataFrame, by: Sequence[str], month: str = "month") -> DataFrame:
    """Leave out the last month of each series: its days may not be complete."""
    last = F.max(month).over(Window.partitionBy(*by)) if by else monthly.agg(F.max(month)).scalar()
    return monthly.withColumn("_last", last).where(F.col(month) < F.col("_last")).drop("_last")


def month_spine(
    df: DataFrame, by: Sequence[str], month: str = "month", start: str | None = None
) -> DataFrame:
    """Every calendar month from the first (or ``start``) to the last of each series."""
    first = F.lit(start).cast("date") if start else F.min(month)
    return (
        df.groupBy(*by)
        .agg(first.alias("_a"), F.max(month).alias("_z"))
        .select(*by, F.explode(F.expr("sequence(_a, _z, interval 1 month)")).alias("month"))
    )


def by_month(df: DataFrame) -> DataFrame:
    """Mark a keyless monthly table for broadcast.

    Only for tables with one row per month: their size is bounded by the calendar
    (12 rows a year), whatever the number of series joined to them.
    """
    return F.broadcast(df)


def join_on_spine(spine: DataFrame, *tables: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Left-join tables to the spine; what has no value stays NULL, nothing is filled.

    Tables joined on month alone are keyless calendars and go to every task; keyed
    tables are left to the planner.
    """
    out = spine
    for df, on in tables:
        out = out.join(by_month(df) if list(on) == ["month"] else df, list(on), "left")
    return out


def on_spine(df: DataFrame, by: Sequence[str], month: str = "month") -> DataFrame:
    """Put a gappy keyed series on its own calendar so that row lag = month lag.

    Same result as joining to ``month_spine`` but in one pass: every row is expanded
    up to the month before the next row, and the added months carry NULL values.
    The keyed series is read once and stays partitioned for the windows that follow.
    """
    following = F.lead(month).over(window_of(by, month))
    until = F.coalesce(F.add_months(following, -1), F.col(month))
    grid = df.withColumn("_z", until).withColumn(
        "_m", F.explode(F.sequence(F.col(month), F.col("_z"), F.expr("interval 1 month")))
    )
    real = F.col("_m") == F.col(month)
    values = [F.when(real, F.col(c)).alias(c) for c in df.columns if c not in (*by, month)]
    return grid.select(*by, F.col("_m").alias(month), *values)


def pivot_series(
    df: DataFrame, on: Sequence[str], name: str, value: str, names: Sequence[str | tuple[str, str]]
) -> DataFrame:
    """Long to wide: one column per named series, the largest value of each."""
    pairs = [(n, n) if isinstance(n, str) else n for n in names]
    return (
        df.where(F.col(name).isin([n for n, _ in pairs]))
        .groupBy(*on)
        .agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(a) for n, a in pairs])
    )


def cross_rate(price: Column, rate: Column) -> Column:
    """Price in the other currency; NULL where the rate is zero or missing."""
    return F.try_divide(price, rate)


def log_change(now: Column, before: Column) -> Column:
    """ln(now / before); NULL if either is missing or the ratio is not positive."""
    return F.ln(F.try_divide(now, before))


def pct_change(now: Column, before: Column) -> Column:
    return (F.try_divide(now, before) - 1) * 100


def monthly_changes(
    panel: DataFrame,
    prices: Sequence[str],
    by: Sequence[str],
    rates: Sequence[str] = (),
    deflator: str | None = None,
    order: str = "month",
    k: int = 1,
) -> DataFrame:
    """Log return and percent change of prices, point change of rates.

    With a deflator each price also gets its real log return (price minus
    deflator). The panel must have no missing months (see ``on_spine``).
    """
    w = window_of(by, order)

    def lag(c: str) -> Column:
        return F.lag(c, k).over(w)

    out = []
    for c in prices:
        out += [
            log_change(F.col(c), lag(c)).alias(f"{c}_logret_m"),
            pct_change(F.col(c), lag(c)).alias(f"{c}_pct_m"),
        ]
        if deflator:
            real = log_change(F.col(c), lag(c)) - log_change(F.col(deflator), lag(deflator))
            out.append(real.alias(f"{c}_real_logret_m"))
    out += [(F.col(c) - lag(c)).alias(f"{c}_chg_pp_m") for c in rates]
    return panel.select(*by, order, *out)


def forward_changes(
    df: DataFrame, cols: Sequence[str], horizons: Sequence[int], by: Sequence[str], order: str = "month"
) -> DataFrame:
    """Log and percent change over the next h rows; NULL for the last h rows."""
    w = window_of(by, order)
    out = []
    for h in horizons:
        for c in cols:
            ahead = F.lead(c, h).over(w)
            out += [
                log_change(ahead, F.col(c)).alias(f"{c}_fwd_{h}m_logchg"),
                pct_change(ahead, F.col(c)).alias(f"{c}_fwd_{h}m_pct"),
            ]
    return df.select("*", *out)


def shift_join(df: DataFrame, by: Sequence[str], value: str, months: int, alias: str, keep: Sequence[str] = ()) -> DataFrame:
    """Value ``months`` calendar months later beside each row.

    Same as a self join on the shifted month, but the series is read once: each row is
    sent to its own month and to the month that looks ahead to it. (by, month) is unique.
    """
    cols = [value, *keep]
    here = F.struct(F.col("month"), *cols, F.lit(None).cast("double").alias("_ahead"), F.lit(1).alias("_own"))
    ahead = F.struct(
        F.add_months("month", -months).alias("month"),
        *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols],
        F.col(value).cast("double").alias("_ahead"), F.lit(0).alias("_own"),
    )
    return (
        df.select(*by, F.inline(F.array(here, ahead)))
        .groupBy(*by, "month")
        .agg(*[F.max(c).alias(c) for c in cols], F.max("_ahead").alias(alias), F.max("_own").alias("_own"))
        .where(F.col("_own") == 1)
        .drop("_own")
    )


def deflate(
    df: DataFrame, deflator: DataFrame, value: str = "value", month: str = "month", alias: str = "real"
) -> DataFrame:
    """value * D_last / D_t, in money of the last deflator month; NULL where D is missing.

    The deflator is a keyless calendar, so its last value is found in a window over it.
    """
    whole = Window.partitionBy(F.lit(1))
    base = F.max_by("value", month).over(whole)
    d = deflator.select(F.col(month), F.try_divide(base, F.col("value")).alias("_f"))
    return df.join(by_month(d), month, "left").withColumn(alias, F.col(value) * F.col("_f")).drop("_f")


def pair_ratio(df: DataFrame, pairs: DataFrame, month: str = "month", value: str = "value") -> DataFrame:
    """Ratio of two series per pair, only months where both legs have a value.

    ``pairs`` has pair_id, num, den. Each series row goes to the pairs it is a leg
    of, and the two legs meet in one aggregation: the series are read once.
    """
    legs = pairs.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.col("num").alias("series_id"), F.lit(1).alias("is_num")),
                F.struct(F.col("den").alias("series_id"), F.lit(0).alias("is_num")),
            )
        ).alias("_l"),
    ).select("pair_id", "_l.series_id", "_l.is_num")
    v = df.where(F.col(value).isNotNull()).select("series_id", month, value)
    return (
        v.join(legs, "series_id")
        .groupBy("pair_id", month)
        .agg(
            F.max(F.when(F.col("is_num") == 1, F.col(value))).alias("num_value"),
            F.max(F.when(F.col("is_num") == 0, F.col(value))).alias("den_value"),
        )
        .where(F.col("num_value").isNotNull() & F.col("den_value").isNotNull())
        .withColumn("ratio", F.try_divide("num_value", "den_value"))
    )


def rolling_mean(c: str, n: int, by: Sequence[str], order: str = "month") -> Column:
    """Mean of the last n rows, NULL until all n have a value."""
    w = window_of(by, order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))


def rolling_corr(x: str, y: str, n: int, by: Sequence[str], order: str = "month") -> Column:
    """Correlation over the last n rows, NULL unless all n pairs are complete."""
    w = window_of(by, order).rowsBetween(-(n - 1), 0)
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    return F.when(F.count(both).over(w) == n, corr(x, y, w))


def pct_of_max(c: str, by: Sequence[str]) -> Column:
    """Share of the largest value of the series, in percent."""
    return F.try_divide(100 * F.col(c), F.max(c).over(Window.partitionBy(*by)))


def is_record(c: str, by: Sequence[str], order: str = "month") -> Column:
    """1 if the value is at or above everything before it in the series."""
    before = F.max(c).over(window_of(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return F.when(F.col(c).isNotNull(), (before.isNull() | (F.col(c) >= before)).cast("int"))


def date_gaps(df: DataFrame, by: Sequence[str], date: str = "date") -> DataFrame:
    """Days since the previous distinct date of the series (one row per date)."""
    days = df.select(*by, date).distinct()
    return days.withColumn("gap_days", F.datediff(date, F.lag(date).over(window_of(by, date))))


def gap_rows(df: DataFrame, by: Sequence[str], max_days: int, date: str = "date") -> DataFrame:
    """One row for each gap above ``max_days`` between consecutive dates of a series: the dates on both sides and the days between."""
    gaps = date_gaps(df, by, date).where(F.col("gap_days") > max_days)
    return gaps.select(*by, F.date_sub(date, F.col("gap_days")).alias("gap_from"), F.col(date).alias("gap_to"), "gap_days")
