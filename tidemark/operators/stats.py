"""Correlations and descriptive statistics, one reduced row per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.special import corr_two_sided


def not_nan(c: Column) -> Column:
    """NULL instead of NaN, so that NaN never leaves an operator."""
    return F.when(~F.isnan(c), c)


def corr(x: str, y: str, over: WindowSpec | None = None) -> Column:
    """Correlation of the complete pairs; NULL if either side does not vary.

    The built-in raises a division error for a constant side, which would stop a job
    over many keys because of one flat series.
    """
    parts = [
        F.covar_pop(x, y),
        F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))),
        F.stddev_pop(F.when(F.col(x).isNotNull(), F.col(y))),
    ]
    if over is not None:
        parts = [c.over(over) for c in parts]
    return F.try_divide(parts[0], parts[1] * parts[2])


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows where every listed column has a value (the common sample)."""
    return df.dropna(subset=list(cols))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str], with_p: bool = True) -> DataFrame:
    """r and n per group, with the two-sided p."""
    out = complete(df, [x, y]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), corr(x, y).alias("r")
    )
    return out.withColumn("p", corr_two_sided("r", "n")) if with_p else out


def average_rank(c: str, by: Sequence[str]) -> Column:
    """Rank with ties sharing their mean rank."""
    ordered = Window.partitionBy(*by).orderBy(c)
    ties = Window.partitionBy(*by, c)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0).cast("double")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str], with_p: bool = True) -> DataFrame:
    """Rank correlation. Groups are monthly samples, so each fits one task."""
    ranks = complete(df, [x, y]).select(
        *by, average_rank(x, by).alias("_rx"), average_rank(y, by).alias("_ry")
    )
    return pearson(ranks, "_rx", "_ry", by, with_p).withColumnRenamed("r", "rho")


def by_measure_and_period(
    df: DataFrame, y: str, measures: Mapping[str, str], periods: Sequence[tuple[str, str, str]], by: Sequence[str], month: str = "month", skip: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Long sample for split-sample figures: ``y`` beside each measure (as ``x``) in each named period.

    A month may belong to several periods. ``skip``: (measure, period) combinations that are left out, such as a period that begins before
    the measure does. One pass over ``df``: each row is expanded to the samples it belongs to.
    """
    spans = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.col(c).cast("double").alias("x"), F.lit(n).alias("period"), F.lit(a).cast("date").alias("a"), F.lit(z).cast("date").alias("z"))
            for m, c in measures.items()
            for n, a, z in periods
            if (m, n) not in set(skip)
        ]
    )
    mine = F.filter(spans, lambda p: F.col(month).between(p["a"], p["z"]) & p["x"].isNotNull())
    tagged = df.where(F.col(y).isNotNull()).select(*by, month, F.col(y).alias("y"), F.explode(mine).alias("_p"))
    return tagged.select(*by, "_p.measure", "_p.period", month, "y", "_p.x")


def by_version(df: DataFrame, versions: Mapping[str, tuple[str, str]], by: Sequence[str], order: str = "month") -> DataFrame:
    """Long sample of versions (name -> dependent and independent column) on the rows that all of them have."""
    whole = complete(df, sorted({c for pair in versions.values() for c in pair}))
    rows = F.array(*[F.struct(F.lit(n).alias("version"), F.col(a).alias("y"), F.col(b).alias("x")) for n, (a, b) in versions.items()])
    return whole.select(*by, order, F.inline(rows))


def lead_lag_corr(
    df: DataFrame, x: str, y: str, ks: Sequence[int], by: Sequence[str], order: str = "month"
) -> DataFrame:
    """Correlation of x with y shifted by k rows (k > 0: y leads), with its two-sided p."""
    w = Window.partitionBy(*by).orderBy(order)
    shifted = df.select(*by, x, *[F.lag(y, k).over(w).alias(f"_k{i}") for i, k in enumerate(ks)])
    aggs = []
    for i, _ in enumerate(ks):
        both = F.col(x).isNotNull() & F.col(f"_k{i}").isNotNull()
        aggs += [corr(x, f"_k{i}").alias(f"r{i}"), F.count(F.when(both, 1)).alias(f"n{i}")]
    wide = shifted.groupBy(*by).agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
            for i, k in enumerate(ks)
        ]
    )
    return wide.select(*by, F.explode(rows).alias("_e")).select(*by, "_e.k", "_e.r", "_e.n").withColumn("p", corr_two_sided("r", "n"))


def rebase(cols: Sequence[str], base_month: str, by: Sequence[str], month: str = "month") -> list[Column]:
    """Columns as an index: 100 in the base month."""
    w = Window.partitionBy(*by)
    at_base = F.col(month) == F.lit(base_month).cast("date")
    return [
        F.try_divide(F.col(c) * 100, F.max(F.when(at_base, F.col(c))).over(w)).alias(f"{c}_indexed") for c in cols
    ]


def window_change(
    df: DataFrame, cols: Sequence[str], starts: Mapping[str, str], by: Sequence[str], month: str = "month"
) -> DataFrame:
    """Percent change from each start month to the last month of the series."""
    aggs = []
    for i, start in enumerate(starts.values()):
        at = F.col(month) == F.lit(start).cast("date")
        for c in cols:
            first = F.max(F.when(at, F.col(c)))
            aggs.append(((F.try_divide(F.max_by(c, month), first) - 1) * 100).alias(f"_{i}_{c}"))
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("window"), *[F.col(f"_{i}_{c}").alias(f"{c}_change_pct") for c in cols])
            for i, n in enumerate(starts)
        ]
    )
    return wide.select(*by, F.explode(rows).alias("_e")).select(*by, "_e.*")


def variance_split(df: DataFrame, a: str, b: str, total: str, by: Sequence[str], month: str = "month") -> DataFrame:
    """Var(total) = Var(a) + Var(b) + 2 Cov(a, b) in long form, over one common sample."""
    wide = complete(df, [a, b, total]).groupBy(*by).agg(
        F.stddev_samp(a).alias("std_a"),
        F.stddev_samp(b).alias("std_b"),
        F.stddev_samp(total).alias("std_total"),
        F.var_samp(a).alias("var_a"),
        F.var_samp(b).alias("var_b"),
        (2 * F.covar_samp(a, b)).alias("cov2_ab"),
        F.var_samp(total).alias("var_total"),
        F.count(F.lit(1)).cast("double").alias("months"),
        F.date_format(F.min(month), "yyyyMM").cast("double").alias("first_yyyymm"),
        F.date_format(F.max(month), "yyyyMM").cast("double").alias("last_yyyymm"),
    )
    names = [c for c in wide.columns if c not in by]
    return wide.unpivot(list(by), names, "measure", "value")


def dispersion(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Sample standard deviations, variances and covariance."""
    return complete(df, [x, y]).groupBy(*by).agg(
        F.stddev_samp(x).alias("std_x"),
        F.stddev_samp(y).alias("std_y"),
        F.var_samp(x).alias("var_x"),
        F.var_samp(y).alias("var_y"),
        F.covar_samp(x, y).alias("cov_xy"),
    )


def sample_sizes(df: DataFrame, sets: Mapping[str, Sequence[str]], by: Sequence[str], month: str = "month") -> DataFrame:
    """Complete months, first and last month for each set of columns, in one pass."""
    aggs = []
    for i, cols in enumerate(sets.values()):
        ok = F.lit(True)
        for c in cols:
            ok = ok & F.col(c).isNotNull()
        aggs += [
            F.count(F.when(ok, 1)).alias(f"_n{i}"),
            F.min(F.when(ok, F.col(month))).alias(f"_a{i}"),
            F.max(F.when(ok, F.col(month))).alias(f"_z{i}"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("comparison"),
                F.col(f"_n{i}").alias("months"),
                F.col(f"_a{i}").alias("first_month"),
                F.col(f"_z{i}").alias("last_month"),
            )
            for i, name in enumerate(sets)
        ]
    )
    return df.groupBy(*by).agg(*aggs).select(*by, F.explode(rows).alias("_e")).select(*by, "_e.*")


def geo_mean_pct(c: Column) -> Column:
    """Geometric average change in percent of a log-change column (aggregate)."""
    return (F.exp(F.avg(c)) - 1) * 100


def direction_counts(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Opposite, same and unchanged months by strict signs; they add up to n."""
    sa, sb = F.signum(a), F.signum(b)
    out = complete(df, [a, b]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(sb > 0).alias("b_rose"),
        F.count_if((sb > 0) & (sa < 0)).alias("a_fell_when_b_rose"),
        F.count_if(sb < 0).alias("b_fell"),
        F.count_if((sb < 0) & (sa > 0)).alias("a_rose_when_b_fell"),
        F.count_if(((sa > 0) & (sb > 0)) | ((sa < 0) & (sb < 0))).alias("same"),
        F.count_if((sa == 0) | (sb == 0)).alias("unchanged"),
    )
    opposite = F.col("a_fell_when_b_rose") + F.col("a_rose_when_b_fell")
    return out.select(
        "*",
        opposite.alias("opposite"),
        F.try_divide(F.col("a_fell_when_b_rose") * 100.0, "b_rose").alias("a_fell_when_b_rose_pct"),
        F.try_divide(F.col("a_rose_when_b_fell") * 100.0, "b_fell").alias("a_rose_when_b_fell_pct"),
        F.try_divide(opposite * 100.0, "n").alias("opposite_pct"),
    )


def direction_class(a: str, b: str) -> Column:
    """opposite / same / unchanged from the two signs."""
    sa, sb = F.signum(a), F.signum(b)
    return F.when((sa == 0) | (sb == 0), "unchanged").when(sa != sb, "opposite").otherwise("same")


def level_gap(df: DataFrame, by: Sequence[str], refs: Mapping[str, tuple[str, object]], month: str = "month") -> DataFrame:
    """What either leg would have to do for the ratio to return to a median level.

    ``refs``: name -> ("since", date) or ("last", rows). Needs columns ratio and month.
    """
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(month)))
    ranked = df.withColumn("_back", back)
    aggs = [F.max_by("ratio", month).alias("today")]
    for i, (kind, arg) in enumerate(refs.values()):
        inside = F.col(month) >= F.lit(arg).cast("date") if kind == "since" else F.col("_back") <= arg
        aggs.append(F.percentile(F.when(inside, F.col("ratio")), F.lit(0.5).cast("double")).alias(f"_m{i}"))
    wide = ranked.groupBy(*by).agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("reference"), F.col(f"_m{i}").alias("reference_ratio"))
            for i, n in enumerate(refs)
        ]
    )
    return wide.select(*by, "today", F.explode(rows).alias("_e")).select(
        *by,
        "_e.reference",
        "_e.reference_ratio",
        F.col("today").alias("todays_ratio"),
        ((F.try_divide("_e.reference_ratio", "today") - 1) * 100).alias("num_change_needed_pct"),
        ((F.try_divide("today", "_e.reference_ratio") - 1) * 100).alias("den_change_needed_pct"),
    )


def wilson_ci(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval for k of n, in percent."""
    m = F.nullif(n, F.lit(0)).cast("double")
    share = k / m
    centre = (share + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(share * (1 - share) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return (centre - half) * 100, (centre + half) * 100
