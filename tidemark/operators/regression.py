"""Ordinary least squares with autocorrelation-robust (HAC) errors per group.

Groups are monthly samples (bounded by the calendar, see ``panel``). One
exchange on the group key serves the means, the fit, the lagged scores and the
final sums: coefficients are computed as window aggregates, not joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.special import normal_interval, normal_two_sided
from tidemark.operators.stats import complete, not_nan


def ols(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """Slope, intercept, R squared and n: one partial aggregation, any group size."""
    return complete(df, [x, y]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        not_nan(F.regr_slope(y, x)).alias("slope"),
        not_nan(F.regr_intercept(y, x)).alias("intercept"),
        not_nan(F.regr_r2(y, x)).alias("r2"),
    )


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def ols_hac(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    by: Sequence[str],
    lags: int | str,
    order: str = "month",
    max_lags: int | None = None,
    with_p: bool = True,
) -> DataFrame:
    """OLS of y on one or two regressors, Bartlett-weighted HAC errors, normal tails.

    ``lags`` is a number, or a column with the lag length of each group (then
    ``max_lags`` bounds it). Rows follow each other after rows with a missing value
    are dropped, so months on both sides of a dropped gap count as neighbours.
    One output row per group and regressor.
    """
    if len(xs) not in (1, 2):
        raise ValueError("one or two regressors")
    lag_of = F.lit(lags) if isinstance(lags, int) else F.col(lags)
    top = lags if isinstance(lags, int) else max_lags
    if top is None:
        raise ValueError("give max_lags when the lag length is a column")
    keep = [] if isinstance(lags, int) else [lags]
    whole = Window.partitionBy(*by)
    ordered = Window.partitionBy(*by).orderBy(order)

    d = complete(df, [y, *xs]).select(*by, *[c for c in keep if c not in by], order, y, *xs)
    # Centre first: slopes and their errors do not change, moments stay well conditioned.
    d = d.select(
        "*",
        (F.col(y) - F.avg(y).over(whole)).alias("_y"),
        *[(F.col(x) - F.avg(x).over(whole)).alias(f"_x{i}") for i, x in enumerate(xs)],
        F.avg(y).over(whole).alias("_my"),
        *[F.avg(x).over(whole).alias(f"_m{i}") for i, x in enumerate(xs)],
    )

    def s(a: str, b: str) -> Column:
        return F.sum(F.col(a) * F.col(b)).over(whole)

    if len(xs) == 1:
        d = d.withColumn("_b0", F.try_divide(s("_x0", "_y"), s("_x0", "_x0")))
        fit = F.col("_b0") * F.col("_x0")
    else:
        d = d.select(
            "*", s("_x0", "_x0").alias("_s00"), s("_x0", "_x1").alias("_s01"), s("_x1", "_x1").alias("_s11"),
            s("_x0", "_y").alias("_s0y"), s("_x1", "_y").alias("_s1y"),
        )
        det = F.col("_s00") * F.col("_s11") - F.col("_s01") * F.col("_s01")
        d = d.select(
            "*",
            F.try_divide(F.col("_s11") * F.col("_s0y") - F.col("_s01") * F.col("_s1y"), det).alias("_b0"),
            F.try_divide(F.col("_s00") * F.col("_s1y") - F.col("_s01") * F.col("_s0y"), det).alias("_b1"),
        )
        fit = F.col("_b0") * F.col("_x0") + F.col("_b1") * F.col("_x1")
    d = d.withColumn("_u", F.col("_y") - fit)
    score = [f"_g{i}" for i in range(len(xs))]
    d = d.select("*", *[(F.col("_u") * F.col(f"_x{i}")).alias(g) for i, g in enumerate(score)])

    # Weighted sum of earlier scores; weight 1 - l / (L + 1), zero beyond the group's L.
    def weighted(g: str) -> Column:
        terms = []
        for lag in range(1, top + 1):
            w = F.greatest(F.lit(0.0), 1 - F.lit(float(lag)) / (lag_of + 1))
            terms.append(w * F.lag(g, lag, 0.0).over(ordered))
        return _total(terms) if terms else F.lit(0.0)

    d = d.select("*", *[weighted(g).alias(f"_w{i}") for i, g in enumerate(score)])

    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_u") * F.col("_u")).alias("_rss"),
        F.sum(F.col("_y") * F.col("_y")).alias("_tss"),
        F.first("_my").alias("_my"),
    ]
    for i in range(len(xs)):
        aggs += [F.first(f"_b{i}").alias(f"_b{i}"), F.first(f"_m{i}").alias(f"_m{i}")]
        for j in range(i, len(xs)):
            aggs.append(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_q{i}{j}"))
            aggs.append(
                F.sum(
                    F.col(f"_g{i}") * F.col(f"_g{j}")
                    + F.col(f"_g{i}") * F.col(f"_w{j}")
                    + F.col(f"_w{i}") * F.col(f"_g{j}")
                ).alias(f"_h{i}{j}")
            )
    out = d.groupBy(*by).agg(*aggs)
    c = F.col
    if len(xs) == 1:
        var = [F.try_divide(c("_h00"), c("_q00") * c("_q00"))]
    else:
        det = c("_q00") * c("_q11") - c("_q01") * c("_q01")
        # (a, b) and (b, d): rows of the inverse moment matrix, before dividing by det.
        a, b, e = c("_q11"), -c("_q01"), c("_q00")
        v0 = a * a * c("_h00") + 2 * a * b * c("_h01") + b * b * c("_h11")
        v1 = b * b * c("_h00") + 2 * b * e * c("_h01") + e * e * c("_h11")
        var = [F.try_divide(v0, det * det), F.try_divide(v1, det * det)]
    intercept = c("_my") - _total([c(f"_b{i}") * c(f"_m{i}") for i in range(len(xs))])
    rows = F.array(
        *[
            F.struct(
                F.lit(x).alias("variable"),
                c(f"_b{i}").alias("coefficient"),
                F.when(var[i] >= 0, F.sqrt(var[i])).alias("se"),
            )
            for i, x in enumerate(xs)
        ]
    )
    out = out.select(
        *by, "n", (1 - F.try_divide("_rss", "_tss")).alias("r2"), intercept.alias("intercept"),
        F.explode(rows).alias("_e"),
    ).select(*by, "_e.variable", "_e.coefficient", "_e.se", "intercept", "r2", "n")
    low, high = normal_interval(c("coefficient"), c("se"))
    out = out.select("*", low.alias("ci_low"), high.alias("ci_high"))
    return out.withColumn("p", normal_two_sided(F.try_divide("coefficient", "se"))) if with_p else out


def refit_variants(
    df: DataFrame,
    variants: Mapping[str, tuple[str, Sequence[str]]],
    x: str,
    by: Sequence[str],
    lags: int,
    order: str = "month",
    with_p: bool = True,
) -> DataFrame:
    """Refit with another dependent column and without some months; r beside each fit (with one regressor, its sign and the root of r2).

    ``variants``: name -> (dependent column, months to leave out). All variants
    share one scan: each row is expanded to the variants that use it.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("variant"),
                F.when(~F.col(order).isin([*map(_as_date, skip)]), F.col(dep)).alias("dep")
                if skip
                else F.col(dep).alias("dep"),
            )
            for name, (dep, skip) in variants.items()
        ]
    )
    long = df.select(*by, order, x, F.explode(rows).alias("_v")).select(*by, "_v.variant", order, F.col("_v.dep").alias("dep"), x)
    fit = ols_hac(long, "dep", [x], [*by, "variant"], lags, order, with_p=with_p)
    return fit.withColumn("r", F.signum("coefficient") * F.sqrt(F.greatest("r2", F.lit(0.0))))


def _as_date(text: str):
    import datetime

    return datetime.date.fromisoformat(text)


def slope_grid(
    df: DataFrame,
    predictors: Sequence[str],
    outcomes: Mapping[int, str],
    periods: Sequence[tuple[str, str, str]],
    by: Sequence[str],
    order: str = "month",
    with_p: bool = True,
) -> DataFrame:
    """Slope of each forward outcome on each predictor in each period, HAC lags = horizon."""
    grid = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                F.lit(name).alias("period"),
                F.lit(p).alias("predictor"),
                F.col(p).cast("double").alias("px"),
                F.when(F.col(order).between(F.lit(a).cast("date"), F.lit(z).cast("date")), F.col(out)).alias("oy"),
            )
            for h, out in outcomes.items()
            for name, a, z in periods
            for p in predictors
        ]
    )
    long = df.select(*by, order, F.explode(grid).alias("_g")).select(*by, order, "_g.*")
    keys = [*by, "horizon", "period", "predictor"]
    fit = ols_hac(long, "oy", ["px"], keys, "horizon", order, max_lags=max(outcomes), with_p=with_p)
    return fit.drop("variable", "intercept").withColumnRenamed("coefficient", "slope")
