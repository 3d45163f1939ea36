"""Does A move against B? Correlation, regression, timing and robustness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bootstrap as B
from tidemark.operators import panel as P
from tidemark.operators import regression as R
from tidemark.operators import stats as T
from tidemark.queries.common import (
    BLOCK, CHANGES_SQL, HAC_LAGS, LINK_SQL, PANEL_SQL, PERIODS, ROLLING,
    changes, corr_p_sql, link, normal_p_sql, panel, r, rounded, rs,
)
from tidemark.queries.registry import query

BY = ["series_id"]


@query(
    "dollar_link",
    "J1 K7 W1 T1 T4 T23",
    f"""WITH {LINK_SQL}
SELECT series_id, COUNT(*) AS n, {r("corr(px, idx)")} AS r, {r("regr_slope(px, idx)")} AS slope,
  {r("regr_r2(px, idx)")} AS r2,
  COUNT(*) FILTER (WHERE px * idx < 0) AS opposite, COUNT(*) FILTER (WHERE px * idx > 0) AS same,
  COUNT(*) FILTER (WHERE px = 0 OR idx = 0) AS unchanged
FROM pairs_ok GROUP BY series_id""",
)
def dollar_link(spark, sf):
    sx, si = F.signum("px"), F.signum("idx")
    out = T.complete(link(spark, sf), ["px", "idx"]).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        T.corr("px", "idx").alias("r"),
        F.regr_slope("px", "idx").alias("slope"),
        F.regr_r2("px", "idx").alias("r2"),
        F.count_if(sx * si < 0).alias("opposite"),
        F.count_if(sx * si > 0).alias("same"),
        F.count_if((sx == 0) | (si == 0)).alias("unchanged"),
    )
    return rounded(out)


@query(
    "monthly_changes",
    "W1 W2 trap2",
    f"""WITH {CHANGES_SQL}
SELECT series_id, month, {rs("px_logret_m, px_pct_m, px_fx_logret_m, idx_logret_m, idx_pct_m, px_real_logret_m, defl_chg_pp_m")}
FROM changes""",
)
def monthly_changes(spark, sf):
    cols = ["px_logret_m", "px_pct_m", "px_fx_logret_m", "idx_logret_m", "idx_pct_m", "px_real_logret_m", "defl_chg_pp_m"]
    return rounded(changes(spark, sf).select("series_id", "month", *cols))


@query(
    "pearson",
    "T1",
    f"""WITH {LINK_SQL}, a AS (SELECT series_id, COUNT(*) AS n, corr(px, idx) AS r FROM pairs_ok GROUP BY series_id)
SELECT series_id, n, {r("r")} AS r, {r(corr_p_sql("r", "n"))} AS p FROM a""",
)
def pearson(spark, sf):
    return rounded(T.pearson(link(spark, sf), "px", "idx", BY))


@query(
    "spearman",
    "T2",
    f"""WITH {LINK_SQL},
k AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY px)
    + (COUNT(*) OVER (PARTITION BY series_id, px) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY series_id ORDER BY idx)
    + (COUNT(*) OVER (PARTITION BY series_id, idx) - 1) / 2.0 AS ry FROM pairs_ok),
a AS (SELECT series_id, COUNT(*) AS n, corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) AS rho FROM k GROUP BY series_id)
SELECT series_id, n, {r("rho")} AS rho, {r(corr_p_sql("rho", "n"))} AS p FROM a""",
)
def spearman(spark, sf):
    return rounded(T.spearman(link(spark, sf), "px", "idx", BY))


@query(
    "ols",
    "T4",
    f"""WITH {LINK_SQL}
SELECT series_id, COUNT(*) AS n, {r("regr_slope(px, idx)")} AS slope,
  {r("regr_intercept(px, idx)")} AS intercept, {r("regr_r2(px, idx)")} AS r2
FROM pairs_ok GROUP BY series_id""",
)
def ols(spark, sf):
    return rounded(R.ols(link(spark, sf), "px", "idx", BY))


def hac_sql(source: str, keys: str, y: str, x: str, lag: str, top: int, order: str) -> str:
    """CTEs ending in ``hac``: slope, its HAC error, r2 and n for one regressor, written as plain lag sums."""
    lags = " + ".join(
        f"greatest(0.0, 1 - {i}.0 / ({lag} + 1)) * 2 * s * COALESCE(lag(s, {i}) OVER o, 0.0)" for i in range(1, top + 1)
    )
    part = f"PARTITION BY {keys}"
    return f"""
h0 AS (SELECT *, {y} AS yy, {x} AS xx, AVG({x}) OVER ({part}) AS mx FROM {source} WHERE {y} IS NOT NULL AND {x} IS NOT NULL),
h1 AS (SELECT *, regr_slope(yy, xx) OVER ({part}) AS b, regr_intercept(yy, xx) OVER ({part}) AS a FROM h0),
h2 AS (SELECT *, (yy - a - b * xx) * (xx - mx) AS s FROM h1),
h3 AS (SELECT *, s * s + {lags} AS meat FROM h2 WINDOW o AS ({part} ORDER BY {order})),
hac AS (SELECT {keys}, COUNT(*) AS n, MAX(b) AS coefficient, MAX(a) AS intercept,
  sqrt(SUM(meat)) / SUM((xx - mx) * (xx - mx)) AS se, regr_r2(yy, xx) AS r2 FROM h3 GROUP BY {keys})"""


@query(
    "ols_hac",
    "T5 T6",
    f"""WITH {LINK_SQL}, {hac_sql("link", "series_id", "px", "idx", str(HAC_LAGS), HAC_LAGS, "month")}
SELECT series_id, 'idx' AS variable, {rs("coefficient, se, intercept, r2")}, n,
  {r("coefficient - 1.959963984540054 * se")} AS ci_low, {r("coefficient + 1.959963984540054 * se")} AS ci_high,
  {r(normal_p_sql("(coefficient / se)"))} AS p FROM hac""",
)
def ols_hac(spark, sf):
    return rounded(R.ols_hac(link(spark, sf), "px", ["idx"], BY, HAC_LAGS))


@query(
    "ols_hac_two",
    "T4 T5",
    f"""WITH {LINK_SQL},
c0 AS (SELECT series_id, month, px - AVG(px) OVER k AS y, idx - AVG(idx) OVER k AS x0, dd - AVG(dd) OVER k AS x1,
    AVG(px) OVER k AS my, AVG(idx) OVER k AS m0, AVG(dd) OVER k AS m1
  FROM link WHERE px IS NOT NULL AND idx IS NOT NULL AND dd IS NOT NULL WINDOW k AS (PARTITION BY series_id)),
q AS (SELECT series_id, SUM(x0 * x0) AS q00, SUM(x0 * x1) AS q01, SUM(x1 * x1) AS q11, SUM(x0 * y) AS p0,
    SUM(x1 * y) AS p1, COUNT(*) AS n, SUM(y * y) AS tss, MAX(my) AS my, MAX(m0) AS m0, MAX(m1) AS m1
  FROM c0 GROUP BY series_id),
b AS (SELECT *, (q11 * p0 - q01 * p1) / (q00 * q11 - q01 * q01) AS b0, (q00 * p1 - q01 * p0) / (q00 * q11 - q01 * q01) AS b1 FROM q),
u AS (SELECT c0.series_id, c0.month, y - b0 * x0 - b1 * x1 AS u, x0, x1 FROM c0 JOIN b USING (series_id)),
s AS (SELECT *, u * x0 AS s0, u * x1 AS s1, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY month) AS t FROM u),
meat AS (SELECT a.series_id, SUM(w * a.s0 * c.s0) AS h00, SUM(w * (a.s0 * c.s1 + a.s1 * c.s0) / 2) AS h01, SUM(w * a.s1 * c.s1) AS h11
  FROM (SELECT series_id, t, s0, s1 FROM s) a JOIN (SELECT series_id, t, s0, s1 FROM s) c USING (series_id),
  LATERAL (SELECT 1 - abs(a.t - c.t) / ({HAC_LAGS} + 1.0) AS w) WHERE abs(a.t - c.t) <= {HAC_LAGS} GROUP BY a.series_id),
rss AS (SELECT series_id, SUM(u * u) AS rss FROM u GROUP BY series_id),
f AS (SELECT b.*, rss, h00, h01, h11, q00 * q11 - q01 * q01 AS det FROM b JOIN meat USING (series_id) JOIN rss USING (series_id)),
o AS (SELECT series_id, n, 1 - rss / tss AS r2, my - b0 * m0 - b1 * m1 AS intercept, 'idx' AS variable, b0 AS coefficient,
    sqrt(q11 * q11 * h00 - 2 * q11 * q01 * h01 + q01 * q01 * h11) / abs(det) AS se FROM f
  UNION ALL SELECT series_id, n, 1 - rss / tss, my - b0 * m0 - b1 * m1, 'dd', b1,
    sqrt(q01 * q01 * h00 - 2 * q01 * q00 * h01 + q00 * q00 * h11) / abs(det) FROM f)
SELECT series_id, variable, n, {rs("r2, intercept, coefficient, se")},
  {r("coefficient - 1.959963984540054 * se")} AS ci_low, {r("coefficient + 1.959963984540054 * se")} AS ci_high FROM o""",
)
def ols_hac_two(spark, sf):
    return rounded(R.ols_hac(link(spark, sf), "px", ["idx", "dd"], BY, HAC_LAGS, with_p=False))


N_BOOT, SEED = 5000, 42
_P = B.PRIME


def _round_sql(src: str, dst: str, add: int) -> str:
    sq = f"(x * x % {_P})"
    return f"{dst} AS (SELECT *  REPLACE (((({sq} * {sq}) % {_P}) * x + {add}) % {_P} AS x) FROM {src})"


def draws_sql(source: str) -> str:
    """CTEs ending in ``draws``: the blocks of every resample, for each sample size n in ``source``."""
    return f"""
sizes AS (SELECT DISTINCT n, CAST(ceil(n / {BLOCK}.0) AS BIGINT) AS k FROM {source}),
d0 AS (SELECT n, k, rep, blk, (rep * k + blk + {SEED} * 1000003 + 1) % {_P} AS x FROM sizes,
    (SELECT unnest(range(0, {N_BOOT})) AS rep), LATERAL (SELECT unnest(range(0, k)) AS blk)),
{_round_sql("d0", "d1", B.ROUND_ADD[0])}, {_round_sql("d1", "d2", B.ROUND_ADD[1])}, {_round_sql("d2", "d3", B.ROUND_ADD[2])},
draws AS (SELECT n, rep, x % (n - {BLOCK} + 1) AS start_, CASE WHEN blk = k - 1 THEN n - (k - 1) * {BLOCK} ELSE {BLOCK} END AS len FROM d3)"""


@query(
    "bootstrap_ci",
    "T3",
    f"""WITH {LINK_SQL},
t AS (SELECT series_id, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY month) - 1 AS t,
    px - AVG(px) OVER (PARTITION BY series_id) AS x, idx - AVG(idx) OVER (PARTITION BY series_id) AS y,
    COUNT(*) OVER (PARTITION BY series_id) AS n FROM pairs_ok),
{draws_sql("t")},
m AS (SELECT t.series_id, d.rep, COUNT(*) AS n, SUM(x) AS sx, SUM(y) AS sy, SUM(x * x) AS sxx, SUM(y * y) AS syy, SUM(x * y) AS sxy
  FROM (SELECT *, unnest(range(0, len)) AS j FROM draws) d JOIN t ON t.n = d.n AND t.t = d.start_ + d.j GROUP BY t.series_id, d.rep),
q AS (SELECT series_id, n, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS rr FROM m)
SELECT series_id, n, {r("quantile_cont(rr, 0.025)")} AS ci_low, {r("quantile_cont(rr, 0.975)")} AS ci_high
FROM q GROUP BY series_id, n""",
)
def bootstrap_ci(spark, sf):
    return rounded(B.block_bootstrap_corr(link(spark, sf), "px", "idx", BY, BLOCK, N_BOOT, SEED))


def corr_rows_sql(source: str, keys: str) -> str:
    """CTEs ending in ``told``: the figures of corr_rows for complete pairs (y, x) of ``source``. Resamples are built row by row."""
    k = f"PARTITION BY {keys}"
    rank = lambda c: f"rank() OVER ({k} ORDER BY {c}) + (COUNT(*) OVER ({k}, {c}) - 1) / 2.0"
    each = ", ".join(f"t.{c.strip()}" for c in keys.split(","))
    sums = lambda a, b: f"COUNT(*) * SUM({a} * {b}) - SUM({a}) * SUM({b})"
    return f"""
ranked AS (SELECT {keys}, month, y, x, CAST({rank("y")} AS DOUBLE) AS ry, CAST({rank("x")} AS DOUBLE) AS rx FROM {source}),
t AS (SELECT {keys}, ROW_NUMBER() OVER ({k} ORDER BY month) - 1 AS t, COUNT(*) OVER ({k}) AS n,
    {", ".join(f"{c} - AVG({c}) OVER ({k}) AS {c}" for c in ("y", "x", "ry", "rx"))} FROM ranked),
{draws_sql("t")},
q AS (SELECT {each}, d.rep, ({sums("y", "t.x")}) / sqrt(({sums("y", "y")}) * ({sums("t.x", "t.x")})) AS rr,
    ({sums("ry", "rx")}) / sqrt(({sums("ry", "ry")}) * ({sums("rx", "rx")})) AS rk
  FROM (SELECT n, rep, start_, unnest(range(0, len)) AS j FROM draws) d JOIN t ON t.n = d.n AND t.t = d.start_ + d.j GROUP BY {each}, d.rep),
ends AS (SELECT {keys}, quantile_cont(rr, 0.025) AS ci_low, quantile_cont(rr, 0.975) AS ci_high, quantile_cont(rk, 0.025) AS rho_low, quantile_cont(rk, 0.975) AS rho_high FROM q GROUP BY {keys}),
mids AS (SELECT {keys}, COUNT(*) AS n, corr(y, x) AS r, corr(ry, rx) AS rho FROM ranked GROUP BY {keys}),
{hac_sql(source, keys, "y", "x", str(HAC_LAGS), HAC_LAGS, "month")},
told AS (SELECT {keys}, m.n, r, {corr_p_sql("r", "m.n")} AS p, ci_low, ci_high, rho, {corr_p_sql("rho", "m.n")} AS rho_p, rho_low, rho_high,
    coefficient AS slope, coefficient - 1.959963984540054 * se AS slope_low, coefficient + 1.959963984540054 * se AS slope_high
  FROM mids m JOIN ends USING ({keys}) JOIN hac USING ({keys}))"""


MEASURES = {"index": "idx_logret_m", "rate": "fx_logret_m"}
LEFT_OUT = [("rate", "all")]
FIGURES = ", ".join(B.FIGURES)


@query(
    "corr_by_period",
    "T1 T2 T3 T5 T7",
    f"""WITH {CHANGES_SQL}, p AS (SELECT * FROM (VALUES {", ".join(f"('{n}', DATE '{a}', DATE '{z}')" for n, a, z in PERIODS)}) v(period, a, z)),
measured AS ({" UNION ALL ".join(f"SELECT series_id, month, '{m}' AS measure, px_logret_m AS y, {c} AS x FROM changes" for m, c in MEASURES.items())}),
src AS (SELECT series_id, measure, period, month, y, x FROM measured JOIN p ON month BETWEEN a AND z
  WHERE y IS NOT NULL AND x IS NOT NULL AND {" AND ".join(f"NOT (measure = '{m}' AND period = '{n}')" for m, n in LEFT_OUT)}),
{corr_rows_sql("src", "series_id, measure, period")}
SELECT series_id, measure, period, n, {rs(FIGURES)} FROM told""",
)
def corr_by_period(spark, sf):
    long = T.by_measure_and_period(changes(spark, sf), "px_logret_m", MEASURES, PERIODS, BY, skip=LEFT_OUT)
    return rounded(B.corr_rows(long, "y", "x", [*BY, "measure", "period"], HAC_LAGS, BLOCK, N_BOOT, SEED))


KS = (-2, -1, 0, 1, 2, 3)


@query(
    "lead_lag",
    "T8 W11",
    f"""WITH {LINK_SQL},
l AS ({" UNION ALL ".join(f"SELECT series_id, {k} AS k, px, {'lag' if k >= 0 else 'lead'}(idx, {abs(k)}) OVER (PARTITION BY series_id ORDER BY month) AS y FROM link" for k in KS)}),
a AS (SELECT series_id, k, corr(px, y) AS r, COUNT(*) AS n FROM l WHERE px IS NOT NULL AND y IS NOT NULL GROUP BY series_id, k)
SELECT series_id, k, {r("r")} AS r, n, {r(corr_p_sql("r", "n"))} AS p FROM a""",
)
def lead_lag(spark, sf):
    return rounded(T.lead_lag_corr(link(spark, sf), "px", "idx", KS, BY))


@query(
    "rolling_corr",
    "W8",
    f"""WITH {LINK_SQL}
SELECT series_id, month, {r(f"CASE WHEN COUNT(CASE WHEN px IS NOT NULL AND idx IS NOT NULL THEN 1 END) OVER w = {ROLLING} THEN corr(px, idx) OVER w END")} AS r
FROM link WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN {ROLLING - 1} PRECEDING AND CURRENT ROW)""",
)
def rolling_corr(spark, sf):
    return rounded(link(spark, sf).select("series_id", "month", P.rolling_corr("px", "idx", ROLLING, BY).alias("r")))


BASE = "1996-01-01"


@query(
    "rebase",
    "T9",
    f"""WITH {PANEL_SQL},
b AS (SELECT series_id, px AS b_px, idx AS b_idx FROM panel WHERE month = DATE '{BASE}')
SELECT p.series_id, p.month, {r("px * 100 / b_px")} AS px_indexed, {r("idx * 100 / b_idx")} AS idx_indexed
FROM panel p LEFT JOIN b ON b.series_id = p.series_id""",
)
def rebase(spark, sf):
    return rounded(panel(spark, sf).select("series_id", "month", *T.rebase(["px", "idx"], BASE, BY)))


STARTS = {"since 1996-01": "1996-01-01", "since 1999-01": "1999-01-01", "since 2000-06": "2000-06-01"}


@query(
    "window_change",
    "T10",
    f"""WITH {PANEL_SQL},
s AS (SELECT * FROM (VALUES {", ".join(f"('{n}', DATE '{d}')" for n, d in STARTS.items())}) v("window", start_)),
z AS (SELECT series_id, arg_max(px, month) AS px, arg_max(px_fx, month) AS px_fx, arg_max(inv, month) AS inv
  FROM (SELECT *, 1 / fx AS inv FROM panel) GROUP BY series_id),
k AS (SELECT z.series_id, s."window", s.start_, z.px, z.px_fx, z.inv FROM z CROSS JOIN s)
SELECT k.series_id, k."window", {r("(k.px / a.px - 1) * 100")} AS px_change_pct, {r("(k.px_fx / a.px_fx - 1) * 100")} AS px_fx_change_pct,
  {r("(k.inv / (1 / a.fx) - 1) * 100")} AS inv_change_pct
FROM k LEFT JOIN panel a ON a.series_id = k.series_id AND a.month = k.start_""",
)
def window_change(spark, sf):
    inv = panel(spark, sf).withColumn("inv", F.try_divide(F.lit(1.0), "fx"))
    return rounded(T.window_change(inv, ["px", "px_fx", "inv"], STARTS, BY))


@query(
    "variance_split",
    "T11 G11",
    f"""WITH {CHANGES_SQL},
d AS (SELECT series_id, month, px_logret_m * 100 AS a, -fx_logret_m * 100 AS b, px_fx_logret_m * 100 AS t FROM changes
  WHERE px_logret_m IS NOT NULL AND fx_logret_m IS NOT NULL AND px_fx_logret_m IS NOT NULL),
w AS (SELECT series_id, stddev_samp(a) AS std_a, stddev_samp(b) AS std_b, stddev_samp(t) AS std_total, var_samp(a) AS var_a,
    var_samp(b) AS var_b, 2 * covar_samp(a, b) AS cov2_ab, var_samp(t) AS var_total, CAST(COUNT(*) AS DOUBLE) AS months,
    CAST(strftime(MIN(month), '%Y%m') AS DOUBLE) AS first_yyyymm, CAST(strftime(MAX(month), '%Y%m') AS DOUBLE) AS last_yyyymm
  FROM d GROUP BY series_id)
SELECT series_id, measure, {r("value")} AS value FROM (UNPIVOT w ON COLUMNS(* EXCLUDE (series_id)) INTO NAME measure VALUE value)""",
)
def variance_split(spark, sf):
    d = changes(spark, sf).select(
        "series_id", "month", (F.col("px_logret_m") * 100).alias("a"), (-F.col("fx_logret_m") * 100).alias("b"),
        (F.col("px_fx_logret_m") * 100).alias("t"),
    )
    return rounded(T.variance_split(d, "a", "b", "t", BY))


SKIP = ["1998-10-01", "1998-11-01"]


@query(
    "refit_variants",
    "T12",
    f"""WITH {CHANGES_SQL},
v AS (SELECT series_id, 'all months' AS variant, month, px_logret_m AS y, idx_logret_m AS x FROM changes
  UNION ALL SELECT series_id, 'without two months', month, CASE WHEN month NOT IN ({", ".join(f"DATE '{d}'" for d in SKIP)}) THEN px_logret_m END, idx_logret_m FROM changes
  UNION ALL SELECT series_id, 'deflated', month, px_real_logret_m, idx_logret_m FROM changes),
{hac_sql("v", "series_id, variant", "y", "x", str(HAC_LAGS), HAC_LAGS, "month")},
rr AS (SELECT series_id, variant, corr(y, x) AS r FROM v WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY series_id, variant)
SELECT series_id, variant, {rs("coefficient, se, r2, r")}, n FROM hac JOIN rr USING (series_id, variant)""",
)
def refit_variants(spark, sf):
    fit = R.refit_variants(
        changes(spark, sf),
        {
            "all months": ("px_logret_m", []),
            "without two months": ("px_logret_m", SKIP),
            "deflated": ("px_real_logret_m", []),
        },
        "idx_logret_m", BY, HAC_LAGS, with_p=False,
    )
    return rounded(fit.select("series_id", "variant", "coefficient", "se", "r2", "r", "n"))


VERSIONS = {"nominal": ("px_logret_m", "idx_logret_m"), "real": ("px_real_logret_m", "idx_logret_m"), "in the other currency": ("px_fx_logret_m", "idx_logret_m")}
PAIRED = sorted({c for pair in VERSIONS.values() for c in pair})


@query(
    "paired_sample",
    "T1 T2 T3 T5 T13 J10",
    f"""WITH {CHANGES_SQL},
common AS (SELECT * FROM changes WHERE {" AND ".join(f"{c} IS NOT NULL" for c in PAIRED)}),
src AS ({" UNION ALL ".join(f"SELECT series_id, '{n}' AS version, month, {a} AS y, {b} AS x FROM common" for n, (a, b) in VERSIONS.items())}),
{corr_rows_sql("src", "series_id, version")}
SELECT series_id, version, n, {rs(FIGURES)} FROM told""",
)
def paired_sample(spark, sf):
    long = T.by_version(changes(spark, sf), VERSIONS, BY)
    return rounded(B.corr_rows(long, "y", "x", [*BY, "version"], HAC_LAGS, BLOCK, N_BOOT, SEED))


@query(
    "sample_sizes",
    "T14",
    f"""WITH {CHANGES_SQL}
SELECT series_id, 'series and index' AS comparison, COUNT(*) AS months, MIN(month) AS first_month, MAX(month) AS last_month
FROM changes WHERE px_logret_m IS NOT NULL AND idx_logret_m IS NOT NULL GROUP BY series_id
UNION ALL SELECT series_id, 'series and rate', COUNT(*), MIN(month), MAX(month)
FROM changes WHERE px_logret_m IS NOT NULL AND fx_logret_m IS NOT NULL GROUP BY series_id""",
)
def sample_sizes(spark, sf):
    sets = {"series and index": ["px_logret_m", "idx_logret_m"], "series and rate": ["px_logret_m", "fx_logret_m"]}
    return T.sample_sizes(changes(spark, sf), sets, BY)


@query(
    "direction_counts",
    "T23",
    f"""WITH {LINK_SQL}, c AS (SELECT series_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE idx > 0) AS b_rose,
  COUNT(*) FILTER (WHERE idx > 0 AND px < 0) AS a_fell_when_b_rose, COUNT(*) FILTER (WHERE idx < 0) AS b_fell,
  COUNT(*) FILTER (WHERE idx < 0 AND px > 0) AS a_rose_when_b_fell,
  COUNT(*) FILTER (WHERE (px > 0 AND idx > 0) OR (px < 0 AND idx < 0)) AS same,
  COUNT(*) FILTER (WHERE px = 0 OR idx = 0) AS unchanged FROM pairs_ok GROUP BY series_id)
SELECT *, a_fell_when_b_rose + a_rose_when_b_fell AS opposite, {r("a_fell_when_b_rose * 100.0 / nullif(b_rose, 0)")} AS a_fell_when_b_rose_pct,
  {r("a_rose_when_b_fell * 100.0 / nullif(b_fell, 0)")} AS a_rose_when_b_fell_pct,
  {r("(a_fell_when_b_rose + a_rose_when_b_fell) * 100.0 / n")} AS opposite_pct FROM c""",
)
def direction_counts(spark, sf):
    return rounded(T.direction_counts(link(spark, sf), "px", "idx", BY))


@query(
    "direction_class",
    "T24",
    f"""WITH {CHANGES_SQL}
SELECT series_id, month, {r("idx_pct_m", 3)} AS idx_pct, {r("px_pct_m", 3)} AS px_pct,
  CASE WHEN px_pct_m = 0 OR idx_pct_m = 0 THEN 'unchanged' WHEN (px_pct_m > 0) <> (idx_pct_m > 0) THEN 'opposite' ELSE 'same' END AS direction
FROM changes WHERE px_pct_m IS NOT NULL AND idx_pct_m IS NOT NULL""",
)
def direction_class(spark, sf):
    d = T.complete(changes(spark, sf), ["px_pct_m", "idx_pct_m"])
    out = d.select(
        "series_id", "month", F.col("idx_pct_m").alias("idx_pct"), F.col("px_pct_m").alias("px_pct"),
        T.direction_class("px_pct_m", "idx_pct_m").alias("direction"),
    )
    return rounded(out, 3)


@query(
    "geo_mean",
    "T15",
    f"""WITH {CHANGES_SQL}
SELECT series_id, {r("(exp(AVG(px_logret_m)) - 1) * 100")} AS geo_mean_pct FROM changes GROUP BY series_id""",
)
def geo_mean(spark, sf):
    return rounded(changes(spark, sf).groupBy("series_id").agg(T.geo_mean_pct(F.col("px_logret_m")).alias("geo_mean_pct")))
