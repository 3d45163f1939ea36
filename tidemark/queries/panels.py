"""Panels, ratios, past percentiles, signals and episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import panel as P
from tidemark.operators import percentile as PC
from tidemark.operators import regression as R
from tidemark.operators import signals as S
from tidemark.operators import stats as T
from tidemark.operators import tables as TB
from tidemark.plans import inputs as I
from tidemark.plans.inputs import views
from tidemark.queries.common import (
    HORIZONS, LOOKBACK, MART_SQL, MONTHS_SQL, PANEL_SQL, PERIODS, RATIO_SQL, RULES, WARMUP,
    mart, months_of_signal, normal_p_sql, panel, r, ratio, rounded, rs, rules_sql,
)
from tidemark.queries.link import hac_sql
from tidemark.queries.registry import query

BY = ["series_id"]


@query("px_monthly", "G3", f"WITH {views('px_monthly')} SELECT series_id, month, {r('value')} AS value, n_days, last_day FROM px_monthly")
def px_monthly(spark, sf):
    return rounded(I.px_monthly(spark, sf).select("series_id", "month", "value", "n_days", "last_day"))


@query(
    "month_end",
    "G4",
    f"""WITH {views('px_monthly')}
SELECT m.series_id, m.month, m.last_day, {r('d.value')} AS month_end FROM px_monthly m
JOIN px_daily d ON d.series_id = m.series_id AND d.date = m.last_day""",
)
def month_end(spark, sf):
    return rounded(I.px_monthly(spark, sf).select("series_id", "month", "last_day", "month_end"))


@query(
    "complete_months",
    "G5 Q6",
    f"""WITH {views('px_monthly')}
SELECT series_id, month, n_days FROM px_monthly m WHERE month < (SELECT MAX(month) FROM px_monthly x WHERE x.series_id = m.series_id)""",
)
def complete_months(spark, sf):
    return P.drop_incomplete_last(I.px_monthly(spark, sf), BY).select("series_id", "month", "n_days")


@query(
    "month_spine",
    "K7",
    f"""WITH {views('px_monthly')}
SELECT series_id, CAST(unnest(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM px_monthly GROUP BY series_id""",
)
def month_spine(spark, sf):
    return P.month_spine(I.px_monthly(spark, sf), BY)


@query("monthly_panel", "M1 J1 A9", f"WITH {PANEL_SQL} SELECT series_id, month, {rs('px, idx, defl, fx, px_fx')} FROM panel")
def monthly_panel(spark, sf):
    return rounded(panel(spark, sf))


@query(
    "pivot_series",
    "G1 M24",
    f"""WITH {views('px_monthly')}
SELECT month, {", ".join(f"{r(f'''MAX(CASE WHEN series_id = 'Brand#{i}' THEN value END)''')} AS b{i}" for i in (1, 2, 3))}
FROM px_monthly WHERE series_id IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY month""",
)
def pivot_series(spark, sf):
    names = [(f"Brand#{i}", f"b{i}") for i in (1, 2, 3)]
    return rounded(P.pivot_series(I.px_monthly(spark, sf), ["month"], "series_id", "value", names))


REAL_SQL = views("px_monthly", "defl_monthly") + """,
real_ AS (SELECT p.series_id, p.month, p.value,
  p.value * (SELECT value FROM defl_monthly ORDER BY month DESC LIMIT 1) / d.value AS real
  FROM px_monthly p LEFT JOIN defl_monthly d ON d.month = p.month)"""


def real_prices_df(spark, sf):
    px = I.px_monthly(spark, sf).select("series_id", "month", "value")
    return P.deflate(px, I.defl_monthly(spark, sf))


@query("real_prices", "M3 K2 J12", f"WITH {REAL_SQL} SELECT series_id, month, {rs('value, real')} FROM real_")
def real_prices(spark, sf):
    return rounded(real_prices_df(spark, sf))


@query(
    "cross_rate",
    "M2",
    f"""WITH {PANEL_SQL} SELECT series_id, month, {r("px / fx")} AS px_fx,
  {r("-ln(fx / lag(fx) OVER (PARTITION BY series_id ORDER BY month))")} AS inverse_logret FROM panel""",
)
def cross_rate(spark, sf):
    w = P.window_of(BY)
    inv = -P.log_change(F.col("fx"), F.lag("fx").over(w))
    return rounded(panel(spark, sf).select("series_id", "month", "px_fx", inv.alias("inverse_logret")))


@query(
    "shift_join",
    "J4 Q26",
    f"""WITH {views('px_monthly')} SELECT a.series_id, a.month, {r("a.value")} AS value, {r("b.value")} AS later
FROM px_monthly a LEFT JOIN px_monthly b ON b.series_id = a.series_id AND b.month = a.month + INTERVAL 6 MONTH""",
)
def shift_join(spark, sf):
    px = I.px_monthly(spark, sf).select("series_id", "month", "value")
    return rounded(P.shift_join(px, BY, "value", 6, "later"))


@query("pair_ratio", "M4 J2", f"WITH {RATIO_SQL} SELECT pair_id, month, {rs('num_value, den_value, ratio')} FROM ratio")
def pair_ratio(spark, sf):
    return rounded(ratio(spark, sf))


@query("past_percentile", "W4 W5 J5", f"WITH {MART_SQL} SELECT pair_id, month, {r('pctile_all_past')} AS pctile FROM mart")
def past_percentile(spark, sf):
    p = PC.past_percentile("ratio", ["pair_id"], WARMUP)
    return rounded(ratio(spark, sf).select("pair_id", "month", p.alias("pctile")))


@query("trailing_percentile", "W6 J5", f"WITH {MART_SQL} SELECT pair_id, month, {r('pctile_trailing')} AS pctile FROM mart")
def trailing_percentile(spark, sf):
    p = PC.trailing_percentile("ratio", ["pair_id"], LOOKBACK, WARMUP)
    return rounded(ratio(spark, sf).select("pair_id", "month", p.alias("pctile")))


@query(
    "past_percentile_daily",
    "W5",
    f"""WITH {views('px_daily')}, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) - 1 AS p FROM px_daily)
SELECT a.series_id, a.date, {r("CASE WHEN a.p >= 120 THEN COUNT(*) FILTER (WHERE b.value <= a.value) * 100.0 / a.p END")} AS pctile
FROM o a LEFT JOIN o b ON b.series_id = a.series_id AND b.p < a.p GROUP BY a.series_id, a.date, a.p, a.value""",
)
def past_percentile_daily(spark, sf):
    day = F.unix_date("date")
    d = I.px_daily(spark, sf).select("series_id", "date", day.alias("pos"), "value")
    out = PC.past_percentile_long(d, "value", BY, "pos", None, 120, "pctile")
    return rounded(out.select("series_id", "date", "pctile"))


_FWD = [f"{c}_fwd_{h}m_{k}" for h in HORIZONS for c in ("ratio", "num_value") for k in ("logchg", "pct")]


@query("forward_changes", "W3 M5", f"WITH {MART_SQL} SELECT pair_id, month, {rs(', '.join(_FWD))} FROM mart")
def forward_changes(spark, sf):
    out = P.forward_changes(ratio(spark, sf), ["ratio", "num_value"], HORIZONS, ["pair_id"])
    return rounded(out.select("pair_id", "month", *_FWD))


@query(
    "rule_signals",
    "M6 M7 K8 J3",
    f"""WITH {MONTHS_SQL} SELECT pair_id, month, rule_id, rule_type, threshold, label, horizon, {rs('signal_value, fwd_ratio, fwd_num, fwd_den')}, signal_on FROM valid""",
)
def rule_signals(spark, sf):
    from tidemark.queries.common import SIGNALS

    out = S.evaluate_rules(mart(spark, sf), RULES, SIGNALS, HORIZONS, ["pair_id"])
    return rounded(out.drop("_n"))


@query(
    "episodes",
    "W7 M8",
    f"WITH {MONTHS_SQL} SELECT pair_id, rule_id, horizon, month, signal_on, episode_id, is_episode_start FROM months",
)
def episodes(spark, sf):
    return months_of_signal(spark, sf).select("pair_id", "rule_id", "horizon", "month", "signal_on", "episode_id", "is_episode_start")


@query(
    "episode_table",
    "T20",
    f"""WITH {MONTHS_SQL} SELECT pair_id, rule_id, horizon, episode_id, MIN(month) AS first_month, MAX(month) AS last_month_on, COUNT(*) AS months_on,
  {", ".join(f"{r(f'(exp(MAX(CASE WHEN is_episode_start = 1 THEN fwd_{c} END)) - 1) * 100')} AS {c}_change_pct" for c in ("ratio", "num", "den"))}
FROM months WHERE signal_on = 1 GROUP BY pair_id, rule_id, horizon, episode_id""",
)
def episode_table(spark, sf):
    return rounded(S.episode_table(months_of_signal(spark, sf), ["pair_id", "rule_id", "horizon"]))


_GEO = "(exp(AVG({x})) - 1) * 100"
SUMMARY_SQL = MONTHS_SQL + f""",
summary AS (SELECT pair_id, rule_id, horizon, COUNT(*) FILTER (WHERE signal_on = 1) AS months_on, COUNT(*) FILTER (WHERE signal_on = 0) AS months_off,
  COUNT(*) FILTER (WHERE signal_on = 1) * 100.0 / COUNT(*) AS share_on_pct, COUNT(DISTINCT episode_id) AS episodes,
  {_GEO.format(x="fwd_ratio")} AS avg_ratio_change_all_pct,
  {_GEO.format(x="CASE WHEN signal_on = 1 THEN fwd_ratio END")} AS avg_ratio_change_on_pct,
  {_GEO.format(x="CASE WHEN signal_on = 0 THEN fwd_ratio END")} AS avg_ratio_change_off_pct,
  AVG(CASE WHEN signal_on = 1 THEN CAST(fwd_ratio < 0 AS INTEGER) END) * 100 AS falling_share_on_pct,
  AVG(CASE WHEN signal_on = 0 THEN CAST(fwd_ratio < 0 AS INTEGER) END) * 100 AS falling_share_off_pct,
  {_GEO.format(x="CASE WHEN signal_on = 1 THEN fwd_num END")} AS avg_num_change_on_pct,
  {_GEO.format(x="CASE WHEN signal_on = 1 THEN fwd_den END")} AS avg_den_change_on_pct,
  {_GEO.format(x="CASE WHEN is_episode_start = 1 THEN fwd_ratio END")} AS episode_avg_change_pct,
  COUNT(*) FILTER (WHERE is_episode_start = 1 AND fwd_ratio < 0) AS episodes_falling FROM months GROUP BY pair_id, rule_id, horizon)"""
_SUM_D = (
    "share_on_pct, avg_ratio_change_all_pct, avg_ratio_change_on_pct, avg_ratio_change_off_pct, falling_share_on_pct,"
    " falling_share_off_pct, avg_num_change_on_pct, avg_den_change_on_pct, episode_avg_change_pct"
)


@query("signal_summary", "T16", f"WITH {SUMMARY_SQL} SELECT pair_id, rule_id, horizon, months_on, months_off, episodes, episodes_falling, {rs(_SUM_D)} FROM summary")
def signal_summary(spark, sf):
    out = S.summarize_signal(months_of_signal(spark, sf), ["pair_id", "rule_id", "horizon"])
    return rounded(out.drop("falling_ci_low_pct", "falling_ci_high_pct"))


_Z = 1.959963984540054


@query(
    "wilson",
    "T18",
    f"""WITH {SUMMARY_SQL}, w AS (SELECT *, episodes_falling / CAST(nullif(episodes, 0) AS DOUBLE) AS s, nullif(episodes, 0) AS m FROM summary)
SELECT pair_id, rule_id, horizon, episodes, episodes_falling,
  {r(f"((s + {_Z} * {_Z} / (2 * m)) - {_Z} * sqrt(s * (1 - s) / m + {_Z} * {_Z} / (4.0 * m * m))) / (1 + {_Z} * {_Z} / m) * 100")} AS low_pct,
  {r(f"((s + {_Z} * {_Z} / (2 * m)) + {_Z} * sqrt(s * (1 - s) / m + {_Z} * {_Z} / (4.0 * m * m))) / (1 + {_Z} * {_Z} / m) * 100")} AS high_pct FROM w""",
)
def wilson(spark, sf):
    counts = months_of_signal(spark, sf).groupBy("pair_id", "rule_id", "horizon").agg(
        F.sum("is_episode_start").alias("episodes"),
        F.count_if((F.col("is_episode_start") == 1) & (F.col("fwd_ratio") < 0)).alias("episodes_falling"),
    )
    low, high = T.wilson_ci(F.col("episodes_falling"), F.col("episodes"))
    return rounded(counts.select("*", low.alias("low_pct"), high.alias("high_pct")))


DIFF_SQL = MONTHS_SQL + f""",
enough AS (SELECT *, CAST(signal_on AS DOUBLE) AS x_on FROM months WINDOW g AS (PARTITION BY pair_id, rule_id, horizon)
  QUALIFY SUM(signal_on) OVER g >= 2 AND COUNT(*) OVER g - SUM(signal_on) OVER g >= 2),
{hac_sql("enough", "pair_id, rule_id, horizon", "fwd_ratio", "x_on", "horizon", max(HORIZONS), "n")},
diffs AS (SELECT pair_id, rule_id, horizon, n, coefficient * 100 AS diff_logpts, (coefficient - {_Z} * se) * 100 AS diff_ci_low,
  (coefficient + {_Z} * se) * 100 AS diff_ci_high, {normal_p_sql("(coefficient / se)")} AS p_hac FROM hac)"""


def differences(spark, sf):
    return S.signal_difference(months_of_signal(spark, sf), ["pair_id", "rule_id", "horizon"], max(HORIZONS))


@query("signal_difference", "T17", f"WITH {DIFF_SQL} SELECT pair_id, rule_id, horizon, n, {rs('diff_logpts, diff_ci_low, diff_ci_high, p_hac')} FROM diffs")
def signal_difference(spark, sf):
    return rounded(differences(spark, sf))


HOLM_SQL = DIFF_SQL + """,
ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p_hac) AS k, COUNT(*) OVER () AS m FROM diffs),
holm AS (SELECT *, least(1.0, MAX((m - k + 1) * p_hac) OVER (ORDER BY p_hac)) AS p_holm FROM ranked)"""


@query("holm", "T19", f"WITH {HOLM_SQL} SELECT pair_id, rule_id, horizon, {rs('p_hac, p_holm')} FROM holm")
def holm(spark, sf):
    out = S.holm(differences(spark, sf), "p_hac")
    return rounded(out.select("pair_id", "rule_id", "horizon", "p_hac", "p_holm"))


@query(
    "test_verdicts",
    "T25",
    f"""WITH {HOLM_SQL} SELECT horizon, COUNT(*) AS tests, COUNT(*) FILTER (WHERE diff_logpts < 0) AS negative,
  COUNT(*) FILTER (WHERE diff_ci_low > 0 OR diff_ci_high < 0) AS interval_excludes_zero, COUNT(*) FILTER (WHERE p_hac < 0.05) AS raw_below_5pct,
  COUNT(*) FILTER (WHERE p_holm < 0.05) AS holm_below_5pct FROM holm GROUP BY horizon""",
)
def test_verdicts(spark, sf):
    tests = S.holm(differences(spark, sf), "p_hac")
    return S.test_verdicts(tests, ["horizon"], "diff_logpts", "diff_ci_low", "diff_ci_high", "p_hac", "p_holm")


_PREDS = {"log_ratio": "ln(ratio)", "pctile_all": "pctile_all_past / 100", "pctile_trail": "pctile_trailing / 100"}
_GRID_SQL = " UNION ALL ".join(
    f"SELECT pair_id, month, {h} AS horizon, '{n}' AS period, '{p}' AS predictor, {x} AS px, "
    f"CASE WHEN month BETWEEN DATE '{a}' AND DATE '{z}' THEN ratio_fwd_{h}m_logchg END AS oy FROM mart WHERE pctile_all_past IS NOT NULL"
    for h in HORIZONS for n, a, z in PERIODS[1:] for p, x in _PREDS.items()
)


@query(
    "slope_grid",
    "T21",
    f"""WITH {MART_SQL}, grid AS ({_GRID_SQL}), {hac_sql("grid", "pair_id, horizon, period, predictor", "oy", "px", "horizon", max(HORIZONS), "month")}
SELECT pair_id, horizon, period, predictor, {r("coefficient")} AS slope, {r("coefficient - 1.959963984540054 * se")} AS ci_low,
  {r("coefficient + 1.959963984540054 * se")} AS ci_high, {rs("se, r2")}, n FROM hac""",
)
def slope_grid(spark, sf):
    m = mart(spark, sf).where(F.col("pctile_all_past").isNotNull()).select(
        "*", F.ln("ratio").alias("log_ratio"), (F.col("pctile_all_past") / 100).alias("pctile_all"),
        (F.col("pctile_trailing") / 100).alias("pctile_trail"),
    )
    outcomes = {h: f"ratio_fwd_{h}m_logchg" for h in HORIZONS}
    return rounded(R.slope_grid(m, list(_PREDS), outcomes, PERIODS[1:], ["pair_id"], with_p=False))


REFS = {"median since 1997": ("since", "1997-01-01"), "median since 1999": ("since", "1999-01-01"), "median of the last 24": ("last", 24)}


@query(
    "level_gap",
    "T22",
    f"""WITH {RATIO_SQL}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pair_id ORDER BY month DESC) AS back FROM ratio),
t AS (SELECT pair_id, arg_max(ratio, month) AS today FROM ratio GROUP BY pair_id),
m AS (SELECT pair_id, 'median since 1997' AS reference, median(ratio) AS rr FROM k WHERE month >= DATE '1997-01-01' GROUP BY pair_id
  UNION ALL SELECT pair_id, 'median since 1999', median(ratio) FROM k WHERE month >= DATE '1999-01-01' GROUP BY pair_id
  UNION ALL SELECT pair_id, 'median of the last 24', median(ratio) FROM k WHERE back <= 24 GROUP BY pair_id)
SELECT pair_id, reference, {r("rr")} AS reference_ratio, {r("today")} AS todays_ratio, {r("(rr / today - 1) * 100")} AS num_change_needed_pct,
  {r("(today / rr - 1) * 100")} AS den_change_needed_pct FROM m JOIN t USING (pair_id)""",
)
def level_gap(spark, sf):
    return rounded(T.level_gap(ratio(spark, sf), ["pair_id"], REFS))


@query(
    "bucket_stats",
    "G10",
    f"""WITH {RATIO_SQL} SELECT pair_id, CAST(floor(year(month) / 2.0) * 2 AS INTEGER) AS bucket, {r("MIN(ratio)")} AS lowest, {r("median(ratio)")} AS median, {r("MAX(ratio)")} AS highest
FROM ratio GROUP BY 1, 2""",
)
def bucket_stats(spark, sf):
    return rounded(TB.bucket_stats(ratio(spark, sf), ["pair_id"], "month", "ratio", 2))


@query(
    "rolling_mean",
    "W9",
    f"""WITH {RATIO_SQL} SELECT pair_id, month, {r("CASE WHEN COUNT(ratio) OVER w = 12 THEN AVG(ratio) OVER w END")} AS ratio_ma12
FROM ratio WINDOW w AS (PARTITION BY pair_id ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
)
def rolling_mean(spark, sf):
    return rounded(ratio(spark, sf).select("pair_id", "month", P.rolling_mean("ratio", 12, ["pair_id"]).alias("ratio_ma12")))


@query(
    "rules_table",
    "M6 M7",
    f"""WITH {MONTHS_SQL} SELECT rule_id, rule_type, threshold, label, horizon, COUNT(DISTINCT pair_id) AS pairs, COUNT(*) AS months, CAST(SUM(signal_on) AS BIGINT) AS months_on FROM valid GROUP BY ALL""",
)
def rules_table(spark, sf):
    """The numbered rules with how many pairs and months they could be judged on, and how many they were on."""
    from tidemark.queries.common import SIGNALS

    out = S.evaluate_rules(mart(spark, sf), RULES, SIGNALS, HORIZONS, ["pair_id"])
    return out.groupBy("rule_id", "rule_type", "threshold", "label", "horizon").agg(
        F.count_distinct("pair_id").alias("pairs"), F.count(F.lit(1)).alias("months"), F.sum(F.col("signal_on").cast("long")).alias("months_on")
    )
