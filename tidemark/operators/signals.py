"""Rules on a ratio, the episodes they form, and what followed them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import forward_changes
from tidemark.operators.percentile import past_percentile, trailing_percentile
from tidemark.operators.regression import ols_hac
from tidemark.operators.scan import BLOCK_ROWS, block_ids, running_max
from tidemark.operators.stats import geo_mean_pct, wilson_ci
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """Fires when the signal named by ``rule_type`` is at or above ``threshold``."""

    rule_type: str
    threshold: float


def ratio_mart(
    ratio: DataFrame, by: Sequence[str], warmup: int, lookback: int, horizons: Sequence[int]
) -> DataFrame:
    """Ratio with its past percentiles and the forward changes of ratio and legs."""
    marked = ratio.select(
        "*",
        past_percentile("ratio", by, warmup).alias("pctile_all_past"),
        trailing_percentile("ratio", by, lookback, warmup).alias("pctile_trailing"),
    )
    return forward_changes(marked, ["ratio", "num_value", "den_value"], horizons, by)


def numbered_rules(rules: Sequence[Rule], families: Sequence[str]) -> list[tuple[int, Rule, str]]:
    """Rules in family order then by threshold, with ids from 1 and a label."""
    ordered = sorted(rules, key=lambda r: (families.index(r.rule_type), r.threshold))
    return [(i, r, f"{r.rule_type} at or above {r.threshold:g}") for i, r in enumerate(ordered, 1)]


def rules_column(rules: Sequence[tuple[int, Rule, str]]) -> Column:
    """The rules as one array literal, to be exploded next to each row."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("rule_id"),
                F.lit(r.rule_type).alias("rule_type"),
                F.lit(float(r.threshold)).alias("threshold"),
                F.lit(label).alias("label"),
            )
            for i, r, label in rules
        ]
    )


def evaluate_rules(
    mart: DataFrame,
    rules: Sequence[tuple[int, Rule, str]],
    signals: Mapping[str, str],
    horizons: Sequence[int],
    by: Sequence[str],
    order: str = "month",
) -> DataFrame:
    """One row per key, month, rule and horizon on the common sample.

    The common sample has a percentile (so every rule could fire) and a known
    outcome. Rules and horizons are literals, so this is a row expansion, not a
    join. ``_n`` numbers the months of a key.
    """
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    value = F.coalesce(*[F.when(F.col("_r.rule_type") == t, F.col(c)) for t, c in signals.items()])
    outcomes = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                F.col(f"ratio_fwd_{h}m_logchg").alias("fwd_ratio"),
                F.col(f"num_value_fwd_{h}m_logchg").alias("fwd_num"),
                F.col(f"den_value_fwd_{h}m_logchg").alias("fwd_den"),
            )
            for h in horizons
        ]
    )
    return (
        mart.withColumn("_n", n)
        .where(F.col("pctile_all_past").isNotNull())
        .withColumn("_h", F.explode(outcomes))
        .where(F.col("_h.fwd_ratio").isNotNull())
        .withColumn("_r", F.explode(rules_column(rules)))
        .select(*by, order, "_n", "_r.*", "_h.*", value.alias("signal_value"))
        .where(F.col("signal_value").isNotNull())
        .withColumn("signal_on", (F.col("signal_value") >= F.col("threshold")).cast("int"))
    )


def episodes(df: DataFrame, keys: Sequence[str], order: str, gap: Column, on: str = "signal_on") -> DataFrame:
    """Group signal-on rows: a new episode when the distance to the last one exceeds ``gap``.

    Rows that are off keep a NULL id. The previous on-row is found with a running
    last, so on and off rows share one window and nothing is joined back.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    is_on = F.col(on) == 1
    previous = F.last(F.when(is_on, F.col(order)), ignorenulls=True).over(before)
    start = (is_on & (previous.isNull() | (F.col(order) - previous > gap))).cast("int")
    d = df.withColumn("is_episode_start", start)
    running = F.sum("is_episode_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("episode_id", F.when(is_on, running))


def signal_months(
    mart: DataFrame,
    rules: Sequence[tuple[int, Rule, str]],
    signals: Mapping[str, str],
    horizons: Sequence[int],
    by: Sequence[str],
) -> DataFrame:
    months = evaluate_rules(mart, rules, signals, horizons, by)
    return episodes(months, [*by, "rule_id", "horizon"], "_n", F.col("horizon"))


def summarize_signal(months: DataFrame, by: Sequence[str]) -> DataFrame:
    """On against off for each key: counts, averages, falling shares, episode starts."""
    on, off = F.col("signal_on") == 1, F.col("signal_on") == 0
    start = F.col("is_episode_start") == 1
    fwd = F.col("fwd_ratio")

    def falling(cond: Column) -> Column:
        return F.avg(F.when(cond, (fwd < 0).cast("double"))) * 100

    out = months.groupBy(*by).agg(
        F.count_if(on).alias("months_on"),
        F.count_if(off).alias("months_off"),
        F.try_divide(F.count_if(on) * 100.0, F.count(F.lit(1))).alias("share_on_pct"),
        F.sum("is_episode_start").cast("bigint").alias("episodes"),
        geo_mean_pct(fwd).alias("avg_ratio_change_all_pct"),
        geo_mean_pct(F.when(on, fwd)).alias("avg_ratio_change_on_pct"),
        geo_mean_pct(F.when(off, fwd)).alias("avg_ratio_change_off_pct"),
        falling(on).alias("falling_share_on_pct"),
        falling(off).alias("falling_share_off_pct"),
        geo_mean_pct(F.when(on, F.col("fwd_num"))).alias("avg_num_change_on_pct"),
        geo_mean_pct(F.when(on, F.col("fwd_den"))).alias("avg_den_change_on_pct"),
        geo_mean_pct(F.when(start, fwd)).alias("episode_avg_change_pct"),
        F.count_if(start & (fwd < 0)).alias("episodes_falling"),
    )
    low, high = wilson_ci(F.col("episodes_falling"), F.col("episodes"))
    return out.select("*", low.alias("falling_ci_low_pct"), high.alias("falling_ci_high_pct"))


def signal_difference(months: DataFrame, by: Sequence[str], max_horizon: int, with_p: bool = True) -> DataFrame:
    """On-minus-off difference in log points: OLS on the 0/1 signal, HAC lags = horizon.

    ``by`` must contain horizon. No row for a key with fewer than two months on either side.
    """
    w = Window.partitionBy(*by)
    on = F.col("signal_on")
    enough = months.select(
        *by, "_n", "fwd_ratio", on.cast("double").alias("on"),
        F.sum(on).over(w).alias("_on"), F.count(F.lit(1)).over(w).alias("_all"),
    ).where((F.col("_on") >= 2) & (F.col("_all") - F.col("_on") >= 2))
    fit = ols_hac(enough, "fwd_ratio", ["on"], by, "horizon", "_n", max_lags=max_horizon, with_p=with_p)
    cols = [
        (F.col("coefficient") * 100).alias("diff_logpts"),
        (F.col("ci_low") * 100).alias("diff_ci_low"),
        (F.col("ci_high") * 100).alias("diff_ci_high"),
    ]
    return fit.select(*by, "n", *cols, *([F.col("p").alias("p_hac")] if with_p else []))


def holm(df: DataFrame, p: str, alias: str = "p_holm", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Holm step-down adjustment over all tests in the table (NULL p stays NULL).

    Equal p-values share the largest multiplier of their run, so the work is on
    distinct p-values; ranks and the running maximum go block by block, so no
    task sees the whole family of tests. The test table (one row per test) is read
    several times, so it is written out once first.
    """
    df = cut_lineage(df)
    tests = df.where(F.col(p).isNotNull())
    distinct = block_ids(tests.groupBy(p).agg(F.count(F.lit(1)).alias("_ties")), [], p, block_rows)
    inside = Window.partitionBy("_b").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    # One row a block: its number of tests.
    blocks = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_block = distinct.groupBy("_b").agg(F.sum("_ties").alias("_t")).select(
        "_b",
        F.coalesce(F.sum("_t").over(blocks), F.lit(0)).alias("_before"),
        F.sum("_t").over(Window.partitionBy(F.lit(1))).alias("_m"),
    )
    stepped = (
        distinct.withColumn("_earlier", F.coalesce(F.sum("_ties").over(inside), F.lit(0)))
        .join(F.broadcast(per_block), "_b")
        .select(p, ((F.col("_m") - F.col("_before") - F.col("_earlier")) * F.col(p)).alias("_step"))
    )
    adjusted = running_max(stepped, [], p, "_step", "_adj", block_rows).select(
        p, F.least(F.lit(1.0), F.col("_adj")).alias(alias)
    )
    return df.join(adjusted, p, "left")


def episode_table(months: DataFrame, by: Sequence[str], order: str = "month") -> DataFrame:
    """One row per episode: span, months on, and the changes after its first month."""
    start = F.col("is_episode_start") == 1

    def after(c: str) -> Column:
        return (F.exp(F.max(F.when(start, F.col(c)))) - 1) * 100

    return (
        months.where(F.col("signal_on") == 1)
        .groupBy(*by, "episode_id")
        .agg(
            F.min(order).alias("first_month"),
            F.max(order).alias("last_month_on"),
            F.count(F.lit(1)).alias("months_on"),
            after("fwd_ratio").alias("ratio_change_pct"),
            after("fwd_num").alias("num_change_pct"),
            after("fwd_den").alias("den_change_pct"),
        )
    )


def test_verdicts(tests: DataFrame, by: Sequence[str], diff: str, low: str, high: str, p: str, holm_p: str) -> DataFrame:
    """How many tests are negative, exclude zero, and survive the adjustment."""
    return tests.groupBy(*by).agg(
        F.count(diff).alias("tests"),
        F.count_if(F.col(diff) < 0).alias("negative"),
        F.count_if((F.col(low) > 0) | (F.col(high) < 0)).alias("interval_excludes_zero"),
        F.count_if(F.col(p) < 0.05).alias("raw_below_5pct"),
        F.count_if(F.col(holm_p) < 0.05).alias("holm_below_5pct"),
    )
