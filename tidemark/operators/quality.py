"""Data-quality checks. Every check is a DataFrame of
table_name, description, status (PASS, WARN, FAIL, INFO), detail.

A check is one aggregation over the data it tests; only its few result rows leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import date_gaps, drop_incomplete_last, month_of, shift_join, window_of
from tidemark.operators.stats import corr
from tidemark.operators.tables import duplicates
from tidemark.session import cut_lineage

COLUMNS = ("table_name", "description", "status", "detail")


def _text(*parts: Column | str) -> Column:
    """Concatenate, with NULL parts shown as 'null'."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.concat(*cols)


def _fixed(c: Column, n: int = 2) -> Column:
    return F.format_string(f"%.{n}f", c.cast("double"))


def as_check(
    df: DataFrame, table: str, description: Column | str, ok: Column | None, detail: Column, otherwise: str = "FAIL"
) -> DataFrame:
    """Shape aggregated rows into check rows; ``ok`` None means information only."""
    desc = F.lit(description) if isinstance(description, str) else description
    status = F.lit("INFO") if ok is None else F.when(ok, "PASS").otherwise(otherwise)
    return df.select(F.lit(table).alias("table_name"), desc.alias("description"), status.alias("status"), detail.alias("detail"))


def check_unique(df: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    n = duplicates(df, keys).agg(F.count(F.lit(1)).alias("n"))
    return as_check(n, table, f"no duplicate ({', '.join(keys)})", F.col("n") == 0, _text(F.col("n"), " duplicated keys"))


def check_no_gaps(df: DataFrame, by: Sequence[str], table: str, month: str = "month") -> DataFrame:
    """Rows and distinct months against the months between first and last."""
    per_month = df.groupBy(*by, month).agg(F.count(F.lit(1)).alias("_n"))
    g = per_month.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("months"),
        (F.months_between(F.max(month), F.min(month)) + 1).cast("bigint").alias("expected"),
    )
    ok = (F.col("n") == F.col("expected")) & (F.col("months") == F.col("n"))
    name = _text(*[F.col(c) for c in by], ": no missing or duplicate months")
    return as_check(g, table, name, ok, _text(F.col("n"), " of ", F.col("expected"), " months"), "WARN")


def check_range(df: DataFrame, key: str, value: str, limits: Mapping[str, tuple[float, float]], table: str) -> DataFrame:
    """Values inside per-key limits (a literal table)."""
    cases = F.create_map(*[x for k, (a, z) in limits.items() for x in (F.lit(k), F.struct(F.lit(float(a)).alias("a"), F.lit(float(z)).alias("z")))])
    lim = F.try_element_at(cases, F.col(key))
    g = df.where(F.col(key).isin(list(limits))).groupBy(key).agg(
        F.count_if((F.col(value) < lim["a"]) | (F.col(value) > lim["z"])).alias("bad"),
        F.min(value).alias("lo"), F.max(value).alias("hi"),
    )
    detail = _text("min ", _fixed(F.col("lo")), ", max ", _fixed(F.col("hi")))
    return as_check(g, table, _text(F.col(key), ": values inside the plausible range"), F.col("bad") == 0, detail, "WARN")


def check_min_obs(daily: DataFrame, by: Sequence[str], at_least: int, table: str, date: str = "date") -> DataFrame:
    """Observations per complete month; the last month of each series is left out."""
    m = daily.groupBy(*by, month_of(date).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    g = drop_incomplete_last(m, by).agg(
        F.count(F.lit(1)).alias("months"), F.count_if(F.col("n") < at_least).alias("bad"),
        F.min("n").alias("lo"), F.max("n").alias("hi"),
    )
    detail = _text(F.col("months"), " complete months; fewest ", F.col("lo"), ", most ", F.col("hi"))
    return as_check(g, table, f"every complete month has at least {at_least} days with a value", F.col("bad") == 0, detail, "WARN")


def check_date_gaps(df: DataFrame, by: Sequence[str], max_days: int, table: str, date: str = "date") -> DataFrame:
    """How often consecutive dates lie further apart than allowed, per series."""
    g = date_gaps(df, by, date).groupBy(*by).agg(
        F.count_if(F.col("gap_days") > max_days).alias("bad"), F.max("gap_days").alias("longest")
    )
    detail = _text(F.col("bad"), " gaps; longest ", F.col("longest"), " days")
    return as_check(g, table, _text(*[F.col(c) for c in by], f": no gap above {max_days} days"), F.col("bad") == 0, detail, "WARN")


def check_coverage(df: DataFrame, cols: Sequence[str], table: str, month: str = "month") -> DataFrame:
    """Count, first and last month of each column, in one pass."""
    items = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).isNotNull().alias("has")) for c in cols])
    g = df.select(month, F.inline(items)).groupBy("c").agg(
        F.count_if("has").alias("n"), F.min(F.when(F.col("has"), F.col(month))).alias("a"), F.max(F.when(F.col("has"), F.col(month))).alias("z")
    )
    return as_check(g, table, _text(F.col("c"), ": months with a value"), None, _text(F.col("n"), " values; ", F.col("a"), " to ", F.col("z")))


def check_expected_nulls(df: DataFrame, col: str, expected: Sequence[str], table: str, month: str = "month") -> DataFrame:
    """Exactly the listed months are empty. Months are bounded by the calendar, so listing them is too."""
    missing = df.where(F.col(col).isNull()).select(F.date_format(month, "yyyy-MM-dd").alias("m")).distinct()
    g = missing.agg(F.coalesce(F.expr("listagg(m, ', ') within group (order by m)"), F.lit("none")).alias("m"))
    want = ", ".join(sorted(expected)) or "none"
    return as_check(g, table, f"{col} is empty in exactly the known months", F.col("m") == want, F.col("m"))


def check_identity(df: DataFrame, violated: Column, table: str, description: str) -> DataFrame:
    """Number of rows that break a recomputed identity; a NULL comparison is not a violation."""
    g = df.agg(F.count_if(violated).alias("bad"), F.count(F.lit(1)).alias("n"))
    return as_check(g, table, description, F.col("bad") == 0, _text(F.col("bad"), " violations in ", F.col("n"), " rows"))


def check_equal(a: DataFrame, b: DataFrame, on: Sequence[str], cols: Sequence[str], tol: float, table: str) -> DataFrame:
    """Shared columns of two tables agree on every common key; keys on one side only are counted."""
    left = a.select(*on, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_in_a"))
    right = b.select(*on, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("_in_b"))
    differ = F.lit(False)
    for c in cols:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        differ = differ | F.coalesce(F.abs(x - y) > tol, x.isNull() != y.isNull())
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    g = left.join(right, list(on), "full_outer").agg(
        F.count_if(both).alias("n"), F.count_if(both & differ).alias("bad"), F.count_if(~both).alias("lone")
    )
    detail = _text(F.col("bad"), " of ", F.col("n"), " rows differ; ", F.col("lone"), " on one side only")
    return as_check(g, table, "both tables agree on every key", (F.col("bad") == 0) & (F.col("lone") == 0), detail)


def check_parts_total(df: DataFrame, by: Sequence[str], is_total: Column, value: str, tol_pct: float, table: str) -> DataFrame:
    """Parts add up to the published total of their group within a percentage."""
    g = df.groupBy(*by).agg(
        F.sum(F.when(~is_total, F.col(value))).alias("parts"), F.max(F.when(is_total, F.col(value))).alias("total")
    ).withColumn("gap", F.try_divide(F.abs(F.col("parts") - F.col("total")) * 100, "total"))
    detail = _text("sum ", _fixed(F.col("parts")), " vs total ", _fixed(F.col("total")), " (", _fixed(F.col("gap")), "% apart)")
    name = _text(*[F.col(c) for c in by], f": parts add up to the total ({tol_pct:g}% tolerance)")
    return as_check(g, table, name, F.col("gap") < tol_pct, detail, "WARN")


def agreement(a: DataFrame, b: DataFrame, on: Sequence[str], by: Sequence[str], x: str, y: str) -> DataFrame:
    """Overlap, correlation, mean and largest gap in percent of b."""
    j = a.select(*on, F.col(x).alias("_x")).join(b.select(*on, F.col(y).alias("_y")), list(on)).dropna(subset=["_x", "_y"])
    gap = F.try_divide(F.abs(F.col("_x") - F.col("_y")) * 100, "_y")
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("months"), corr("_x", "_y").alias("r"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap")
    )


def check_agreement(a: DataFrame, b: DataFrame, on: Sequence[str], by: Sequence[str], x: str, y: str, tol_pct: float, table: str) -> DataFrame:
    g = agreement(a, b, on, by, x, y)
    detail = _text(F.col("months"), " overlapping months; correlation ", _fixed(F.col("r"), 4), "; mean gap ", _fixed(F.col("mean_gap")), "%; max gap ", _fixed(F.col("max_gap")), "%")
    return as_check(g, table, _text(*[F.col(c) for c in by], ": two sources agree"), F.col("mean_gap") < tol_pct, detail, "WARN")


def check_converted(a: DataFrame, b: DataFrame, on: Sequence[str], x: str, y: str, factor: float, tol_pct: float, table: str) -> DataFrame:
    """One source converted to the unit of the other; the worst difference decides."""
    j = a.select(*on, (F.col(x) * factor).alias("_x")).join(b.select(*on, F.col(y).alias("_y")), list(on))
    g = j.agg(F.max(F.try_divide(F.abs(F.col("_x") - F.col("_y")) * 100, "_y")).alias("worst"), F.count(F.lit(1)).alias("n"))
    return as_check(g, table, "converted values agree", F.col("worst") < tol_pct, _text(F.col("n"), " periods; worst ", _fixed(F.col("worst")), "% apart"), "WARN")


def check_revisions(a: DataFrame, b: DataFrame, on: str, value: str, above_pct: float, table: str) -> DataFrame:
    """One information row per entity whose later figure differs by more than a percentage."""
    j = a.select(on, F.col(value).alias("_a")).join(b.select(on, F.col(value).alias("_b")), on)
    rev = F.try_divide((F.col("_b") - F.col("_a")) * 100, "_a")
    big = j.where(F.abs(rev) > above_pct)
    return as_check(big, table, _text(F.col(on), f": revised by more than {above_pct:g}%"), None, _text(_fixed(rev, 1), "%"))


def check_readings(readings: DataFrame, table_df: DataFrame, on: Sequence[str], tol_pct: float, table: str) -> DataFrame:
    """Figures read elsewhere (column reading) match the table (column value)."""
    j = readings.join(table_df, list(on))
    off = F.try_divide(F.abs(F.col("value") - F.col("reading")) * 100, F.abs("reading")) > tol_pct
    g = j.agg(F.count_if(off).alias("bad"), F.count(F.lit(1)).alias("n"))
    return as_check(g, table, f"readings match the table ({tol_pct:g}% tolerance)", F.col("bad") == 0, _text(F.col("bad"), " of ", F.col("n"), " readings differ"), "WARN")


def check_basis(df: DataFrame, entity: str, is_used: Column, value: str, above_pct: float, table: str) -> DataFrame:
    """Two figures of one entity (used and other) far apart suggest different bases."""
    p = df.groupBy(entity).agg(F.max(F.when(is_used, F.col(value))).alias("u"), F.max(F.when(~is_used, F.col(value))).alias("o")).dropna()
    change = F.try_divide((F.col("u") - F.col("o")) * 100, "o")
    g = p.agg(F.count_if(F.abs(change) > above_pct).alias("bad"), F.count(F.lit(1)).alias("n"))
    return as_check(g, table, f"two figures of one entity within {above_pct:g}%", F.col("bad") == 0, _text(F.col("bad"), " of ", F.col("n"), " entities differ"), "WARN")


def profile(df: DataFrame, text: Sequence[str], numbers: Sequence[str], groups: Sequence[Sequence[str]], value: str) -> DataFrame:
    """Column and group profile in one scan: rows, values, distinct values, sum, min, max.

    Each row is expanded to its profile entries and reduced per distinct value before
    the final step, so distinct counts are exact and no entry meets a single task.
    """
    def entry(grouping, key, ident, num, txt, present):
        return F.struct(
            F.lit(grouping).alias("grouping"), key.alias("key_value"), ident.cast("string").alias("ident"),
            num.cast("double").alias("num"), txt.cast("string").alias("txt"), present.alias("present"),
        )

    none = F.lit(None)
    items = [entry(f"column:{c}", F.lit("ALL"), F.col(c), none, F.col(c), F.col(c).isNotNull()) for c in text]
    items += [entry(f"column:{c}", F.lit("ALL"), F.col(c), F.col(c), none, F.col(c).isNotNull()) for c in numbers]
    for cols in groups:
        key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
        items.append(entry("group:" + "|".join(cols), key, none, F.col(value), none, F.col(value).isNotNull()))
    g = ["grouping", "key_value"]
    reduced = df.select(F.inline(F.array(*items))).groupBy(*g, "ident").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("present").alias("v"), F.sum("num").alias("s"), F.min("num").alias("lo"),
        F.max("num").alias("hi"), F.min("txt").alias("lt"), F.max("txt").alias("ht"),
    )
    is_group = F.col("grouping").startswith("group:")
    return reduced.groupBy(*g).agg(
        F.sum("n").alias("n_rows"), F.sum("v").alias("n_values"), F.count("ident").alias("_d"), F.sum("s").alias("sum_value"),
        F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.min("lt").alias("min_text"), F.max("ht").alias("max_text"),
    ).select(
        *g, "n_rows", "n_values", F.when(~is_group, F.col("_d")).alias("n_distinct"), "sum_value",
        F.when(~is_group, F.col("_lo")).alias("min_num"), F.when(~is_group, F.col("_hi")).alias("max_num"), "min_text", "max_text",
    )


def diff_profile(now: DataFrame, frozen: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Profile entries that differ or exist on one side only (NULL equals NULL)."""
    g = ["grouping", "key_value"]
    rest = [c for c in now.columns if c not in g]
    a = now.select(*g, *[F.col(c).alias(f"a_{c}") for c in rest], F.lit(1).alias("_a"))
    b = frozen.select(*g, *[F.col(c).alias(f"b_{c}") for c in rest], F.lit(1).alias("_b"))
    differ = F.lit(False)
    for c in rest:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        differ = differ | (F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))) > tol if c == "sum_value" else ~x.eqNullSafe(y))
    kind = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "missing").when(differ, "changed")
    return a.join(b, g, "full_outer").select(*g, kind.alias("difference")).where(F.col("difference").isNotNull())


def check_profile(now: DataFrame, frozen: DataFrame, table: str) -> DataFrame:
    g = diff_profile(now, frozen).agg(F.count(F.lit(1)).alias("n"))
    return as_check(g, table, "profile matches the frozen baseline", F.col("n") == 0, _text(F.col("n"), " summaries differ"))


def check_complete_grid(df: DataFrame, keys: Sequence[str], n: int, table: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("cases"))
    return as_check(g, table, f"{n} cases, each once", (F.col("n_rows") == n) & (F.col("cases") == n), _text(F.col("n_rows"), " rows; ", F.col("cases"), " cases"))


def check_ordered(df: DataFrame, low: str, mid: str, high: str, table: str) -> DataFrame:
    bad = (F.col(low) > F.col(mid)) | (F.col(mid) > F.col(high))
    return check_identity(df, bad, table, f"{low} <= {mid} <= {high}")


def check_implies(df: DataFrame, cond: Column, implied: Column, table: str, description: str) -> DataFrame:
    return check_identity(df, cond & ~F.coalesce(implied, F.lit(False)), table, description)


def check_mapping(df: DataFrame, mapping: DataFrame, on: str, table: str) -> DataFrame:
    """Every name has an entry in the mapping."""
    missing = df.select(on).distinct().join(mapping.select(on), on, "left_anti")
    g = missing.agg(F.count(F.lit(1)).alias("n"))
    return as_check(g, table, f"every {on} has a mapping", F.col("n") == 0, _text(F.col("n"), " without a mapping"))


def check_pattern(df: DataFrame, col: str, pattern: str, table: str, nullable: bool = False) -> DataFrame:
    good = F.coalesce(F.col(col).rlike(pattern), F.lit(nullable))
    return check_identity(df, ~good, table, f"{col} is well formed")


def check_fk(df: DataFrame, register: DataFrame, col: str, table: str) -> DataFrame:
    """Every id is in the register and none is missing."""
    ids = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    known = register.select(F.col(col)).distinct().withColumn("_known", F.lit(1))
    g = ids.join(known, col, "left").agg(
        F.count_if(F.col(col).isNotNull() & F.col("_known").isNull()).alias("unknown"),
        F.coalesce(F.sum(F.when(F.col(col).isNull(), F.col("n"))), F.lit(0)).alias("empty"),
    )
    ok = (F.col("unknown") == 0) & (F.col("empty") == 0)
    return as_check(g, table, f"every {col} exists in the register", ok, _text(F.col("unknown"), " unknown ids; ", F.col("empty"), " rows without one"))


def unused_ids(register: DataFrame, tables: Sequence[DataFrame], col: str) -> DataFrame:
    """Register ids no table uses; each table is reduced to its ids first."""
    used = reduce(lambda a, b: a.unionByName(b), [t.select(col).distinct() for t in tables]).distinct()
    return register.select(col).distinct().join(used, col, "left_anti")


def check_episode(months: DataFrame, by: Sequence[str], order: str, table: str) -> DataFrame:
    """Gaps inside an episode are at most the horizon, between episodes more; id exactly when on."""
    w = window_of(by, order)
    on = months.where(F.col("signal_on") == 1).withColumn("_gap", F.col(order) - F.lag(order).over(w))
    start = F.col("is_episode_start") == 1
    wrong_gap = F.col("_gap").isNotNull() & ((~start & (F.col("_gap") > F.col("horizon"))) | (start & (F.col("_gap") <= F.col("horizon"))))
    gaps = on.agg(F.count_if(wrong_gap).alias("n")).withColumn("d", F.lit("episode gaps"))
    ids = months.agg(F.count_if((F.col("signal_on") == 1) != F.col("episode_id").isNotNull()).alias("n")).withColumn("d", F.lit("id exactly when on"))
    return as_check(gaps.unionByName(ids), table, F.col("d"), F.col("n") == 0, _text(F.col("n"), " violations"))


def check_percentile(df: DataFrame, by: Sequence[str], value: str, pctile: str, warmup: int, table: str, order: str = "month") -> DataFrame:
    """Empty during the warm-up, 0-100 after it, 100 at a new high and 0 at a new low."""
    w = window_of(by, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = df.select(
        F.col(pctile).alias("p"), F.col(value).alias("v"), F.row_number().over(w).alias("n"),
        F.max(value).over(before).alias("hi"), F.min(value).over(before).alias("lo"),
    )
    p = F.col("p")
    g = d.agg(
        F.count_if((F.col("n") <= warmup) & p.isNotNull()).alias("early"), F.count_if((F.col("n") > warmup) & p.isNull()).alias("missing"),
        F.count_if((p < 0) | (p > 100)).alias("outside"), F.count_if((F.col("v") > F.col("hi")) & (p != 100)).alias("high"),
        F.count_if((F.col("v") < F.col("lo")) & (p != 0)).alias("low"),
    )
    total = F.col("early") + F.col("missing") + F.col("outside") + F.col("high") + F.col("low")
    return as_check(g, table, "percentile bounds, warm-up, new highs and lows", total == 0, _text(total, " violations"))


def check_same_sample(months: DataFrame, horizon: str, rule: str, by: Sequence[str], table: str) -> DataFrame:
    """Every rule uses the same number of months at each horizon, per key."""
    per = months.groupBy(*by, horizon, rule).agg(F.count(F.lit(1)).alias("n")).groupBy(*by, horizon).agg(F.min("n").alias("a"), F.max("n").alias("z"))
    g = per.groupBy(horizon).agg(F.count_if(F.col("a") != F.col("z")).alias("bad"), F.count(F.lit(1)).alias("n"))
    return as_check(g, table, _text(F.col(horizon), "m: common sample across rules"), F.col("bad") == 0, _text(F.col("bad"), " of ", F.col("n"), " keys differ"))


def check_forward(df: DataFrame, by: Sequence[str], value: str, fwd_pct: str, months: int, tol: float, table: str) -> DataFrame:
    """A forward column equals the change against the calendar month ``months`` later."""
    again = (F.try_divide("_later", value) - 1) * 100
    j = shift_join(df, by, value, months, "_later", [fwd_pct]).where(F.col("_later").isNotNull())
    return check_identity(j, F.abs(again - F.col(fwd_pct)) > tol, table, f"{fwd_pct} matches the self join")


def check_figures(rows: DataFrame) -> DataFrame:
    """Expected against computed: figure_id, expected, computed, tolerance, expected_text, computed_text."""
    number = F.abs(F.col("computed") - F.col("expected")) <= F.col("tolerance")
    text = F.col("computed_text") == F.col("expected_text")
    ok = F.coalesce(F.when(F.col("expected_text").isNotNull(), text).otherwise(number), F.lit(False))
    return rows.select("*", F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def stop_on_failure(checks: DataFrame) -> None:
    """Raise on the first failed row (an action on check rows only)."""
    failed = checks.where(F.col("status") == "FAIL").limit(1).collect()
    if failed:
        raise ValueError(f"check failed: {failed[0].asDict()}")


def issues_to_checks(issues: DataFrame) -> DataFrame:
    """Known-issue register as check rows: unresolved is WARN, a limitation INFO."""
    return issues.select(
        "table_name",
        _text("known issue ", F.col("issue_id"), " (", F.col("status"), "): ", F.col("description")).alias("description"),
        F.when(F.col("status") == "unresolved", "WARN").otherwise("INFO").alias("status"),
        _text("source ", F.col("source_id"), "; ", F.col("note")).alias("detail"),
    )


def check_rejects(raw: DataFrame, ok: Column, table: str) -> DataFrame:
    g = raw.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad"), F.count(F.lit(1)).alias("n"))
    share = F.try_divide(F.col("bad") * 100.0, "n")
    return as_check(g, table, "raw rows dropped in cleaning", None, _text(F.col("bad"), " of ", F.col("n"), " raw rows (", _fixed(share), "%)"))


def check_reconcile(df: DataFrame, by: Sequence[str], parts: Sequence[str], total: str, shares: Mapping[str, tuple[str, str]], table: str) -> DataFrame:
    """Counts add up to their total and every share equals its counts."""
    s = reduce(lambda a, b: a + b, [F.col(c) for c in parts])
    bad = s != F.col(total)
    for share, (k, n) in shares.items():
        bad = bad | F.coalesce(F.abs(F.col(share) - F.try_divide(F.col(k) * 100.0, n)) > 0.005, F.lit(False))
    return check_identity(df, bad, table, f"{' + '.join(parts)} = {total}, shares equal their counts")


def samples(tables: Mapping[str, DataFrame], by: Sequence[str], month: str = "month") -> DataFrame:
    """First month, last month and rows of each result table."""
    parts = [
        t.groupBy(*by).agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"), F.count(F.lit(1)).alias("n")).withColumn("result", F.lit(name))
        for name, t in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def check_samples(tables: Mapping[str, DataFrame], by: Sequence[str], table: str) -> DataFrame:
    """All result tables of a key cover the same months."""
    s = samples(tables, by).groupBy(*by).agg(
        F.min("first_month").alias("a1"), F.max("first_month").alias("a2"), F.min("last_month").alias("z1"), F.max("last_month").alias("z2"),
        F.min("n").alias("n1"), F.max("n").alias("n2"), F.count(F.lit(1)).alias("k"),
    )
    bad = (F.col("a1") != F.col("a2")) | (F.col("z1") != F.col("z2")) | (F.col("n1") != F.col("n2")) | (F.col("k") != len(tables))
    return check_identity(s, bad, table, "result tables share one sample")


def status_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def compare_results(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], tol: float) -> DataFrame:
    """Two implementations side by side: keys compared, missing, and differing per column."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def off(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return both & F.coalesce(F.abs(x - y) > tol, x.isNull() != y.isNull())

    wide = left.join(right, list(keys), "full_outer").agg(
        F.count_if(both).alias("compared"), F.count_if(~both).alias("one_side_only"), *[F.count_if(off(c)).alias(f"_{c}") for c in cols]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("differ")) for c in cols])
    return wide.select("compared", "one_side_only", F.inline(rows))


def check_period_end(df: DataFrame, month: str, last_day: str, from_day: int, table: str) -> DataFrame:
    """The period-end date lies in its own month, on or after a day of the month."""
    bad = (month_of(last_day) != F.col(month)) | (F.dayofmonth(last_day) < from_day)
    return check_identity(df, bad, table, f"month-end date in its month, day {from_day} or later")


def catalog(tables: Mapping[str, DataFrame], meta: DataFrame, dates: Mapping[str, str]) -> DataFrame:
    """Rows and date range per table beside kind, description and publishing note."""
    none = F.lit(None).cast("date")
    parts = []
    for name, t in tables.items():
        d = F.col(dates[name]).cast("date") if name in dates else none
        parts.append(t.agg(F.count(F.lit(1)).alias("n_rows"), F.min(d).alias("date_from"), F.max(d).alias("date_to")).withColumn("table_name", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts).join(meta, "table_name", "left")


def run_checks(
    spark: SparkSession, checks: Sequence[tuple[str, Sequence[str], DataFrame | Callable[[], DataFrame] | None]], present: Collection[str], run_date: str
) -> DataFrame:
    """Number and date the checks: (title, required tables, check rows or what builds them).

    present: what ``sources.store.available`` found. A check may require a table, or that it has rows (``<name>_data``); if something is missing the
    check is not built and becomes one INFO row that says so.
    """
    out = []
    for i, (title, requires, df) in enumerate(checks, 1):
        missing = [t for t in requires if t not in present]
        if missing or df is None:
            row = ("optional checks", f"skipped: {title}", "INFO", f"needs {', '.join(missing)}, which is not present")
            df = spark.createDataFrame([row], ", ".join(f"{c} string" for c in COLUMNS))
        elif not isinstance(df, DataFrame):
            df = df()
        out.append(df.select(F.lit(i).alias("block_no"), *COLUMNS))
    # The few check rows are stored: numbering needs them twice, the checks run once.
    rows = cut_lineage(reduce(lambda a, b: a.unionByName(b), out))
    # Numbers run on from block to block: each check is numbered on its own, the
    # offsets come from one small row per check.
    inside = Window.partitionBy("block_no").orderBy("table_name", "description")
    earlier = Window.orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("block_no").agg(F.count(F.lit(1)).alias("_n")).select(
        "block_no", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    number = (F.row_number().over(inside) + F.col("_before")).cast("int")
    return rows.join(F.broadcast(offsets), "block_no").select(
        number.alias("check_no"), *COLUMNS, F.lit(run_date).alias("run_date")
    )
