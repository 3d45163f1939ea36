"""Scenario arithmetic: input ranges, interpolation, case grids, ranges and sensitivity.

Case dimensions are literals (low / mid / high and the like), so a grid is an
expansion of each base row. No cross join is planned and nothing is shuffled to
build a grid; only the later aggregations move data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tables import expand_structs, inline_rows


def input_register(df: DataFrame, key: str, low: str, high: str, unit: str, source: str) -> DataFrame:
    """low, mid, high per input; mid is the middle of the range, not a best estimate."""
    return df.select(
        F.col(key).alias("input_id"),
        F.lit(unit).alias("unit"),
        F.col(low).alias("low"),
        ((F.col(low) + F.col(high)) / 2).alias("mid"),
        F.col(high).alias("high"),
        F.lit(source).alias("source_id"),
    )


def interpolate(
    ends: DataFrame, by: Sequence[str], cols: Sequence[str], start: int, end: int, target: int, year: str = "year", with_start: bool = False
) -> DataFrame:
    """Values at ``target`` between two anchor years, linear and constant growth.

    The anchor rows stay, tagged 'direct'; a key with one anchor keeps only that row.
    Band ends are interpolated like values. With ``with_start`` each row also carries the
    values of the start year as start_<column>. One aggregation serves all rows.
    """
    w = (target - start) / (end - start)
    wide = ends.where(F.col(year).isin(start, end)).groupBy(*by).agg(
        *[F.max(F.when(F.col(year) == start, F.col(c))).alias(f"_a_{c}") for c in cols],
        *[F.max(F.when(F.col(year) == end, F.col(c))).alias(f"_z_{c}") for c in cols],
        F.max((F.col(year) == start).cast("int")).alias("_has_a"),
        F.max((F.col(year) == end).cast("int")).alias("_has_z"),
    )

    def row(name: str, at: int, between: int, ok: Column, value) -> Column:
        return F.struct(
            F.lit(name).alias("path_method"), F.lit(at).alias(year), F.lit(between).alias("is_interpolated"),
            ok.alias("_ok"), *[value(F.col(f"_a_{c}"), F.col(f"_z_{c}")).cast("double").alias(c) for c in cols],
        )

    has_a, has_z = F.col("_has_a") == 1, F.col("_has_z") == 1
    rows = F.array(
        row("direct", start, 0, has_a, lambda a, z: a),
        row("direct", end, 0, has_z, lambda a, z: z),
        row("linear", target, 1, has_a & has_z, lambda a, z: a + w * (z - a)),
        row("constant_growth", target, 1, has_a & has_z, lambda a, z: a * F.pow(F.try_divide(z, a), F.lit(w))),
    )
    carried = [F.col(f"_a_{c}").alias(f"start_{c}") for c in cols] if with_start else []
    return wide.select(*by, *carried, F.inline(rows)).where("_ok").drop("_ok")


def derived_total(value: Column, share_pct: Column) -> Column:
    """Total behind a value that is ``share_pct`` percent of it."""
    return F.try_divide(value, share_pct / 100.0)


def derived_total_band(df: DataFrame, v: str, lo: str, hi: str, s: str, s_lo: str, s_hi: str, prefix: str = "") -> DataFrame:
    """Central total and its extreme band: smallest value over largest share, and the reverse."""
    def c(name: str) -> Column:
        return F.col(prefix + name)

    return df.select(
        "*",
        derived_total(c(v), c(s)).alias(f"{prefix}total_central"),
        derived_total(c(lo), c(s_hi)).alias(f"{prefix}total_min"),
        derived_total(c(hi), c(s_lo)).alias(f"{prefix}total_max"),
    )


def case(key: str, name: str, value: str, amount: Column | float) -> Column:
    """One case of a dimension: its name and its amount."""
    amount = F.lit(float(amount)) if isinstance(amount, (int, float)) else amount
    return F.struct(F.lit(name).alias(key), amount.cast("double").alias(value))


def case_grid(base: DataFrame, *dims: Sequence[Column]) -> DataFrame:
    """Every combination of the cases for each base row."""
    return expand_structs(base, *dims)


def growth_delta(growth_case: Column, target: Mapping[str, Column], base: Mapping[str, Column]) -> Column:
    """Change of a total by rounding case: min pairs the lowest target with the highest base."""
    return (
        F.when(growth_case == "central", target["central"] - base["central"])
        .when(growth_case == "min", target["min"] - base["max"])
        .otherwise(target["max"] - base["min"])
    )


def displacement_terms(
    extra: Sequence[tuple[Column, Column]], old_unit: Column, delta_total: Column, per: float = 1000.0
) -> dict[str, Column]:
    """Replacing old units by new ones: extra * (new - old) summed, and growth * old."""
    transition = sum((n * (unit - old_unit) for n, unit in extra), F.lit(0.0)) / per
    growth = delta_total * old_unit / per
    return {"transition": transition, "market_growth": growth, "combined": transition + growth}


def build_path(df: DataFrame, total: str, years: str, growth: Column) -> DataFrame:
    """Yearly build that adds up to ``total``: the same every year, or growing at a fixed rate."""
    n, t = F.col(years), F.col(total)
    rate = F.pow(1 + growth, n)
    first = F.try_divide(t, F.try_divide(rate - 1, growth))
    paths = F.array(
        F.struct(F.lit("even").alias("path"), F.try_divide(t, n).alias("first_year"), F.try_divide(t, n).alias("target_year")),
        F.struct(
            F.lit("constant_growth").alias("path"), first.alias("first_year"),
            (first * F.pow(1 + growth, n - 1)).alias("target_year"),
        ),
    )
    return df.select("*", F.inline(paths))


BELOW_BASE = "below_base"


def build_cases(path: DataFrame, intensities: Sequence[Column], bases: Sequence[Column]) -> DataFrame:
    """Path x intensity x base-year build; a build below the base year's carries a code as note."""
    d = expand_structs(path, intensities, bases)
    build, base, per = F.col("target_year"), F.col("base_build"), F.col("intensity")
    return d.select(
        "*",
        (build * per).alias("new_amount"),
        (base * per).alias("base_amount"),
        ((build - base) * per).alias("extra"),
        F.when(build < base, BELOW_BASE).alias("note"),
    )


def headline(grid: DataFrame, by: Sequence[str], low: Column, mid: Column, high: Column, value: str, base: Column) -> DataFrame:
    """Low, mid and high picked by corner rules, in amounts and percent of a base."""
    out = grid.groupBy(*by).agg(
        F.min(F.when(low, F.col(value))).alias("low"),
        F.min(F.when(mid, F.col(value))).alias("mid"),
        F.min(F.when(high, F.col(value))).alias("high"),
    )
    return out.select("*", *[(F.try_divide(c, base) * 100).alias(f"{c}_pct_of_base") for c in ("low", "mid", "high")])


def sensitivity(
    grid: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    reference: Mapping[str, str],
    overrides: Sequence[tuple[int, str, str, Mapping[str, str]]],
    value: str,
) -> DataFrame:
    """One assumption at a time: each override row replaces some keys of the reference.

    The override table is a literal; a grid row is sent only to the overrides whose
    full key it matches. The reference value comes from the same pass by a window
    over the few rows of one group.
    """
    rows = [(0, "Reference case", "Reference case", {}), *overrides]
    hits = F.array(
        *[
            F.struct(
                F.lit(order).alias("bar_order"),
                F.lit(bar).alias("bar"),
                F.lit(label).alias("alt_label"),
                F.array(*[F.lit({**reference, **o}[k]) for k in keys]).alias("_key"),
            )
            for order, bar, label, o in rows
        ]
    )
    own = F.array(*[F.col(k) for k in keys])
    matched = grid.where(
        # Cheap prefilter: at most one key may differ from the reference.
        sum(((F.col(k) != reference[k]).cast("int") for k in keys), F.lit(0))
        <= max((len(o) for *_, o in overrides), default=0)
    ).select(*by, F.col(value).alias("value"), F.explode(F.filter(hits, lambda h: h["_key"] == own)).alias("_h"))
    flat = matched.select(*by, "_h.bar_order", "_h.bar", "_h.alt_label", "value")
    group, is_ref = Window.partitionBy(*by), F.col("bar_order") == 0
    known = flat.withColumn("_ref", F.max(F.when(is_ref, F.col("value"))).over(group))
    return known.withColumn("_has", F.max(is_ref).over(group)).where("_has").select(
        *by, "bar_order", "bar", "alt_label", "value", (F.col("value") - F.col("_ref")).alias("change_vs_reference")
    )


def sensitivity_of_sum(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    keys: tuple[Sequence[str], Sequence[str]],
    values: tuple[str, str],
    reference: Mapping[str, str],
    overrides: Sequence[tuple[int, str, str, Mapping[str, str]]],
    base: Column,
    also: tuple[Sequence[str], Sequence[str]] = ((), ()),
) -> DataFrame:
    """One assumption at a time for a total that two grids share: values[0] of ``a`` plus values[1] of ``b``.

    keys: the dimensions of each grid. An override row names only what it changes, in either grid; the rest is the reference's. Each row's full
    key is looked up once in each grid, so the grids' product is never built: a grid row goes on only for the bars whose key it has.
    Returns by, bar_order, bar, alt_label, both values, the columns ``also`` asked for, total, change_vs_reference and pct_of_base (total
    in percent of ``base``, a column of ``a``'s side or a literal). A bar without a row in both grids is left out, a group without the reference case has NULL changes.
    """
    free = ("_at", "bar_order", "bar", "alt_label")
    every = [*keys[0], *keys[1]]
    rows = [(i, order, bar, label, *({**reference, **o}[k] for k in every)) for i, (order, bar, label, o) in enumerate([(0, "Reference case", "Reference case", {}), *overrides])]
    bars = F.broadcast(inline_rows(a.sparkSession, rows, ", ".join(["_at int", "bar_order int", "bar string", "alt_label string", *(f"`{k}` string" for k in every)])))  # a literal of the call
    left = a.join(bars.select(*free, *keys[0]), list(keys[0])).select(*by, *free, F.col(values[0]), *also[0], base.cast("double").alias("_base"))
    right = b.join(bars.select("_at", *keys[1]), list(keys[1])).select(*by, "_at", F.col(values[1]), *also[1])
    both = left.join(right, [*by, "_at"]).withColumn("total", F.col(values[0]) + F.col(values[1]))
    ref = F.max(F.when(F.col("bar_order") == 0, F.col("total"))).over(Window.partitionBy(*by))
    return both.select(
        *by, *free[1:], *values, *also[0], *also[1], "total", (F.col("total") - ref).alias("change_vs_reference"), (F.try_divide("total", "_base") * 100).alias("pct_of_base")
    )


def tornado(sens: DataFrame, by: Sequence[str], change: str = "change_vs_reference") -> DataFrame:
    """Swing of each bar: lowest and highest change (zero included) and what causes them."""
    out = sens.where(F.col("bar_order") > 0).groupBy(*by, "bar_order", "bar").agg(
        F.min(change).alias("_lo"), F.max(change).alias("_hi"),
        F.min_by("alt_label", change).alias("_lo_label"), F.max_by("alt_label", change).alias("_hi_label"),
    )
    low, high = F.least(F.lit(0.0), "_lo"), F.greatest(F.lit(0.0), "_hi")
    return out.select(
        *by, "bar_order", "bar", low.alias("low"), high.alias("high"),
        F.when(F.col("_lo") < 0, F.col("_lo_label")).otherwise("").alias("low_label"),
        F.when(F.col("_hi") > 0, F.col("_hi_label")).otherwise("").alias("high_label"),
        (high - low).alias("swing"),
    )


def separable_range(a: DataFrame, b: DataFrame, by: Sequence[str], va: str, vb: str, la: str, lb: str) -> DataFrame:
    """Range of va + vb over all combinations, from the two ranges; the product is never built."""
    def ends(df: DataFrame, v: str, label: str, p: str) -> DataFrame:
        return df.groupBy(*by).agg(
            F.min(v).alias(f"{p}_min"), F.max(v).alias(f"{p}_max"),
            F.min_by(label, v).alias(f"{p}_min_case"), F.max_by(label, v).alias(f"{p}_max_case"),
            F.count(F.lit(1)).alias(f"{p}_n"),
        )

    both = ends(a, va, la, "a").join(ends(b, vb, lb, "b"), list(by))

    def end(name: str) -> Column:
        return F.struct(
            F.lit("low" if name == "min" else "high").alias("end"),
            (F.col(f"a_{name}") + F.col(f"b_{name}")).alias("total"),
            F.concat_ws("; ", f"a_{name}_case", f"b_{name}_case").alias("detail"),
            (F.col("a_n") * F.col("b_n")).alias("cases_considered"),
        )

    return both.select(*by, F.inline(F.array(end("min"), end("max"))))


def lookup_case(grid: DataFrame, choice: Mapping[str, object]) -> DataFrame:
    """The grid rows of a user's choice; a partial choice keeps the free dimensions."""
    cond = F.lit(True)
    for k, v in choice.items():
        cond = cond & (F.col(k) == F.lit(v))
    return grid.where(cond)


def compare_basis(grid: DataFrame, keys: Sequence[str], basis: str, a: str, b: str, value: str) -> DataFrame:
    """The same case under two bases: how many percent b lies below a."""
    out = grid.where(F.col(basis).isin(a, b)).groupBy(*keys).agg(
        F.max(F.when(F.col(basis) == a, F.col(value))).alias("value_a"),
        F.max(F.when(F.col(basis) == b, F.col(value))).alias("value_b"),
    )
    return out.select("*", ((1 - F.try_divide("value_b", "value_a")) * 100).alias("pct_lower"), F.try_divide("value_a", "value_b").alias("times"))


def context_metrics(df: DataFrame, metrics: Sequence[tuple[str, Column, Column, str]]) -> DataFrame:
    """Named, unit-scaled lookups in one pass: (metric, condition, value, unit)."""
    wide = df.agg(*[F.max(F.when(cond, value)).alias(f"_m{i}") for i, (_, cond, value, _u) in enumerate(metrics)])
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.col(f"_m{i}").cast("double").alias("value"), F.lit(unit).alias("unit"))
            for i, (name, _, _, unit) in enumerate(metrics)
        ]
    )
    return wide.select(F.inline(rows))
