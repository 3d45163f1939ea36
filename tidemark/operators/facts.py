"""Record and period facts about keyed series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import window_of
from tidemark.operators.scan import rank_rows
from tidemark.operators.tables import enrich, outer_merge, rank_placeable


def _first_peak(value: str, month: str) -> Column:
    """Month of the largest value, the first one on ties."""
    present = F.when(F.col(value).isNotNull(), F.struct(F.col(value), -F.unix_date(month)))
    return F.max_by(month, present)


def records(
    df: DataFrame, by: Sequence[str], nominal: str, real: str, month: str = "month", extra: Sequence[Column] = ()
) -> DataFrame:
    """Latest value against the series' own peak, as quoted and deflated.

    One aggregation; ``extra`` aggregates of the same groups ride along.
    """
    def side(v: str, name: str) -> list[Column]:
        return [
            F.max_by(v, month).alias(f"latest_{name}"),
            _first_peak(v, month).alias(f"{name}_peak_month"),
            F.max(v).alias(f"{name}_peak"),
        ]

    out = df.groupBy(*by).agg(
        F.min(F.when(F.col(nominal).isNotNull(), F.col(month))).alias("series_start"),
        F.max(month).alias("latest_month"),
        *side(nominal, "nominal"),
        *side(real, "real"),
        *extra,
    )
    for name in ("nominal", "real"):
        latest, top = F.col(f"latest_{name}"), F.col(f"{name}_peak")
        out = out.withColumns({
            f"latest_pct_of_{name}_peak": F.try_divide(latest * 100, top),
            f"at_{name}_record": (latest >= top).cast("int"),
        })
    return out


def latest_rank(df: DataFrame, by: Sequence[str], value: str, month: str = "month") -> DataFrame:
    """Months above and below the latest value, and its rank from the top."""
    d = df.where(F.col(value).isNotNull())
    now = F.max_by(value, month).over(Window.partitionBy(*by))
    out = d.withColumn("_now", now).groupBy(*by).agg(
        F.first("_now").alias("latest"),
        F.count_if(F.col(value) > F.col("_now")).alias("months_above"),
        F.count_if(F.col(value) < F.col("_now")).alias("months_below"),
        F.count(F.lit(1)).alias("months"),
    )
    return out.withColumn("rank", F.col("months_above") + 1)


def peak_in(df: DataFrame, by: Sequence[str], value: str, spans: Mapping[str, Column], month: str = "month") -> DataFrame:
    """Peak and its month inside named parts of the series (conditions on the row)."""
    aggs = []
    for i, cond in enumerate(spans.values()):
        v = F.when(cond, F.col(value))
        aggs += [
            F.max(v).alias(f"_v{i}"),
            F.max_by(month, F.when(v.isNotNull(), F.struct(v, -F.unix_date(month)))).alias(f"_m{i}"),
        ]
    rows = F.array(
        *[F.struct(F.lit(n).alias("span"), F.col(f"_m{i}").alias("peak_month"), F.col(f"_v{i}").alias("peak")) for i, n in enumerate(spans)]
    )
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(rows)).where(F.col("peak").isNotNull())


def from_end(by: Sequence[str], month: str = "month") -> Column:
    """1 for the latest row, 2 for the one before, and so on."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(month)))


def constant_until(df: DataFrame, by: Sequence[str], value: str, fixed: Column, month: str = "month") -> DataFrame:
    """First month in which the value differs from a fixed one."""
    return df.groupBy(*by).agg(F.min(F.when(F.col(value) != fixed, F.col(month))).alias("first_change"))


def identical_until(df: DataFrame, cols: Sequence[str], by: Sequence[str], month: str = "month") -> DataFrame:
    """Last month of the unbroken start in which all columns agree; NULL if they never do."""
    same = F.lit(True)
    for c in cols[1:]:
        same = same & (F.col(cols[0]) == F.col(c))
    out = df.groupBy(*by).agg(
        F.min(F.when(~F.coalesce(same, F.lit(False)), F.col(month))).alias("first_break"),
        F.max(F.when(same, F.col(month))).alias("last_same"),
    )
    whole = F.col("first_break").isNull() | (F.col("last_same") < F.col("first_break"))
    return out.withColumn("unbroken", whole.cast("int"))


def record_holds_until(df: DataFrame, by: Sequence[str], value: str, at: str, month: str = "month") -> DataFrame:
    """Was the value of month ``at`` a record so far, and when was it first exceeded?"""
    d = F.lit(at).cast("date")
    then = F.max(F.when(F.col(month) == d, F.col(value))).over(Window.partitionBy(*by))
    return df.withColumn("_v", then).groupBy(*by).agg(
        F.first("_v").alias("value_then"),
        (F.max(F.when(F.col(month) <= d, F.col(value))) <= F.first("_v")).cast("int").alias("was_record"),
        F.min(F.when((F.col(month) > d) & (F.col(value) > F.col("_v")), F.col(month))).alias("first_exceeded"),
    )


def run_above(df: DataFrame, by: Sequence[str], value: str, threshold: Column, month: str = "month") -> DataFrame:
    """The unbroken run above a threshold that reaches the latest month.

    last_below is NULL if the series was always above; the run is then the whole series.
    """
    d = df.where(F.col(value).isNotNull()).withColumn("_above", F.col(value) > threshold)
    last_below = F.max(F.when(~F.col("_above"), F.col(month))).over(Window.partitionBy(*by))
    in_run = F.col("_lb").isNull() | (F.col(month) > F.col("_lb"))
    return d.withColumn("_lb", last_below).groupBy(*by).agg(
        F.first("_lb").alias("last_below"),
        F.min(F.when(in_run, F.col(month))).alias("first_of_run"),
        F.count_if(in_run).alias("run_months"),
        (F.avg(F.col("_above").cast("double")) * 100).alias("share_above_pct"),
        F.count(F.lit(1)).alias("months"),
    )


def breakeven(constants: DataFrame, by: Sequence[str]) -> DataFrame:
    """Break-even price ratio from physical constants (material, property, value).

    Area = 1 / conductivity share, width its square root, mass = area * density ratio.
    """
    def pick(material: str, prop: str) -> Column:
        return F.max(F.when((F.col("material") == material) & (F.col("property") == prop), F.col("value")))

    c = constants.groupBy(*by).agg(
        pick("new", "conductivity_pct").alias("_k"), pick("new", "density").alias("_dn"), pick("old", "density").alias("_do")
    )
    area = F.try_divide(F.lit(100.0), "_k")
    mass = area * F.try_divide("_dn", "_do")
    return c.select(
        *by, area.alias("area_factor"), F.sqrt(area).alias("width_factor"), mass.alias("mass_factor"),
        F.try_divide(F.lit(1.0), mass).alias("breakeven_ratio"),
    )


def supply_table(
    production: DataFrame, stock: DataFrame, mapping: DataFrame, key: str = "country", world: DataFrame | None = None
) -> DataFrame:
    """Shares of world production and stock, stock-to-flow, rank, and a world row.

    ``world`` is one row with the published totals (production, reserves), which need not
    equal the sum of the listed entities; without it the sums are used. Entities that
    appear on one side only stay, with NULL on the other.
    """
    both = outer_merge(production, stock, [key])
    if world is None:
        world = both.agg(F.sum("production").alias("production"), F.sum("reserves").alias("reserves"))
    row = world.select(F.lit("World total").alias(key), "production", "reserves")
    out = enrich(both.unionByName(row), mapping, [key]).withColumns({
        "placeable": F.coalesce("placeable", F.lit(0)),
        "share_of_production_pct": F.try_divide(F.col("production") * 100, world.select("production").scalar()),
        "share_of_reserves_pct": F.try_divide(F.col("reserves") * 100, world.select("reserves").scalar()),
        "life_years": F.try_divide("reserves", "production"),
    })
    return rank_placeable(out, "placeable", "production", [key])


def compare_shares(
    wanted: DataFrame, a: DataFrame, b: DataFrame, key: str, va: str, vb: str, world: DataFrame | None = None
) -> DataFrame:
    """Two measures as shares of their world totals for a wanted list; missing stays NULL, never zero.

    ``world`` is one row with the published totals of both measures; without it the sums are used.
    """
    ta = world.select(va).scalar() if world is not None else a.agg(F.sum(va)).scalar()
    tb = world.select(vb).scalar() if world is not None else b.agg(F.sum(vb)).scalar()
    out = wanted.join(a.select(key, va), key, "left").join(b.select(key, vb), key, "left")
    return out.select(
        "*",
        F.try_divide(F.col(va) * 100, ta).alias(f"{va}_share_pct"),
        F.try_divide(F.col(vb) * 100, tb).alias(f"{vb}_share_pct"),
        F.col(va).isNotNull().cast("int").alias("listed"),
    )


def part_shares(df: DataFrame, label: str, value: str) -> DataFrame:
    """Parts of a whole with share, rank and the running share in rank order.

    One row per part comes in; ranks and running shares are found block by block.
    """
    share = F.try_divide(F.col(value) * 100, df.agg(F.sum(value)).scalar())
    d = df.select(label, share.alias("share_pct"))
    ranked = rank_rows(d, [], -F.col("share_pct"), [label], "rank", also_sum="share_pct")
    return ranked.select(label, "share_pct", "rank", F.col("running_share_pct").alias("running_pct"))


def within_pct(a: Column, b: Column, tol: float) -> tuple[Column, Column]:
    """Absolute difference in percent of b, and whether it is within the tolerance."""
    gap = F.try_divide(F.abs(a - b) * 100, b)
    return gap, (gap <= tol).cast("int")


def events_on_series(events: DataFrame, series: DataFrame, register: DataFrame, month: str = "month") -> DataFrame:
    """Approved events with their source and the value at the event month.

    An approved event whose month is not on the series, or whose source is not in the register, stops the job; the test is part of
    the columns ``month`` and ``source_id``. A month on the series without a value gives NULL.
    """
    ok = events.where(F.col("status") == "approved")
    found = enrich(enrich(ok, register.withColumn("_known", F.lit(True)), ["source_id"]), series.withColumn("_on", F.lit(True)), [month])

    def asserted(column: str, flag: str, kind: str, what: str) -> Column:
        said = F.concat(F.lit(f"event {column} "), F.coalesce(F.col(column).cast("string"), F.lit("(none)")), F.lit(what))
        return F.when(F.col(flag), F.col(column)).otherwise(F.raise_error(said).cast(kind)).alias(column)

    kinds = dict(found.dtypes)
    checked = {month: asserted(month, "_on", kinds[month], " is not on the series"), "source_id": asserted("source_id", "_known", kinds["source_id"], " is not in the register")}
    return found.select(*[checked.get(c, F.col(c)) for c in found.columns if c not in ("_known", "_on")])


def latest_change(df: DataFrame, by: Sequence[str], value: str, k: int, month: str = "month") -> DataFrame:
    """Latest value against the one k calendar months earlier."""
    last = F.max(month).over(Window.partitionBy(*by))
    ends = df.withColumn("_z", last).where(F.col(month).isin(F.col("_z")) | (F.col(month) == F.add_months("_z", -k)))
    out = ends.groupBy(*by).agg(
        F.max("_z").alias("latest_month"),
        F.max(F.when(F.col(month) == F.col("_z"), F.col(value))).alias("latest"),
        F.max(F.when(F.col(month) == F.add_months("_z", -k), F.col(value))).alias("earlier"),
    )
    return out.withColumn("change_pct", (F.try_divide("latest", "earlier") - 1) * 100)


def facts(df: DataFrame, by: Sequence[str], items: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """Long fact table: fact_id, value (number), value_text, unit. Numbers and text never mix."""
    def one(fact_id: str, c: Column, unit: str) -> Column:
        text = unit in ("text", "month")
        return F.struct(
            F.lit(fact_id).alias("fact_id"),
            (F.lit(None) if text else c).cast("double").alias("value"),
            (c if text else F.lit(None)).cast("string").alias("value_text"),
            F.lit(unit).alias("unit"),
        )

    return df.select(*by, F.inline(F.array(*[one(*i) for i in items])))


def kpis(series: DataFrame, by: Sequence[str], value: str, real: str, month: str = "month") -> DataFrame:
    """Latest-month figures of each series as long facts."""
    whole = Window.partitionBy(*by)
    d = series.select(
        "*", F.max(month).over(whole).alias("_z"),
        F.max_by(real, F.when(F.col(real).isNotNull(), F.col(month))).over(whole).alias("_now"),
    )
    ago = F.max(F.when(F.col(month) == F.add_months("_z", -12), F.col(value)))
    extra = [F.count_if(F.col(real) > F.col("_now")).alias("_above"), ago.alias("_ago")]
    wide = records(d, by, value, real, month, extra).withColumns({
        "_rank": F.col("_above") + 1, "change_pct": (F.try_divide("latest_nominal", "_ago") - 1) * 100,
    })
    return facts(
        wide, by,
        [
            ("latest_month", F.date_format("latest_month", "yyyy-MM"), "month"),
            ("latest_value", F.col("latest_nominal"), "price"),
            ("is_nominal_record", F.col("at_nominal_record"), "1 = yes"),
            ("real_share_of_record_pct", F.col("latest_pct_of_real_peak"), "percent"),
            ("real_peak_month", F.date_format("real_peak_month", "yyyy-MM"), "month"),
            ("change_12m_pct", F.col("change_pct"), "percent"),
            ("real_rank_latest", F.col("_rank"), "rank"),
        ],
    )


def period_changes(
    df: DataFrame,
    by: Sequence[str],
    columns: Mapping[tuple[str, str], str],
    periods: Mapping[str, int | None],
    second: str,
    ret_a: str,
    ret_b: str,
    companions: Mapping[tuple[str, str], Mapping[str, str]] | None = None,
    anchors: Mapping[tuple[str, str], str] | None = None,
    level: str | None = None,
    month: str = "month",
) -> DataFrame:
    """Change from the start of each period to the latest month, per currency and price basis.

    columns: (currency, basis) -> price column; combinations that are not given are skipped, such as deflated prices in a currency
    without a deflator. companions: (currency, basis) -> name -> column, rebased to 100 at the start (NULL for combinations without).
    The start is N months before the latest row (or the first row), moved forward to the first month with a value of the
    combination. The window of the second series and of ``level`` starts where the ``anchors`` column of the combination
    starts (its own price column by default), the second series no earlier than its own first value; direction counts
    cover the months strictly after that. A combination without any value from its start on has NULL figures. ``df`` must have one row per month of the
    series (see ``on_spine``), so rows are months.
    """
    anchors, companions = anchors or {}, companions or {}
    names = list(dict.fromkeys(n for of in companions.values() for n in of))
    w = window_of(by, month)
    whole = Window.partitionBy(*by)
    d = df.select("*", F.row_number().over(w).alias("_pos"), F.count(F.lit(1)).over(whole).alias("_last"))

    def companion(combo: tuple[str, str], name: str) -> Column:
        column = companions.get(combo, {}).get(name)
        return (F.col(column) if column else F.lit(None)).cast("double").alias(f"_c_{name}")

    combos = F.array(
        *[
            F.struct(
                F.lit(p).alias("period"), F.lit(currency).alias("currency"), F.lit(basis).alias("basis"),
                F.col(c).alias("v"), F.col(anchors.get((currency, basis), c)).alias("u"),
                (F.greatest(F.lit(1), F.col("_last") - n) if n is not None else F.lit(1)).cast("bigint").alias("target"),
                *[companion((currency, basis), n) for n in names],
            )
            for p, n in periods.items()
            for (currency, basis), c in columns.items()
        ]
    )
    # The first month with a value of the second series, the same for every period.
    d = d.withColumn("_first2", F.min(F.when(F.col(second).isNotNull(), F.col("_pos"))).over(whole))
    extra = [level] if level else []
    long = d.select(*by, month, "_pos", "_last", "_first2", second, ret_a, ret_b, *extra, F.inline(combos))
    keys = [*by, "period", "currency", "basis"]
    g = Window.partitionBy(*keys)

    def first_valid(c: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull() & (F.col("_pos") >= F.col("target")), F.col("_pos"))).over(g)

    long = long.select("*", first_valid("v").alias("_s"), first_valid("u").alias("_su"))
    # NULL if the second series has no value at all.
    long = long.withColumn("_s2", F.when(F.col("_first2").isNotNull(), F.greatest("_su", "_first2")))
    at_start, at_end, at_s2 = F.col("_pos") == F.col("_s"), F.col("_pos") == F.col("_last"), F.col("_pos") == F.col("_s2")

    def at(cond: Column, c: str) -> Column:
        return F.max(F.when(cond, F.col(c)))

    later = F.col("_pos") > F.col("_s2")
    a, b = F.col(ret_a), F.col(ret_b)
    both = a.isNotNull() & b.isNotNull() & later
    return long.groupBy(*keys).agg(
        at(at_start, month).alias("start_month"),
        ((F.try_divide(at(at_end, "v"), at(at_start, "v")) - 1) * 100).alias("change_pct"),
        *[F.try_divide(at(at_end, f"_c_{n}") * 100, at(at_start, f"_c_{n}")).alias(f"{n}_rebased") for n in names],
        *([at(F.col("_pos") == F.col("_su"), level).alias("level_start")] if level else []),
        at(at_s2, month).alias("second_start_month"),
        ((F.try_divide(at(at_end, second), at(at_s2, second)) - 1) * 100).alias("second_change_pct"),
        F.count_if(both & (b > 0)).alias("second_rose_n"),
        F.count_if(both & (b > 0) & (a < 0)).alias("fell_when_rose_n"),
        F.count_if(both & (b < 0)).alias("second_fell_n"),
        F.count_if(both & (b < 0) & (a > 0)).alias("rose_when_fell_n"),
    )
