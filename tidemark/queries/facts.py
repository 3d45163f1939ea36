"""Record, period and supply facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import facts as FA
from tidemark.operators import panel as P
from tidemark.plans import inputs as I
from tidemark.plans.inputs import views
from tidemark.queries.common import CHANGES_SQL, RATIO_SQL, panel, r, ratio, rounded, rs
from tidemark.queries.panels import REAL_SQL, real_prices_df
from tidemark.queries.registry import query

BY = ["series_id"]

RECORDS_SQL = REAL_SQL + """,
rec AS (SELECT series_id, MIN(month) AS series_start, MAX(month) AS latest_month, arg_max(value, month) AS latest_nominal,
    MAX(value) AS nominal_peak, arg_max(real, month) AS latest_real, MAX(real) AS real_peak FROM real_ GROUP BY series_id),
recs AS (SELECT rec.*, (SELECT MIN(month) FROM real_ x WHERE x.series_id = rec.series_id AND x.value = rec.nominal_peak) AS nominal_peak_month,
    (SELECT MIN(month) FROM real_ x WHERE x.series_id = rec.series_id AND x.real = rec.real_peak) AS real_peak_month,
    latest_nominal * 100 / nominal_peak AS latest_pct_of_nominal_peak, latest_real * 100 / real_peak AS latest_pct_of_real_peak,
    CAST(latest_nominal >= nominal_peak AS INTEGER) AS at_nominal_record, CAST(latest_real >= real_peak AS INTEGER) AS at_real_record FROM rec)"""


@query(
    "records",
    "R1 G12",
    f"""WITH {RECORDS_SQL} SELECT series_id, series_start, latest_month, nominal_peak_month, real_peak_month, at_nominal_record, at_real_record,
  {rs("latest_nominal, nominal_peak, latest_real, real_peak, latest_pct_of_nominal_peak, latest_pct_of_real_peak")} FROM recs""",
)
def records(spark, sf):
    return rounded(FA.records(real_prices_df(spark, sf), BY, "value", "real"))


RANK_SQL = REAL_SQL + """,
rk AS (SELECT r.series_id, MAX(l.now_) AS latest, COUNT(*) FILTER (WHERE r.real > now_) AS months_above, COUNT(*) FILTER (WHERE r.real < now_) AS months_below,
    COUNT(*) AS months FROM real_ r JOIN (SELECT series_id, arg_max(real, month) AS now_ FROM real_ GROUP BY series_id) l ON l.series_id = r.series_id
  WHERE r.real IS NOT NULL GROUP BY r.series_id)"""


@query("latest_rank", "R2", f"WITH {RANK_SQL} SELECT series_id, {rs('latest')}, months_above, months_below, months, months_above + 1 AS rank FROM rk")
def latest_rank(spark, sf):
    return rounded(FA.latest_rank(real_prices_df(spark, sf), BY, "real"))


def _peak_sql(name: str, cond: str) -> str:
    return f"SELECT series_id, '{name}' AS span, arg_max(month, value) AS peak_month, {r('MAX(value)')} AS peak FROM b WHERE {cond} GROUP BY series_id"


@query(
    "peak_in",
    "R3",
    f"""WITH {views("px_monthly")}, b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY month DESC) AS back FROM px_monthly)
{_peak_sql("before 1997", "month < DATE '1997-01-01'")} UNION ALL {_peak_sql("since 1998 without latest", "month >= DATE '1998-01-01' AND back > 1")}
UNION ALL {_peak_sql("before last 24", "back > 24")}""",
)
def peak_in(spark, sf):
    b = I.px_monthly(spark, sf).withColumn("back", FA.from_end(BY))
    m = F.col("month")
    return rounded(FA.peak_in(b, BY, "value", {
        "before 1997": m < F.lit("1997-01-01").cast("date"),
        "since 1998 without latest": (m >= F.lit("1998-01-01").cast("date")) & (F.col("back") > 1),
        "before last 24": F.col("back") > 24,
    }))


@query(
    "constant_until",
    "R4",
    """WITH e AS (SELECT l_linenumber AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, MIN(l_discount) AS a, MIN(l_tax) AS b, MIN(l_quantity) AS c FROM lineitem GROUP BY ALL)
SELECT series_id, MIN(CASE WHEN c <> 1.0 THEN month END) AS first_change, MIN(CASE WHEN NOT (a = b) THEN month END) AS first_break, MAX(CASE WHEN a = b THEN month END) AS last_same,
  CAST(MIN(CASE WHEN NOT (a = b) THEN month END) IS NULL OR coalesce(MAX(CASE WHEN a = b THEN month END) < MIN(CASE WHEN NOT (a = b) THEN month END), FALSE) AS INTEGER) AS unbroken
FROM e GROUP BY series_id""",
)
def constant_until(spark, sf):
    e = I.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("series_id"), P.month_of("l_shipdate").alias("month")).agg(
        F.min("l_discount").alias("a"), F.min("l_tax").alias("b"), F.min("l_quantity").alias("c")
    )
    one = FA.constant_until(e, BY, "c", F.lit(1.0))
    two = FA.identical_until(e, ["a", "b"], BY)
    return one.join(two, "series_id").withColumn("unbroken", F.coalesce("unbroken", F.lit(0)))


@query(
    "record_holds",
    "R5 W14",
    f"""WITH {views("px_monthly")}, t AS (SELECT p.*, (SELECT MAX(value) FROM px_monthly x WHERE x.series_id = p.series_id AND x.month = DATE '1997-06-01') AS v FROM px_monthly p),
w AS (SELECT series_id, month, CAST(value >= coalesce(MAX(value) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), value) AS INTEGER) AS rec FROM px_monthly)
SELECT t.series_id, {r("MAX(v)")} AS value_then, CAST(MAX(CASE WHEN t.month <= DATE '1997-06-01' THEN value END) <= MAX(v) AS INTEGER) AS was_record,
  MIN(CASE WHEN t.month > DATE '1997-06-01' AND value > v THEN t.month END) AS first_exceeded, CAST(SUM(rec) AS BIGINT) AS records_so_far
FROM t JOIN w ON w.series_id = t.series_id AND w.month = t.month GROUP BY t.series_id""",
)
def record_holds(spark, sf):
    px = I.px_monthly(spark, sf).select("series_id", "month", "value")
    flags = px.select("series_id", "month", "value", P.is_record("value", BY).alias("_rec"))
    holds = FA.record_holds_until(flags, BY, "value", "1997-06-01")
    n = flags.groupBy("series_id").agg(F.sum("_rec").alias("records_so_far"))
    return rounded(holds.join(n, "series_id"))


@query(
    "run_above",
    "R6",
    f"""WITH {RATIO_SQL}, b AS (SELECT pair_id, MAX(CASE WHEN ratio <= 0.97 THEN month END) AS last_below FROM ratio GROUP BY pair_id)
SELECT r.pair_id, MAX(last_below) AS last_below, MIN(CASE WHEN last_below IS NULL OR month > last_below THEN month END) AS first_of_run,
  COUNT(*) FILTER (WHERE last_below IS NULL OR month > last_below) AS run_months, {r("AVG(CAST(ratio > 0.97 AS INTEGER)) * 100")} AS share_above_pct, COUNT(*) AS months
FROM ratio r JOIN b ON b.pair_id = r.pair_id GROUP BY r.pair_id""",
)
def run_above(spark, sf):
    return rounded(FA.run_above(ratio(spark, sf), ["pair_id"], "ratio", F.lit(0.97)))


@query(
    "breakeven",
    "R7",
    f"""WITH c AS (SELECT p_brand, AVG(CASE WHEN p_size % 2 = 0 THEN p_size END) AS k, AVG(CASE WHEN p_type = 'ECONOMY' THEN p_retailprice END) AS dn,
  AVG(CASE WHEN p_type = 'PROMO' THEN p_retailprice END) AS d0 FROM part GROUP BY p_brand)
SELECT p_brand, {r("100.0 / k")} AS area_factor, {r("sqrt(100.0 / k)")} AS width_factor, {r("100.0 / k * dn / d0")} AS mass_factor, {r("1 / (100.0 / k * dn / d0)")} AS breakeven_ratio FROM c""",
)
def breakeven(spark, sf):
    p = I.table(spark, sf, "part").groupBy("p_brand").agg(
        F.avg(F.when(F.col("p_size") % 2 == 0, F.col("p_size"))).alias("k"),
        F.avg(F.when(F.col("p_type") == "ECONOMY", F.col("p_retailprice"))).alias("dn"),
        F.avg(F.when(F.col("p_type") == "PROMO", F.col("p_retailprice"))).alias("d0"),
    )
    rows = F.array(*[
        F.struct(F.lit(m).alias("material"), F.lit(pr).alias("property"), F.col(c).alias("value"))
        for m, pr, c in (("new", "conductivity_pct", "k"), ("new", "density", "dn"), ("old", "density", "d0"))
    ])
    return rounded(FA.breakeven(p.select("p_brand", F.inline(rows)), ["p_brand"]))


SUPPLY_SQL = views("supply") + """,
prod AS (SELECT country, production FROM supply), res AS (SELECT country, reserves FROM supply),
iso AS (SELECT n_name AS country, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS code, CASE WHEN n_nationkey % 10 = 9 THEN 0 ELSE 1 END AS placeable FROM nation),
sup AS (SELECT country, production, reserves FROM prod FULL JOIN res USING (country)),
w AS (SELECT ROUND(SUM(production) / 1000) * 1000 AS p, ROUND(SUM(reserves) / 1000000) * 1000000 AS r FROM supply),
all_ AS (SELECT sup.*, code, placeable FROM sup LEFT JOIN iso USING (country) UNION ALL SELECT 'World total', p, r, NULL, 0 FROM w)"""


def published_total(s):
    """World totals as a publisher prints them, rounded."""
    return s.agg(
        (F.round(F.sum("production") / 1000) * 1000).alias("production"), (F.round(F.sum("reserves") / 1000000) * 1000000).alias("reserves")
    )


@query(
    "supply_table",
    "R8 J9 J11 W13 K9",
    f"""WITH {SUPPLY_SQL} SELECT country, {r("production")} AS production, {r("reserves", 2)} AS reserves, code, placeable, {r("production * 100 / p")} AS share_of_production_pct,
  {r("all_.reserves * 100 / r")} AS share_of_reserves_pct, {r("reserves / production", 4)} AS life_years,
  CAST(CASE WHEN placeable = 1 THEN ROW_NUMBER() OVER (PARTITION BY placeable ORDER BY production DESC NULLS LAST) END AS INTEGER) AS rank FROM all_ CROSS JOIN w""",
)
def supply_table(spark, sf):
    s = I.supply(spark, sf)
    n = I.table(spark, sf, "nation")
    mapping = n.select(
        F.col("n_name").alias("country"), F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("code"),
        F.when(F.col("n_nationkey") % 10 == 9, 0).otherwise(1).alias("placeable"),
    )
    out = FA.supply_table(
        s.select("country", "production"),
        s.select("country", "reserves"),
        mapping,
        world=published_total(s),
    )
    digits = {"production": 6, "reserves": 2, "share_of_production_pct": 6, "share_of_reserves_pct": 6, "life_years": 4}
    return out.select(*[(F.round(c, digits[c]) + 0.0).alias(c) if c in digits else F.col(c) for c in out.columns])


@query(
    "compare_shares",
    "R9",
    f"""WITH {SUPPLY_SQL} SELECT n_name AS country, {r("production")} AS production, {r("reserves", 2)} AS reserves, {r("production * 100 / (SELECT p FROM w)")} AS production_share_pct,
  {r("reserves * 100 / (SELECT r FROM w)")} AS reserves_share_pct, CAST(production IS NOT NULL AS INTEGER) AS listed
FROM nation n LEFT JOIN prod ON prod.country = n_name LEFT JOIN res ON res.country = n_name""",
)
def compare_shares(spark, sf):
    s = I.supply(spark, sf)
    wanted = I.table(spark, sf, "nation").select(F.col("n_name").alias("country"))
    out = FA.compare_shares(wanted, s.select("country", "production"), s.select("country", "reserves"), "country", "production", "reserves", published_total(s))
    digits = {"production": 6, "reserves": 2, "production_share_pct": 6, "reserves_share_pct": 6}
    return out.select(*[(F.round(c, digits[c]) + 0.0).alias(c) if c in digits else F.col(c) for c in out.columns])


@query(
    "part_shares",
    "R10",
    f"""WITH {views("sector_totals")}, s AS (SELECT sector, 100.0 * sales / SUM(sales) OVER () AS share_pct FROM sector_totals)
SELECT sector, {r("share_pct")} AS share_pct, CAST(ROW_NUMBER() OVER (ORDER BY share_pct DESC, sector) AS INTEGER) AS rank,
  {r("SUM(share_pct) OVER (ORDER BY share_pct DESC, sector ROWS UNBOUNDED PRECEDING)")} AS running_pct FROM s""",
)
def part_shares(spark, sf):
    return rounded(FA.part_shares(I.sector_totals(spark, sf), "sector", "sales"))


@query(
    "within_tolerance",
    "R11",
    f"""WITH {views("supply")}, a AS (SELECT region, SUM(production) AS p, AVG(SUM(production)) OVER () AS m FROM supply GROUP BY region)
SELECT region, {r("abs(p - m) * 100 / m")} AS difference_pct, CAST(abs(p - m) * 100 / m <= 10 AS INTEGER) AS within_10_pct FROM a""",
)
def within_tolerance(spark, sf):
    a = I.supply(spark, sf).groupBy("region").agg(F.sum("production").alias("p"))
    gap, ok = FA.within_pct(F.col("p"), a.agg(F.avg("p")).scalar(), 10)
    return rounded(a.select("region", gap.alias("difference_pct"), ok.alias("within_10_pct")))


@query(
    "events_overlay",
    "R12 J11",
    f"""WITH {views("idx_monthly")}, ev AS (SELECT CAST(date_trunc('month', MIN(o_orderdate)) AS DATE) AS month, o_orderpriority AS label,
    CASE WHEN o_orderpriority LIKE '4%' THEN 'draft' ELSE 'approved' END AS status, 'S' || substr(o_orderpriority, 1, 1) AS source_id FROM orders GROUP BY o_orderpriority),
src AS (SELECT 'S' || n_nationkey AS source_id, n_name AS source_name FROM nation)
SELECT label, ev.month, ev.source_id, source_name, {r("value")} AS value FROM ev LEFT JOIN src USING (source_id) LEFT JOIN idx_monthly i ON i.month = ev.month WHERE status = 'approved'""",
)
def events_overlay(spark, sf):
    o = I.table(spark, sf, "orders")
    pr = F.col("o_orderpriority")
    ev = o.groupBy(pr.alias("label")).agg(P.month_of(F.min("o_orderdate")).alias("month")).select(
        "label", "month", F.when(F.col("label").startswith("4"), "draft").otherwise("approved").alias("status"),
        F.concat(F.lit("S"), F.substring("label", 1, 1)).alias("source_id"),
    )
    src = I.table(spark, sf, "nation").select(
        F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("source_id"), F.col("n_name").alias("source_name")
    )
    idx = I.idx_monthly(spark, sf).select("month", "value")
    return rounded(FA.events_on_series(ev, idx, src).select("label", "month", "source_id", "source_name", "value"))


@query(
    "latest_change",
    "R13",
    f"""WITH {views("px_monthly")}, z AS (SELECT series_id, MAX(month) AS z FROM px_monthly GROUP BY series_id)
SELECT z.series_id, z AS latest_month, {r("a.value")} AS latest, {r("b.value")} AS earlier, {r("(a.value / b.value - 1) * 100")} AS change_pct
FROM z JOIN px_monthly a ON a.series_id = z.series_id AND a.month = z LEFT JOIN px_monthly b ON b.series_id = z.series_id AND b.month = z - INTERVAL 12 MONTH""",
)
def latest_change(spark, sf):
    return rounded(FA.latest_change(I.px_monthly(spark, sf), BY, "value", 12))


@query(
    "kpis",
    "R14 R17",
    f"""WITH {RECORDS_SQL}, {RANK_SQL[RANK_SQL.index("rk AS"):]},
c AS (SELECT a.series_id, (a.value / b.value - 1) * 100 AS change_pct FROM recs q JOIN real_ a ON a.series_id = q.series_id AND a.month = q.latest_month
  LEFT JOIN real_ b ON b.series_id = q.series_id AND b.month = q.latest_month - INTERVAL 12 MONTH)
SELECT series_id, 'latest_month' AS fact_id, CAST(NULL AS DOUBLE) AS value, strftime(latest_month, '%Y-%m') AS value_text, 'month' AS unit FROM recs
UNION ALL SELECT series_id, 'latest_value', {r("latest_nominal")}, NULL, 'price' FROM recs
UNION ALL SELECT series_id, 'is_nominal_record', at_nominal_record, NULL, '1 = yes' FROM recs
UNION ALL SELECT series_id, 'real_share_of_record_pct', {r("latest_pct_of_real_peak")}, NULL, 'percent' FROM recs
UNION ALL SELECT series_id, 'real_peak_month', NULL, strftime(real_peak_month, '%Y-%m'), 'month' FROM recs
UNION ALL SELECT series_id, 'change_12m_pct', {r("change_pct")}, NULL, 'percent' FROM c
UNION ALL SELECT series_id, 'real_rank_latest', months_above + 1, NULL, 'rank' FROM rk""",
)
def kpis(spark, sf):
    return rounded(FA.kpis(real_prices_df(spark, sf), BY, "value", "real"))


@query(
    "dash_series",
    "R15 W10",
    f"""WITH {CHANGES_SQL}, d AS (SELECT p.*, px * (SELECT value FROM defl_monthly ORDER BY month DESC LIMIT 1) / defl AS px_real, c.px_logret_m AS ra, c.idx_logret_m AS rb
  FROM panel p JOIN changes c ON c.series_id = p.series_id AND c.month = p.month)
SELECT series_id, month, {rs("px, px_fx, px_real, idx")}, {r("CASE WHEN COUNT(px) OVER m = 12 THEN AVG(px) OVER m END")} AS px_ma12,
  {r("CASE WHEN COUNT(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 1 END) OVER m = 12 THEN corr(ra, rb) OVER m END")} AS corr12,
  {r("100 * px_real / MAX(px_real) OVER (PARTITION BY series_id)")} AS rec_pct
FROM d WINDOW m AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
)
def dash_series(spark, sf):
    w = P.window_of(BY)
    p = panel(spark, sf)
    base = I.defl_monthly(spark, sf).agg(F.max_by("value", "month")).scalar()
    d = p.select(
        "series_id", "month", "px", "px_fx", (F.col("px") * F.try_divide(base, "defl")).alias("px_real"), "idx",
        P.log_change(F.col("px"), F.lag("px").over(w)).alias("ra"), P.log_change(F.col("idx"), F.lag("idx").over(w)).alias("rb"),
    )
    out = d.select(
        "series_id", "month", "px", "px_fx", "px_real", "idx", P.rolling_mean("px", 12, BY).alias("px_ma12"),
        P.rolling_corr("ra", "rb", 12, BY).alias("corr12"), P.pct_of_max("px_real", BY).alias("rec_pct"),
    )
    return rounded(out)


SPANS = {"1y": 12, "3y": 36, "all": None}


@query(
    "period_changes",
    "R16",
    f"""WITH {CHANGES_SQL},
d AS (SELECT p.series_id, p.month, p.px, p.px_fx, p.px * (SELECT value FROM defl_monthly ORDER BY month DESC LIMIT 1) / p.defl AS px_real,
    p.px_fx / p.defl AS fx_real, CASE WHEN p.month >= DATE '1997-03-01' THEN p.idx END AS idx, p.defl, p.fx, c.px_pct_m AS ra, c.idx_pct_m AS rb,
    ROW_NUMBER() OVER (PARTITION BY p.series_id ORDER BY p.month) AS pos, COUNT(*) OVER (PARTITION BY p.series_id) AS last_
  FROM panel p JOIN changes c ON c.series_id = p.series_id AND c.month = p.month),
spans AS (SELECT * FROM (VALUES ('1y', 12), ('3y', 36), ('all', 100000)) t(period, n)),
l AS (SELECT d.*, period, 'own' AS currency, 'quoted' AS basis, px AS v, px AS u, px_fx AS c0, fx AS c1, greatest(1, last_ - n) AS target FROM d CROSS JOIN spans
  UNION ALL SELECT d.*, period, 'own', 'real', px_real, px_real, fx_real, NULL, greatest(1, last_ - n) FROM d CROSS JOIN spans
  UNION ALL SELECT d.*, period, 'other', 'quoted', px_fx, px, NULL, NULL, greatest(1, last_ - n) FROM d CROSS JOIN spans),
s AS (SELECT *, MIN(CASE WHEN v IS NOT NULL AND pos >= target THEN pos END) OVER g AS st, MIN(CASE WHEN u IS NOT NULL AND pos >= target THEN pos END) OVER g AS stu,
    MIN(CASE WHEN idx IS NOT NULL THEN pos END) OVER (PARTITION BY series_id) AS f2 FROM l WINDOW g AS (PARTITION BY series_id, period, currency, basis)),
s2 AS (SELECT *, CASE WHEN f2 IS NOT NULL THEN greatest(stu, f2) END AS st2 FROM s)
SELECT series_id, period, currency, basis, MAX(CASE WHEN pos = st THEN month END) AS start_month,
  {r("(MAX(CASE WHEN pos = last_ THEN v END) / MAX(CASE WHEN pos = st THEN v END) - 1) * 100")} AS change_pct,
  {r("MAX(CASE WHEN pos = last_ THEN c0 END) * 100 / MAX(CASE WHEN pos = st THEN c0 END)")} AS converted_rebased,
  {r("MAX(CASE WHEN pos = last_ THEN c1 END) * 100 / MAX(CASE WHEN pos = st THEN c1 END)")} AS rate_rebased,
  {r("MAX(CASE WHEN pos = stu THEN defl END)")} AS level_start, MAX(CASE WHEN pos = st2 THEN month END) AS second_start_month, {r("(MAX(CASE WHEN pos = last_ THEN idx END) / MAX(CASE WHEN pos = st2 THEN idx END) - 1) * 100")} AS second_change_pct,
  COUNT(*) FILTER (WHERE pos > st2 AND ra IS NOT NULL AND rb > 0) AS second_rose_n, COUNT(*) FILTER (WHERE pos > st2 AND ra < 0 AND rb > 0) AS fell_when_rose_n,
  COUNT(*) FILTER (WHERE pos > st2 AND ra IS NOT NULL AND rb < 0) AS second_fell_n, COUNT(*) FILTER (WHERE pos > st2 AND ra > 0 AND rb < 0) AS rose_when_fell_n
FROM s2 GROUP BY series_id, period, currency, basis""",
)
def period_changes(spark, sf):
    """Quoted prices in two currencies, real ones in the first alone: the other has no deflator and is skipped."""
    w = P.window_of(BY)
    base = I.defl_monthly(spark, sf).agg(F.max_by("value", "month")).scalar()
    d = panel(spark, sf).select(
        "series_id", "month", "px", "px_fx", "fx", F.try_divide(F.col("px") * base, "defl").alias("px_real"), F.try_divide("px_fx", "defl").alias("fx_real"),
        F.when(F.col("month") >= F.lit("1997-03-01").cast("date"), F.col("idx")).alias("idx"), "defl",
        P.pct_change(F.col("px"), F.lag("px").over(w)).alias("ra"), P.pct_change(F.col("idx"), F.lag("idx").over(w)).alias("rb"),
    )
    columns = {("own", "quoted"): "px", ("own", "real"): "px_real", ("other", "quoted"): "px_fx"}
    companions = {("own", "quoted"): {"converted": "px_fx", "rate": "fx"}, ("own", "real"): {"converted": "fx_real"}}
    return rounded(FA.period_changes(d, BY, columns, SPANS, "idx", "ra", "rb", companions, {("other", "quoted"): "px"}, "defl"))
