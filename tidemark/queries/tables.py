"""Joins, aggregates, top-k and set operations on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import tables as TB
from tidemark.plans import inputs as I
from tidemark.plans.inputs import views
from tidemark.queries.common import r, rounded
from tidemark.queries.registry import query


@query(
    "outer_merge",
    "J9",
    """SELECT nation, band, customers, suppliers
FROM (SELECT c_nationkey AS nation, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band, COUNT(*) AS customers FROM customer GROUP BY 1, 2) a
FULL JOIN (SELECT s_nationkey AS nation, CAST(floor(s_acctbal / 1000) AS BIGINT) AS band, COUNT(*) AS suppliers FROM supplier GROUP BY 1, 2) b USING (nation, band)""",
)
def outer_merge(spark, sf):
    """Customers and suppliers by nation and thousand of balance; many pairs have one side alone."""
    def per(table, p, name):
        keys = [F.col(f"{p}_nationkey").alias("nation"), F.floor(F.col(f"{p}_acctbal") / 1000).cast("long").alias("band")]
        return I.table(spark, sf, table).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    return TB.outer_merge(per("customer", "c", "customers"), per("supplier", "s", "suppliers"), ["nation", "band"])


@query(
    "with_total",
    "J12 M24",
    f"""WITH {views("supply")} SELECT country, region, {r("production")} AS production, {r("100.0 * production / SUM(production) OVER (PARTITION BY region)", 1)} AS share_pct FROM supply""",
)
def with_total(spark, sf):
    t = TB.with_total(I.supply(spark, sf), "production", ["region"])
    return t.select("country", "region", "production", (F.round(100.0 * F.col("production") / F.col("total"), 1) + 0.0).alias("share_pct"))


@query(
    "counts",
    "G6",
    f"""SELECT l_returnflag, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(*) FILTER (WHERE l_discount > 0.05) AS discounted,
  MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, {r("AVG(l_quantity)")} AS mean_, SUM(l_quantity) AS total FROM lineitem GROUP BY l_returnflag""",
)
def counts(spark, sf):
    # Reduce per supplier first: the distinct count is then a plain count of groups.
    per = I.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("d"),
        F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.sum("l_quantity").alias("s"),
    )
    return rounded(per.groupBy("l_returnflag").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("suppliers"), F.sum("d").alias("discounted"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("s") / F.sum("n")).alias("mean_"), F.sum("s").alias("total"),
    ))


@query(
    "list_values",
    "G7",
    "SELECT p_brand, string_agg(p_type, ', ' ORDER BY p_type) AS types FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand",
)
def list_values(spark, sf):
    return TB.list_values(I.table(spark, sf, "part"), ["p_brand"], "p_type", "types")


@query("duplicates", "G8 Q3", "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def duplicates(spark, sf):
    return TB.duplicates(I.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "peaks",
    "G12",
    f"""WITH {views("px_daily")} SELECT series_id, {r("MAX(value)")} AS peak, arg_max(date, value) AS peak_at, {r("MIN(value)")} AS low, arg_min(date, value) AS low_at FROM px_daily GROUP BY series_id""",
)
def peaks(spark, sf):
    return rounded(TB.peak(I.px_daily(spark, sf), ["series_id"], "value", "date"))


@query(
    "census",
    "G13",
    f"""SELECT event_type, COUNT(*) AS "rows", COUNT(DISTINCT user_id) AS entities, {r("AVG(value)")} AS mean_value FROM events GROUP BY event_type""",
)
def census(spark, sf):
    return rounded(TB.census(I.table(spark, sf, "events"), ["event_type"], "user_id", "value"))


@query(
    "latest_rows",
    "K2",
    f"""WITH {views("px_daily")} SELECT series_id, MAX(date) AS date, {r("arg_max(value, date)")} AS value, arg_max(n_obs, date) AS n_obs FROM px_daily GROUP BY series_id""",
)
def latest_rows(spark, sf):
    return rounded(TB.latest(I.px_daily(spark, sf), ["series_id"], "date", ["value", "n_obs"]))


@query(
    "top_k",
    "K1 K3",
    """SELECT c_nationkey, c_custkey, c_acctbal, CAST(rn AS INTEGER) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3""",
)
def top_k(spark, sf):
    top = TB.top_k(I.table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)
    return TB.ordered(top.select("c_nationkey", "c_custkey", "c_acctbal", "rank"), ["c_nationkey", "rank"])


@query("union_distinct", "K5 K6", "SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark, sf):
    a = I.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")).distinct()
    b = I.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).distinct()
    return TB.stack(a, b).distinct()


@query(
    "append_total",
    "K9",
    f"""WITH {views("supply")} SELECT country, region, {r("production")} AS production FROM supply UNION ALL SELECT 'World', NULL, {r("SUM(production)")} FROM supply""",
)
def append_total(spark, sf):
    s = I.supply(spark, sf).select("country", "region", "production")
    return rounded(TB.append_total(s, "country", "World", ["production"]))


@query(
    "cross_grid",
    "J3 K8",
    f"""WITH {views("supply")}, a AS (SELECT unnest([0.5, 1.0, 2.0]) AS factor), b AS (SELECT unnest(['x', 'y']) AS kind)
SELECT country, CAST(factor AS DOUBLE) AS factor, kind, {r("production * factor")} AS scaled FROM supply CROSS JOIN a CROSS JOIN b""",
)
def cross_grid(spark, sf):
    g = TB.expand(I.supply(spark, sf), ("factor", [0.5, 1.0, 2.0]), ("kind", ["x", "y"]))
    return rounded(g.select("country", "factor", "kind", (F.col("production") * F.col("factor")).alias("scaled")))


@query(
    "pick_cells",
    "G2",
    f"""SELECT l_returnflag, MIN(CASE WHEN l_linestatus = 'O' AND l_tax = 0.0 THEN l_quantity END) AS low, MAX(CASE WHEN l_linestatus = 'F' AND l_discount = 0.0 THEN l_quantity END) AS high FROM lineitem GROUP BY l_returnflag""",
)
def pick_cells(spark, sf):
    return TB.pick_cells(I.table(spark, sf, "lineitem"), ["l_returnflag"], {
        "low": ("min", (F.col("l_linestatus") == "O") & (F.col("l_tax") == 0.0), "l_quantity"),
        "high": ("max", (F.col("l_linestatus") == "F") & (F.col("l_discount") == 0.0), "l_quantity"),
    })


@query(
    "aligned_pairs",
    "J10",
    f"""WITH {views("idx_monthly", "defl_monthly")} SELECT i.month, {r("i.value")} AS x, {r("d.value")} AS y FROM idx_monthly i JOIN defl_monthly d ON d.month = i.month""",
)
def aligned_pairs(spark, sf):
    return rounded(TB.align(I.idx_monthly(spark, sf), I.defl_monthly(spark, sf), ["month"], "value", "value"))


@query(
    "growth_view",
    "M24 J4",
    f"""WITH y AS (SELECT s_nationkey AS nation, year(l_shipdate) AS yr, SUM(l_quantity) AS q FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
SELECT a.nation, {r("a.q")} AS q_1996, {r("b.q")} AS q_2000, {r("b.q - a.q")} AS increase, {r("100.0 * (b.q - a.q) / a.q", 4)} AS increase_pct FROM y a JOIN y b ON b.nation = a.nation AND a.yr = 1996 AND b.yr = 2000""",
)
def growth_view(spark, sf):
    li, su = I.table(spark, sf, "lineitem"), I.table(spark, sf, "supplier")
    yr = F.year("l_shipdate")
    # Both years in one pass instead of a self join.
    per = li.where(yr.isin(1996, 2000)).groupBy("l_suppkey").agg(
        F.sum(F.when(yr == 1996, F.col("l_quantity"))).alias("a"), F.sum(F.when(yr == 2000, F.col("l_quantity"))).alias("b")
    )
    g = per.join(su, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.sum("a").alias("q_1996"), F.sum("b").alias("q_2000")
    ).dropna()
    inc = F.col("q_2000") - F.col("q_1996")
    return g.select("nation", "q_1996", "q_2000", inc.alias("increase"), (F.round(100.0 * inc / F.col("q_1996"), 4) + 0.0).alias("increase_pct"))
