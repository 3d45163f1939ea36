"""Data-quality and publication queries on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.operators import governance as G
from tidemark.operators import panel as P
from tidemark.operators import quality as Q
from tidemark.operators import signals as S
from tidemark.operators import stats as T
from tidemark.operators import tables as TB
from tidemark.plans import inputs as I
from tidemark.plans.inputs import views
from tidemark.queries.cleaning import snum
from tidemark.queries.common import (
    CHANGES_SQL, LINK_SQL, MART_SQL, MONTHS_SQL, RATIO_SQL, WARMUP,
    changes, link, mart, months_of_signal, ratio,
)
from tidemark.queries.registry import query
from tidemark.queries.scenarios import GRID_SQL, grid
from tidemark.session import cut_lineage, shared_folder
from tidemark.sources import store

BY = ["series_id"]


def chk(src: str, table: str, desc: str, ok: str | None, detail: str, otherwise: str = "FAIL") -> str:
    """One check as SQL; desc and detail are SQL text expressions."""
    status = "'INFO'" if ok is None else f"CASE WHEN {ok} THEN 'PASS' ELSE '{otherwise}' END"
    return f"SELECT '{table}' AS table_name, {desc} AS description, {status} AS status, {detail} AS detail FROM {src}"


def ident(src: str, bad: str, table: str, desc: str) -> str:
    return chk(f"(SELECT COUNT(*) FILTER (WHERE {bad}) AS bad, COUNT(*) AS n FROM {src})", table, f"'{desc}'", "bad = 0", "bad || ' violations in ' || n || ' rows'")


@query(
    "check_unique",
    "Q3 G8",
    chk("(SELECT COUNT(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1))", "lineitem",
        "'no duplicate (l_orderkey, l_linenumber)'", "n = 0", "n || ' duplicated keys'"),
)
def check_unique(spark, sf):
    return Q.check_unique(I.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem")


@query(
    "check_no_gaps",
    "Q4",
    f"""WITH {views("px_monthly")}, g AS (SELECT series_id, COUNT(*) AS n, COUNT(DISTINCT month) AS months, date_diff('month', MIN(month), MAX(month)) + 1 AS expected FROM px_monthly GROUP BY series_id)
{chk("g", "px_monthly", "series_id || ': no missing or duplicate months'", "n = expected AND months = n", "n || ' of ' || expected || ' months'", "WARN")}""",
)
def check_no_gaps(spark, sf):
    return Q.check_no_gaps(I.px_monthly(spark, sf), BY, "px_monthly")


LIMITS = {"click": (0, 400), "view": (0, 50), "purchase": (0, 1000), "error": (0, 90)}


@query(
    "check_range",
    "Q5",
    f"""WITH lim AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {a}, {z})" for k, (a, z) in LIMITS.items())}) t(k, a, z)),
g AS (SELECT event_type, COUNT(*) FILTER (WHERE value < a OR value > z) AS bad, MIN(value) AS lo, MAX(value) AS hi FROM events JOIN lim ON k = event_type GROUP BY event_type)
{chk("g", "events", "event_type || ': values inside the plausible range'", "bad = 0", "'min ' || printf('%.2f', lo) || ', max ' || printf('%.2f', hi)", "WARN")}""",
)
def check_range(spark, sf):
    return Q.check_range(I.table(spark, sf, "events"), "event_type", "value", LIMITS, "events")


@query(
    "check_min_obs",
    "Q6 G5",
    f"""WITH {views("px_daily")}, m AS (SELECT series_id, date_trunc('month', date) AS month, COUNT(*) AS n FROM px_daily GROUP BY ALL),
c AS (SELECT * FROM m x WHERE month < (SELECT MAX(month) FROM m y WHERE y.series_id = x.series_id)),
g AS (SELECT COUNT(*) AS months, COUNT(*) FILTER (WHERE n < 15) AS bad, MIN(n) AS lo, MAX(n) AS hi FROM c)
{chk("g", "px_daily", "'every complete month has at least 15 days with a value'", "bad = 0", "months || ' complete months; fewest ' || lo || ', most ' || hi", "WARN")}""",
)
def check_min_obs(spark, sf):
    return Q.check_min_obs(I.px_daily(spark, sf), BY, 15, "px_daily")


@query(
    "check_date_gaps",
    "Q7 W12",
    f"""WITH {views("px_daily")}, w AS (SELECT series_id, date - lag(date) OVER (PARTITION BY series_id ORDER BY date) AS gap FROM px_daily),
g AS (SELECT series_id, COUNT(*) FILTER (WHERE gap > 10) AS bad, MAX(gap) AS longest FROM w GROUP BY series_id)
{chk("g", "px_daily", "series_id || ': no gap above 10 days'", "bad = 0", "bad || ' gaps; longest ' || longest || ' days'", "WARN")}""",
)
def check_date_gaps(spark, sf):
    return Q.check_date_gaps(I.px_daily(spark, sf), BY, 10, "px_daily")


@query(
    "gap_dates",
    "Q7 W12",
    f"""WITH {views("px_daily")}, w AS (SELECT series_id, lag(date) OVER (PARTITION BY series_id ORDER BY date) AS gap_from, date AS gap_to FROM px_daily)
SELECT *, CAST(gap_to - gap_from AS INTEGER) AS gap_days FROM w WHERE gap_to - gap_from > 3""",
)
def gap_dates(spark, sf):
    return P.gap_rows(I.px_daily(spark, sf), BY, 3)


@query(
    "check_coverage",
    "Q8",
    f"""WITH {CHANGES_SQL}, u AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, COUNT({c}) AS n, MIN(CASE WHEN {c} IS NOT NULL THEN month END) AS a, MAX(CASE WHEN {c} IS NOT NULL THEN month END) AS z FROM changes" for c in ("px_logret_m", "idx_logret_m", "fx_logret_m"))})
{chk("u", "changes", "c || ': months with a value'", None, "n || ' values; ' || a || ' to ' || z")}""",
)
def check_coverage(spark, sf):
    return Q.check_coverage(changes(spark, sf), ["px_logret_m", "idx_logret_m", "fx_logret_m"], "changes")


@query(
    "check_expected_nulls",
    "Q9",
    f"""WITH {CHANGES_SQL}, m AS (SELECT DISTINCT strftime(month, '%Y-%m-%d') AS m FROM changes WHERE idx_logret_m IS NULL),
g AS (SELECT coalesce(string_agg(m, ', ' ORDER BY m), 'none') AS m FROM m)
{chk("g", "changes", "'idx_logret_m is empty in exactly the known months'", "m = '1995-01-01, 2001-10-01'", "m")}""",
)
def check_expected_nulls(spark, sf):
    return Q.check_expected_nulls(changes(spark, sf), "idx_logret_m", ["1995-01-01", "2001-10-01"], "changes")


@query(
    "check_identity",
    "Q10",
    f"""WITH {CHANGES_SQL} {ident("changes", "abs((exp(px_logret_m) - 1) * 100 - px_pct_m) > 1e-9", "changes", "exp(log return) - 1 equals the percent change")}
UNION ALL {ident("changes", "abs(px_logret_m - fx_logret_m - px_fx_logret_m) > 1e-9", "changes", "other currency = price minus rate")}""",
)
def check_identity(spark, sf):
    c = changes(spark, sf)
    one = Q.check_identity(c, F.abs((F.exp("px_logret_m") - 1) * 100 - F.col("px_pct_m")) > 1e-9, "changes", "exp(log return) - 1 equals the percent change")
    gap = F.abs(F.col("px_logret_m") - F.col("fx_logret_m") - F.col("px_fx_logret_m"))
    return one.unionByName(Q.check_identity(c, gap > 1e-9, "changes", "other currency = price minus rate"))


@query(
    "check_equal",
    "Q11",
    f"""WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders), l AS (SELECT l_orderkey AS k, SUM(l_extendedprice) AS v FROM lineitem GROUP BY 1),
j AS (SELECT o.v AS x, l.v AS y, o.k AS ka, l.k AS kb FROM o FULL JOIN l ON l.k = o.k),
g AS (SELECT COUNT(*) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL) AS n, COUNT(*) FILTER (WHERE abs(x - y) > 1.0) AS bad, COUNT(*) FILTER (WHERE ka IS NULL OR kb IS NULL) AS lone FROM j)
{chk("g", "orders vs lineitem", "'both tables agree on every key'", "bad = 0 AND lone = 0", "bad || ' of ' || n || ' rows differ; ' || lone || ' on one side only'")}""",
)
def check_equal(spark, sf):
    o = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    li = I.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    return Q.check_equal(o, li, ["k"], ["v"], 1.0, "orders vs lineitem")


@query(
    "check_parts_total",
    "Q12",
    f"""WITH {views("supply")}, u AS (SELECT region, FALSE AS is_total, production AS v FROM supply UNION ALL SELECT region, TRUE, SUM(production) * CASE WHEN region = 2 THEN 1.05 ELSE 1.001 END FROM supply GROUP BY region),
g AS (SELECT *, abs(parts - total) * 100 / total AS gap FROM (SELECT region, SUM(CASE WHEN NOT is_total THEN v END) AS parts, MAX(CASE WHEN is_total THEN v END) AS total FROM u GROUP BY region))
{chk("g", "supply", "region || ': parts add up to the total (2% tolerance)'", "gap < 2", "'sum ' || printf('%.2f', parts) || ' vs total ' || printf('%.2f', total) || ' (' || printf('%.2f', gap) || '% apart)'", "WARN")}""",
)
def check_parts_total(spark, sf):
    s = I.supply(spark, sf)
    parts = s.select("region", F.lit(False).alias("is_total"), F.col("production").alias("v"))
    totals = s.groupBy("region").agg(F.sum("production").alias("t")).select(
        "region", F.lit(True).alias("is_total"), (F.col("t") * F.when(F.col("region") == 2, 1.05).otherwise(1.001)).alias("v")
    )
    return Q.check_parts_total(parts.unionByName(totals), ["region"], F.col("is_total"), "v", 2, "supply")


@query(
    "check_agreement",
    "Q13 J10",
    f"""WITH {RATIO_SQL}, g AS (SELECT a.pair_id, COUNT(*) AS months, corr(a.num_value, a.den_value) AS rr, AVG(abs(num_value - den_value) * 100 / den_value) AS mean_gap, MAX(abs(num_value - den_value) * 100 / den_value) AS max_gap FROM ratio a GROUP BY a.pair_id)
{chk("g", "px_monthly", "pair_id || ': two sources agree'", "mean_gap < 10", "months || ' overlapping months; correlation ' || printf('%.4f', rr) || '; mean gap ' || printf('%.2f', mean_gap) || '%; max gap ' || printf('%.2f', max_gap) || '%'", "WARN")}""",
)
def check_agreement(spark, sf):
    d = ratio(spark, sf)
    on = ["pair_id", "month"]
    return Q.check_agreement(d.select(*on, "num_value"), d.select(*on, "den_value"), on, ["pair_id"], "num_value", "den_value", 10, "px_monthly")


@query(
    "check_converted",
    "Q14",
    f"""WITH y AS (SELECT year(l_shipdate) AS yr, AVG(l_extendedprice / l_quantity) AS a, AVG(l_extendedprice) / AVG(l_quantity) / 22.0462 AS b FROM lineitem GROUP BY 1),
g AS (SELECT MAX(abs(b * 22.0462 - a) * 100 / a) AS worst, COUNT(*) AS n FROM y)
{chk("g", "lineitem", "'converted values agree'", "worst < 2", "n || ' periods; worst ' || printf('%.2f', worst) || '% apart'", "WARN")}""",
)
def check_converted(spark, sf):
    y = I.table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("yr")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("a"), (F.avg("l_extendedprice") / F.avg("l_quantity") / 22.0462).alias("b")
    )
    return Q.check_converted(y.select("yr", "b"), y.select("yr", "a"), ["yr"], "b", "a", 22.0462, 2, "lineitem")


@query(
    "check_revisions",
    "Q15",
    f"""WITH y AS (SELECT 'NATION_' || s_nationkey AS nation, SUM(CASE WHEN year(l_shipdate) = 1999 THEN l_quantity END) AS a, SUM(CASE WHEN year(l_shipdate) = 2000 THEN l_quantity END) AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
g AS (SELECT nation, printf('%.1f', (b - a) * 100 / a) AS t FROM y WHERE abs((b - a) * 100 / a) > 5)
{chk("g", "supply", "nation || ': revised by more than 5%'", None, "t || '%'")}""",
)
def check_revisions(spark, sf):
    li, su = I.table(spark, sf, "lineitem"), I.table(spark, sf, "supplier")
    y = F.year("l_shipdate")
    per = li.groupBy("l_suppkey").agg(F.sum(F.when(y == 1999, F.col("l_quantity"))).alias("a"), F.sum(F.when(y == 2000, F.col("l_quantity"))).alias("b"))
    n = per.join(su, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("nation")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return Q.check_revisions(n.select("nation", F.col("a").alias("v")), n.select("nation", F.col("b").alias("v")), "nation", "v", 5, "supply")


@query(
    "check_readings",
    "Q16",
    f"""WITH {views("supply")}, rd AS (SELECT country, floor(production / 500) * 500 AS reading FROM supply),
g AS (SELECT COUNT(*) FILTER (WHERE abs(s.production - rd.reading) * 100 / abs(rd.reading) > 2) AS bad, COUNT(*) AS n FROM rd JOIN supply s ON s.country = rd.country)
{chk("g", "supply", "'readings match the table (2% tolerance)'", "bad = 0", "bad || ' of ' || n || ' readings differ'", "WARN")}""",
)
def check_readings(spark, sf):
    s = I.supply(spark, sf)
    readings = s.select("country", (F.floor(F.col("production") / 500) * 500).cast("double").alias("reading"))
    return Q.check_readings(readings, s.select("country", F.col("production").alias("value")), ["country"], 2, "supply")


@query(
    "check_basis",
    "Q17",
    f"""WITH p AS (SELECT p_brand, MAX(CASE WHEN p_type = 'PROMO' THEN p_retailprice END) AS u, MAX(CASE WHEN p_type <> 'PROMO' THEN p_retailprice END) AS o FROM part GROUP BY p_brand),
g AS (SELECT COUNT(*) FILTER (WHERE abs((u - o) * 100 / o) > 1) AS bad, COUNT(*) AS n FROM p WHERE u IS NOT NULL AND o IS NOT NULL)
{chk("g", "part", "'two figures of one entity within 1%'", "bad = 0", "bad || ' of ' || n || ' entities differ'", "WARN")}""",
)
def check_basis(spark, sf):
    return Q.check_basis(I.table(spark, sf, "part"), "p_brand", F.col("p_type") == "PROMO", "p_retailprice", 1, "part")


def _profile_sql(src: str, w: str = "") -> str:
    t = "".join(
        f"SELECT 'column:{c}' AS grouping, 'ALL' AS key_value, COUNT(*) AS n_rows, COUNT({c}) AS n_values, COUNT(DISTINCT {c}) AS n_distinct, CAST(NULL AS DOUBLE) AS sum_value, CAST(NULL AS DOUBLE) AS min_num, CAST(NULL AS DOUBLE) AS max_num, MIN({c}) AS min_text, MAX({c}) AS max_text FROM {src} {w} UNION ALL "
        for c in ("o_orderstatus", "o_orderpriority")
    )
    n = "".join(
        f"SELECT 'column:{c}', 'ALL', COUNT(*), COUNT({c}), COUNT(DISTINCT {c}), SUM({c}), MIN({c}), MAX({c}), NULL, NULL FROM {src} {w} UNION ALL "
        for c in ("o_totalprice", "o_custkey")
    )
    g = f"SELECT 'group:o_orderstatus|o_orderpriority', o_orderstatus || '|' || o_orderpriority, COUNT(*), COUNT(o_totalprice), NULL, SUM(o_totalprice), NULL, NULL, NULL, NULL FROM {src} {w} GROUP BY o_orderstatus, o_orderpriority"
    return t + n + g


def orders_profile(df):
    return Q.profile(df, ["o_orderstatus", "o_orderpriority"], ["o_totalprice", "o_custkey"], [["o_orderstatus", "o_orderpriority"]], "o_totalprice")


@query(
    "profile",
    "G9 Q18",
    f"""SELECT grouping, key_value, n_rows, n_values, n_distinct, ROUND(sum_value, 2) + 0.0 AS sum_value, min_num, max_num, min_text, max_text FROM ({_profile_sql("orders")})""",
)
def profile(spark, sf):
    return orders_profile(I.table(spark, sf, "orders")).withColumn("sum_value", F.round("sum_value", 2) + 0.0)


def _diff_sql(a_where: str, b_where: str) -> str:
    return f"""WITH a AS ({_profile_sql("orders", a_where)}), b AS ({_profile_sql("orders", b_where)})
SELECT grouping, key_value, CASE WHEN b_n IS NULL THEN 'new' WHEN a_n IS NULL THEN 'missing' ELSE 'changed' END AS difference FROM (
  SELECT coalesce(a.grouping, b.grouping) AS grouping, coalesce(a.key_value, b.key_value) AS key_value, a.n_rows AS a_n, b.n_rows AS b_n,
    a.n_rows IS DISTINCT FROM b.n_rows OR a.n_values IS DISTINCT FROM b.n_values OR a.n_distinct IS DISTINCT FROM b.n_distinct OR abs(coalesce(a.sum_value, 0) - coalesce(b.sum_value, 0)) > 0.001
    OR a.min_num IS DISTINCT FROM b.min_num OR a.max_num IS DISTINCT FROM b.max_num OR a.min_text IS DISTINCT FROM b.min_text OR a.max_text IS DISTINCT FROM b.max_text AS differ
  FROM a FULL JOIN b ON a.grouping = b.grouping AND a.key_value = b.key_value) WHERE a_n IS NULL OR b_n IS NULL OR differ"""


_CHANGED = "o_orderstatus <> 'P' AND o_orderkey <> 7"


@query("profile_diff", "Q18 trap11", _diff_sql("", f"WHERE {_CHANGED}"))
def profile_diff(spark, sf):
    o = I.table(spark, sf, "orders")
    # Sums may differ in the last digits between two runs; the tolerance covers that.
    return Q.diff_profile(orders_profile(o), orders_profile(o.where(_CHANGED)))


@query(
    "frozen_baseline",
    "Q18 A7",
    chk(f"(SELECT COUNT(*) AS n FROM ({_diff_sql('', 'WHERE o_orderkey % 500 <> 3')}))", "orders", "'profile matches the frozen baseline'", "n = 0", "n || ' summaries differ'"),
)
def frozen_baseline(spark, sf):
    """A profile frozen as CSV, read back and compared with a later state of the table."""
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    o = I.table(spark, sf, "orders")
    old = orders_profile(o.where("o_orderkey % 500 <> 3"))
    store.export_csv({"orders": old}, path)
    frozen = store.read_baseline(spark, f"{path}/orders", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in old.schema))
    return Q.check_profile(orders_profile(o), frozen, "orders")


@query(
    "baseline_texts",
    "A7",
    "SELECT source, COUNT(*) AS n, md5(MIN(nullif(text, ''))) AS first_md5, md5(MAX(nullif(text, ''))) AS last_md5, CAST(COUNT(*) FILTER (WHERE lang IS NULL) AS BIGINT) AS no_lang, CAST(NULL AS VARCHAR) AS note FROM documents GROUP BY source",
)
def baseline_texts(spark, sf):
    """A profile with whole texts as cells, frozen as CSV and read back: line breaks and quotes stay, only a blank cell is NULL."""
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    told = I.table(spark, sf, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.nullif("text", F.lit(""))).alias("first"), F.max(F.nullif("text", F.lit(""))).alias("last"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.lit("").alias("note"),
    )
    store.export_csv({"texts": told}, path)
    got = store.read_baseline(spark, f"{path}/texts", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.schema))
    return got.select("source", "n", F.md5("first").alias("first_md5"), F.md5("last").alias("last_md5"), "no_lang", "note")


@query(
    "check_complete_grid",
    "Q19",
    f"""WITH {GRID_SQL}, g AS (SELECT COUNT(*) AS n_rows, COUNT(DISTINCT (nation, year, path_method, new_case, old_case, growth_case)) AS cases FROM grid)
{chk("g", "grid", "'2700 cases, each once'", "n_rows = 2700 AND cases = 2700", "n_rows || ' rows; ' || cases || ' cases'")}""",
)
def check_complete_grid(spark, sf):
    return Q.check_complete_grid(grid(spark, sf), ["nation", "year", "path_method", "new_case", "old_case", "growth_case"], 2700, "grid")


@query(
    "check_ordered",
    "Q20 Q21",
    f"""WITH p AS (SELECT p_brand, MIN(p_retailprice) AS low, AVG(p_retailprice) AS mid, MAX(p_retailprice) AS high, CASE WHEN MIN(p_size) > 1 THEN 'note' END AS note, MIN(p_size) AS s FROM part GROUP BY p_brand)
{ident("p", "low > mid OR mid > high", "part", "low <= mid <= high")} UNION ALL {ident("p", "s > 1 AND NOT coalesce(note IS NOT NULL, FALSE)", "part", "a larger smallest size carries a note")}""",
)
def check_ordered(spark, sf):
    p = I.table(spark, sf, "part").groupBy("p_brand").agg(
        F.min("p_retailprice").alias("low"), F.avg("p_retailprice").alias("mid"), F.max("p_retailprice").alias("high"),
        F.when(F.min("p_size") > 1, "note").alias("note"), F.min("p_size").alias("s"),
    )
    a = Q.check_ordered(p, "low", "mid", "high", "part")
    return a.unionByName(Q.check_implies(p, F.col("s") > 1, F.col("note").isNotNull(), "part", "a larger smallest size carries a note"))


@query(
    "check_mapping",
    "Q22 J8",
    f"""WITH m AS (SELECT n_nationkey AS nation FROM nation),
g AS (SELECT COUNT(*) AS n FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT nation FROM m)))
{chk("g", "customer", "'every nation has a mapping'", "n = 0", "n || ' without a mapping'")} UNION ALL {ident("part", "NOT regexp_full_match(p_brand, 'Brand#[0-9]{1,2}')", "part", "p_brand is well formed")}""",
)
def check_mapping(spark, sf):
    names = I.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    m = I.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"))
    a = Q.check_mapping(names, m, "nation", "customer")
    return a.unionByName(Q.check_pattern(I.table(spark, sf, "part"), "p_brand", r"\ABrand#[0-9]{1,2}\z", "part"))


@query(
    "check_fk",
    "Q23",
    f"""WITH u AS (SELECT CASE WHEN l_orderkey % 1000 = 1 THEN NULL ELSE l_partkey END AS id FROM lineitem), k AS (SELECT p_partkey AS id FROM part),
g AS (SELECT (SELECT COUNT(DISTINCT id) FROM u WHERE id NOT IN (SELECT id FROM k)) AS unknown, (SELECT COUNT(*) FROM u WHERE id IS NULL) AS empty_)
{chk("g", "lineitem", "'every id exists in the register'", "unknown = 0 AND empty_ = 0", "unknown || ' unknown ids; ' || empty_ || ' rows without one'")}""",
)
def check_fk(spark, sf):
    u = I.table(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 1000 != 1, F.col("l_partkey")).alias("id"))
    k = I.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return Q.check_fk(u, k, "id", "lineitem")


@query("unused_ids", "Q23", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def unused_ids(spark, sf):
    reg = I.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return Q.unused_ids(reg, [I.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))], "id")


@query(
    "check_episode",
    "Q24",
    f"""WITH {MONTHS_SQL}, o AS (SELECT *, n - lag(n) OVER (PARTITION BY pair_id, rule_id, horizon ORDER BY n) AS gap FROM months WHERE signal_on = 1),
g AS (SELECT 'episode gaps' AS d, COUNT(*) FILTER (WHERE gap IS NOT NULL AND ((is_episode_start = 0 AND gap > horizon) OR (is_episode_start = 1 AND gap <= horizon))) AS n FROM o
  UNION ALL SELECT 'id exactly when on', COUNT(*) FILTER (WHERE (signal_on = 1) <> (episode_id IS NOT NULL)) FROM months)
{chk("g", "signal_months", "d", "n = 0", "n || ' violations'")}""",
)
def check_episode(spark, sf):
    return Q.check_episode(months_of_signal(spark, sf), ["pair_id", "rule_id", "horizon"], "_n", "signal_months")


@query(
    "check_percentile",
    "Q24",
    f"""WITH {MART_SQL}, d AS (SELECT n, pctile_all_past AS p, ratio AS v, MAX(ratio) OVER w AS hi, MIN(ratio) OVER w AS lo FROM mart WINDOW w AS (PARTITION BY pair_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT COUNT(*) FILTER (WHERE (n <= {WARMUP} AND p IS NOT NULL) OR (n > {WARMUP} AND p IS NULL) OR p < 0 OR p > 100 OR (v > hi AND p <> 100) OR (v < lo AND p <> 0)) AS n FROM d)
{chk("g", "ratio_mart", "'percentile bounds, warm-up, new highs and lows'", "n = 0", "n || ' violations'")}""",
)
def check_percentile(spark, sf):
    return Q.check_percentile(mart(spark, sf), ["pair_id"], "ratio", "pctile_all_past", WARMUP, "ratio_mart")


@query(
    "check_same_sample",
    "Q25",
    f"""WITH {MONTHS_SQL}, p AS (SELECT pair_id, horizon, MIN(n) AS a, MAX(n) AS z FROM (SELECT pair_id, horizon, rule_id, COUNT(*) AS n FROM months GROUP BY ALL) GROUP BY ALL),
g AS (SELECT horizon, COUNT(*) FILTER (WHERE a <> z) AS bad, COUNT(*) AS n FROM p GROUP BY horizon)
{chk("g", "signal_months", "horizon || 'm: common sample across rules'", "bad = 0", "bad || ' of ' || n || ' keys differ'")}""",
)
def check_same_sample(spark, sf):
    return Q.check_same_sample(months_of_signal(spark, sf), "horizon", "rule_id", ["pair_id"], "signal_months")


@query(
    "check_forward",
    "Q26",
    f"""WITH {MART_SQL}, j AS (SELECT m.ratio_fwd_6m_pct AS f, (l.ratio / m.ratio - 1) * 100 AS again FROM mart m JOIN ratio l ON l.pair_id = m.pair_id AND l.month = m.month + INTERVAL 6 MONTH)
{ident("j", "abs(again - f) > 1e-9", "ratio_mart", "ratio_fwd_6m_pct matches the self join")}""",
)
def check_forward(spark, sf):
    d = P.forward_changes(ratio(spark, sf), ["ratio"], [6], ["pair_id"])
    return Q.check_forward(d, ["pair_id"], "ratio", "ratio_fwd_6m_pct", 6, 1e-9, "ratio_mart")


@query(
    "check_figures",
    "Q27",
    f"""WITH y AS (SELECT 'F' || n_nationkey AS figure_id, CAST(COUNT(c_custkey) AS DOUBLE) AS computed, n_name AS computed_text FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT figure_id, CASE WHEN computed > 0 THEN 60.0 END AS expected, computed, 10.0 AS tolerance, CASE WHEN figure_id IN ('F3', 'F4') THEN 'NATION_3' END AS expected_text, computed_text,
  CASE WHEN CASE WHEN figure_id IN ('F3', 'F4') THEN computed_text = 'NATION_3' ELSE abs(computed - 60.0) <= 10.0 END THEN 'PASS' ELSE 'FAIL' END AS status FROM y""".replace("60.0 END", "CAST(60.0 AS DOUBLE) END").replace("10.0 AS tolerance", "CAST(10.0 AS DOUBLE) AS tolerance"),
)
def check_figures(spark, sf):
    n, c = I.table(spark, sf, "nation"), I.table(spark, sf, "customer")
    counts = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("k"))
    y = n.join(counts, "n_nationkey", "left").select(
        F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("figure_id"), F.coalesce("k", F.lit(0)).cast("double").alias("computed"), F.col("n_name").alias("computed_text")
    )
    rows = y.select(
        "figure_id", F.when(F.col("computed") > 0, 60.0).alias("expected"), "computed", F.lit(10.0).alias("tolerance"),
        F.when(F.col("figure_id").isin("F3", "F4"), "NATION_3").alias("expected_text"), "computed_text",
    )
    return Q.check_figures(rows)


@query(
    "issues_to_checks",
    "Q28",
    """SELECT 'supplier' AS table_name, 'known issue K' || s_suppkey || ' (' || st || '): balance ' || sg AS description, CASE WHEN st = 'unresolved' THEN 'WARN' ELSE 'INFO' END AS status, 'source S' || s_nationkey || '; ' || s_name AS detail
FROM (SELECT *, CASE WHEN s_acctbal < 0 THEN 'unresolved' ELSE 'limitation' END AS st, CASE WHEN s_acctbal < 0 THEN 'negative' ELSE 'positive' END AS sg FROM supplier)""",
)
def issues_to_checks(spark, sf):
    neg = F.col("s_acctbal") < 0
    issues = I.table(spark, sf, "supplier").select(
        F.lit("supplier").alias("table_name"), F.concat(F.lit("K"), F.col("s_suppkey").cast("string")).alias("issue_id"),
        F.when(neg, "unresolved").otherwise("limitation").alias("status"), F.when(neg, "balance negative").otherwise("balance positive").alias("description"),
        F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("source_id"), F.col("s_name").alias("note"),
    )
    return Q.issues_to_checks(issues)


@query(
    "check_rejects",
    "Q29 B9",
    f"""WITH {views("raw_text")}, g AS (SELECT COUNT(*) FILTER (WHERE ({snum("value_raw")}) IS NULL) AS bad, COUNT(*) AS n FROM raw_text)
{chk("g", "raw_text", "'raw rows dropped in cleaning'", None, "bad || ' of ' || n || ' raw rows (' || printf('%.2f', bad * 100.0 / n) || '%)'")}""",
)
def check_rejects(spark, sf):
    return Q.check_rejects(I.raw_text(spark, sf), C.strict_double(F.col("value_raw")).isNotNull(), "raw_text")


@query(
    "check_reconcile",
    "Q30 T23",
    f"""WITH {LINK_SQL}, c AS (SELECT series_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE px * idx < 0) AS o, COUNT(*) FILTER (WHERE px * idx > 0) AS s, COUNT(*) FILTER (WHERE px = 0 OR idx = 0) AS u FROM pairs_ok GROUP BY 1)
{ident("c", "o + s + u <> n", "direction_counts", "opposite + same + unchanged = n, shares equal their counts")}""",
)
def check_reconcile(spark, sf):
    d = T.direction_counts(link(spark, sf), "px", "idx", BY)
    return Q.check_reconcile(d, BY, ["opposite", "same", "unchanged"], "n", {"opposite_pct": ("opposite", "n"), "a_fell_when_b_rose_pct": ("a_fell_when_b_rose", "b_rose")}, "direction_counts")


@query(
    "check_samples",
    "Q31",
    f"""WITH {CHANGES_SQL}, a AS (SELECT series_id, MIN(month) AS a, MAX(month) AS z, COUNT(*) AS n FROM changes WHERE px_logret_m IS NOT NULL AND idx_logret_m IS NOT NULL GROUP BY 1),
b AS (SELECT series_id, MIN(month) AS a, MAX(month) AS z, COUNT(*) AS n FROM changes WHERE px_pct_m IS NOT NULL AND fx_pct_m IS NOT NULL GROUP BY 1), j AS (SELECT a.series_id, a.a <> b.a OR a.z <> b.z OR a.n <> b.n AS bad FROM a JOIN b USING (series_id))
{ident("j", "bad", "changes", "result tables share one sample")}""",
)
def check_samples(spark, sf):
    c = changes(spark, sf)
    return Q.check_samples({"log": T.complete(c, ["px_logret_m", "idx_logret_m"]), "pct": T.complete(c, ["px_pct_m", "fx_pct_m"])}, BY, "changes")


@query(
    "compare_results",
    "Q33",
    f"""WITH {RATIO_SQL}, a AS (SELECT pair_id, month, ratio, num_value FROM ratio WHERE n > 1), b AS (SELECT pair_id, month, CASE WHEN n % 40 = 0 THEN ratio + 0.02 ELSE ratio END AS ratio, num_value FROM ratio),
j AS (SELECT a.pair_id AS ka, b.pair_id AS kb, abs(a.ratio - b.ratio) > 0.01 AS d1, abs(a.num_value - b.num_value) > 0.01 AS d2 FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.month = b.month),
g AS (SELECT COUNT(*) FILTER (WHERE ka IS NOT NULL AND kb IS NOT NULL) AS compared, COUNT(*) FILTER (WHERE ka IS NULL OR kb IS NULL) AS one_side_only, COUNT(*) FILTER (WHERE d1) AS d1, COUNT(*) FILTER (WHERE d2) AS d2 FROM j)
SELECT compared, one_side_only, 'ratio' AS "column", d1 AS differ FROM g UNION ALL SELECT compared, one_side_only, 'num_value', d2 FROM g""",
)
def compare_results(spark, sf):
    d = C.with_position(ratio(spark, sf), ["pair_id"], "month")
    other = d.withColumn("ratio", F.when(F.col("n") % 40 == 0, F.col("ratio") + 0.02).otherwise(F.col("ratio")))
    return Q.compare_results(d.where("n > 1"), other, ["pair_id", "month"], ["ratio", "num_value"], 0.01)


@query(
    "check_period_end",
    "Q35",
    f"WITH {views('px_monthly')} {ident('px_monthly', '''date_trunc('month', last_day) <> month OR day(last_day) < 24''', 'px_monthly', 'month-end date in its month, day 24 or later')}",
)
def check_period_end(spark, sf):
    return Q.check_period_end(I.px_monthly(spark, sf), "month", "last_day", 24, "px_monthly")


META = [("orders", "staging", "one row per order"), ("lineitem", "staging", "one row per line"), ("events", "raw", "one row per event"), ("nation", "register", "one row per nation")]
DATES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


@query(
    "catalog",
    "Q34 B16",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{k}' AS kind, '{g}' AS grain, COUNT(*) AS n_rows, "
        + (f"CAST(MIN({DATES[t]}) AS DATE) AS date_from, CAST(MAX({DATES[t]}) AS DATE) AS date_to" if t in DATES else "CAST(NULL AS DATE) AS date_from, CAST(NULL AS DATE) AS date_to")
        + f" FROM {t}"
        for t, k, g in META
    ),
)
def catalog(spark, sf):
    meta = TB.inline_rows(spark, META, "table_name string, kind string, grain string")
    return Q.catalog({t: I.table(spark, sf, t) for t, _, _ in META}, meta, DATES)


def report(spark, sf):
    """All checks of a small build, as one numbered report; what a check needs is looked up before it is built."""
    folder = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    store.save_tables({"prices_daily": store.stub(spark, "day date, price double")}, folder)
    paths = {t: f"{sf}/{t}.parquet" for t in ("orders", "lineitem", "events")} | {t: f"{folder}/{t}" for t in ("licensed_daily", "prices_daily")}
    orders, li = I.table(spark, sf, "orders"), I.table(spark, sf, "lineitem")
    licensed = lambda t: lambda: Q.check_unique(spark.read.parquet(paths[t]), ["day"], t)
    blocks = [
        ("orders unique", ["orders_data"], Q.check_unique(orders, ["o_orderkey"], "orders")),
        ("lines unique", ["lineitem_data"], Q.check_unique(li, ["l_orderkey", "l_linenumber"], "lineitem")),
        ("licensed daily data", ["licensed_daily"], licensed("licensed_daily")),
        ("daily prices", ["prices_daily", "prices_daily_data"], licensed("prices_daily")),
        ("events range", ["events"], Q.check_range(I.table(spark, sf, "events"), "event_type", "value", LIMITS, "events")),
        ("priorities", ["orders"], Q.check_pattern(orders, "o_orderpriority", r"\A[1-5]-", "orders")),
    ]
    return Q.run_checks(spark, blocks, store.available(spark, paths), "2026-01-01")


_U = "(SELECT COUNT(*) AS n FROM (SELECT 1 FROM {t} GROUP BY {k} HAVING COUNT(*) > 1))"
REPORT_SQL = f"""lim AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {a}, {z})" for k, (a, z) in LIMITS.items())}) t(k, a, z)),
er AS (SELECT event_type, COUNT(*) FILTER (WHERE value < a OR value > z) AS bad, MIN(value) AS lo, MAX(value) AS hi FROM events JOIN lim ON k = event_type GROUP BY event_type),
rep AS (SELECT 1 AS b, * FROM ({chk(_U.format(t="orders", k="o_orderkey"), "orders", "'no duplicate (o_orderkey)'", "n = 0", "n || ' duplicated keys'")})
  UNION ALL SELECT 2, * FROM ({chk(_U.format(t="lineitem", k="l_orderkey, l_linenumber"), "lineitem", "'no duplicate (l_orderkey, l_linenumber)'", "n = 0", "n || ' duplicated keys'")})
  UNION ALL SELECT 3, 'optional checks', 'skipped: licensed daily data', 'INFO', 'needs licensed_daily, which is not present'
  UNION ALL SELECT 4, 'optional checks', 'skipped: daily prices', 'INFO', 'needs prices_daily_data, which is not present'
  UNION ALL SELECT 5, * FROM ({chk("er", "events", "event_type || ': values inside the plausible range'", "bad = 0", "'min ' || printf('%.2f', lo) || ', max ' || printf('%.2f', hi)", "WARN")})
  UNION ALL SELECT 6, * FROM ({ident("orders", "NOT regexp_matches(o_orderpriority, '^[1-5]-')", "orders", "o_orderpriority is well formed")})),
report AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY b, table_name, description) AS INTEGER) AS check_no, table_name, description, status, detail, '2026-01-01' AS run_date FROM rep)"""


@query("run_checks", "Q1 Q2", f"WITH {REPORT_SQL} SELECT * FROM report")
def run_checks(spark, sf):
    return report(spark, sf)


@query("status_summary", "Q32", f"WITH {REPORT_SQL} SELECT status, COUNT(*) AS n FROM report GROUP BY status")
def status_summary(spark, sf):
    return Q.status_summary(report(spark, sf))


@query(
    "redact",
    "V2",
    f"WITH {REPORT_SQL} SELECT check_no, status, CASE WHEN (table_name LIKE '%event%' OR description LIKE '%licensed%') AND NOT description LIKE 'click%' THEN 'details withheld' ELSE detail END AS detail FROM report",
)
def redact(spark, sf):
    hide = F.col("table_name").contains("event") | F.col("description").contains("licensed")
    return G.redact(report(spark, sf), hide, F.col("description").startswith("click"), "details withheld").select("check_no", "status", "detail")


@query(
    "trim_restricted",
    "V3 A15 V1",
    "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE NOT contains(c_mktsegment, 'MACH')",
)
def trim_restricted(spark, sf):
    out = G.trim_restricted(I.table(spark, sf, "customer"), ["c_acctbal"], F.col("c_mktsegment").contains("MACH"))
    return G.assert_no_columns(out, ["c_acctbal"], "customer")


_HIT = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS pattern, unnest(regexp_extract_all(text, '{p}')) AS match FROM documents" for n, p in G.LEAK_PATTERNS.items()
)


@query(
    "scan_text",
    "V4",
    f"WITH h AS ({_HIT}) SELECT pattern, match, COUNT(DISTINCT doc_id) AS n_rows, COUNT(*) AS n_hits FROM h GROUP BY pattern, match",
)
def scan_text(spark, sf):
    return G.scan_text(I.table(spark, sf, "documents"), "text")


MANIFEST = [("orders", "S1; S2", True), ("lineitem", "S1", False), ("nation", "", False)]


@query(
    "check_manifest",
    "V5",
    f"""WITH c AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t, _, _ in META)}),
m AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{s}', {str(ok).upper()})" for t, s, ok in MANIFEST)}) t(table_name, sources, large_ok))
SELECT c.table_name, n_rows, CASE WHEN sources IS NULL THEN 'not in the manifest' WHEN sources = '' THEN 'no sources' WHEN n_rows >= 100 AND NOT large_ok THEN 'large and not approved' ELSE 'ok' END AS finding
FROM c LEFT JOIN m ON m.table_name = c.table_name""",
)
def check_manifest(spark, sf):
    man = TB.inline_rows(spark, MANIFEST, "table_name string, sources string, large_ok boolean")
    return G.check_manifest(catalog(spark, sf), man)


DATASETS = [("page.orders", "orders", "job a"), ("page.lines", "lineitem", "job a"), ("page.events", "events", "job b"), ("page.nations", "nation", "job b")]


def datasets(spark):
    return TB.inline_rows(spark, DATASETS, "dataset string, table_name string, writer string")


def prov(spark, checks):
    man = TB.inline_rows(spark, MANIFEST, "table_name string, sources string, large_ok boolean")
    return G.provenance(datasets(spark), man, checks)


PROV_SQL = REPORT_SQL + f""",
ds AS (SELECT * FROM (VALUES {", ".join(str(d) for d in DATASETS)}) t(dataset, table_name, writer)),
m AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{s}', {str(ok).upper()})" for t, s, ok in MANIFEST)}) t(table_name, sources, large_ok)),
prov AS (SELECT dataset, ds.table_name, writer, m.sources, COUNT(check_no) AS n_checks, COUNT(CASE WHEN status <> 'INFO' THEN 1 END) AS n_judged,
    md5(coalesce(string_agg(check_no || '|' || description || '|' || status, chr(10) ORDER BY check_no), '')) AS checks_md5
  FROM ds LEFT JOIN m ON m.table_name = ds.table_name LEFT JOIN report ON report.table_name = ds.table_name GROUP BY ALL)"""


@query("provenance", "V6", f"WITH {PROV_SQL} SELECT * FROM prov")
def provenance(spark, sf):
    line = lambda c: F.concat_ws("|", c["check_no"].cast("string"), c["description"], c["status"])
    told = prov(spark, report(spark, sf))
    return told.select(*[c for c in told.columns if c != "checks"], F.md5(F.array_join(F.transform("checks", line), "\n")).alias("checks_md5"))


@query(
    "check_provenance",
    "V7",
    f"""WITH {PROV_SQL} SELECT dataset, 'cited check not shown' AS finding, COUNT(*) AS n FROM ds JOIN report USING (table_name) WHERE check_no = 1 GROUP BY dataset
UNION ALL SELECT dataset, 'no judged check', 1 FROM prov WHERE n_judged = 0""",
)
def check_provenance(spark, sf):
    # The shown list lacks the first check, so its citation must be found.
    checks = cut_lineage(report(spark, sf))
    return G.check_provenance(G.cited_checks(datasets(spark), checks), prov(spark, checks), checks.where("check_no <> 1"))
