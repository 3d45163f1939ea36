"""Cleaning and layout queries over text cells and sheet cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.operators import layout as L
from tidemark.operators import tables as TB
from tidemark.plans import inputs as I
from tidemark.plans.inputs import views
from tidemark.queries.common import r, rounded
from tidemark.queries.registry import query

NUM = "regexp_matches({c}, '[0-9]') AND NOT regexp_matches({c}, '[^0-9.eE+-]')"
SNUM = f"CASE WHEN {NUM} THEN TRY_CAST({{c}} AS DOUBLE) END"


def snum(c: str) -> str:
    return SNUM.format(c=c)


@query(
    "strict_numbers",
    "B1 trap1",
    f"""WITH {views("raw_text")}
SELECT value_raw, COUNT(*) AS n, MAX({snum("value_raw")}) AS value FROM raw_text GROUP BY value_raw""",
)
def strict_numbers(spark, sf):
    return I.raw_text(spark, sf).groupBy("value_raw").agg(
        F.count(F.lit(1)).alias("n"), F.max(C.strict_double(F.col("value_raw"))).alias("value")
    )


@query(
    "period_parse",
    "B2 A10",
    f"""WITH {views("raw_text")}
SELECT CASE WHEN regexp_full_match(period_raw, '[0-9]{{4}}M[01][0-9]') THEN TRY_CAST(substr(period_raw, 1, 4) || '-' || substr(period_raw, 6, 2) || '-01' AS DATE) END AS month,
  COUNT(*) AS n, COUNT(*) FILTER (WHERE trim(value_raw) IN ('', '.')) AS blanks FROM raw_text GROUP BY 1""",
)
def period_parse(spark, sf):
    return I.raw_text(spark, sf).groupBy(C.parse_period(F.col("period_raw")).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.trim("value_raw").isin("", ".")).alias("blanks")
    )


@query(
    "iso_dates",
    "B3",
    """SELECT CASE WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(t AS DATE) END AS date, COUNT(*) AS n
FROM (SELECT CASE WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders) GROUP BY 1""",
)
def iso_dates(spark, sf):
    o = I.table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 13 == 0, F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return o.select(C.parse_iso_date(text).alias("date")).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dmy_dates",
    "B4",
    """SELECT TRY_CAST(try_strptime(CASE WHEN regexp_full_match(t, '[0-3][0-9] [A-Z][a-z][a-z] [12][0-9]{3}') THEN t END, '%d %b %Y') AS DATE) AS date, COUNT(*) AS n
FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'Averages' ELSE strftime(o_orderdate, '%d %b %Y') END AS t FROM orders) GROUP BY 1""",
)
def dmy_dates(spark, sf):
    o = I.table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 11 == 0, "Averages").otherwise(
        F.date_format(F.col("o_orderdate").cast("date"), "dd MMM yyyy")
    )
    return o.select(C.parse_dmy(text).alias("date")).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "printed_numbers",
    "B5 B6 B7 B16",
    f"""SELECT c_custkey, printed, trim(unit_raw, '() ') AS unit, {snum("replace(printed, ',', '')")} AS value,
  CASE WHEN regexp_full_match(year_text, '[0-9]{{4}}') THEN CAST(year_text AS INTEGER) END AS year
FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'W' WHEN c_custkey % 9 = 0 THEN '--'
    ELSE format('{{:,}}', CAST(floor(c_acctbal) AS BIGINT)) END AS printed,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '($/' || lower(c_mktsegment) || ')' END AS unit_raw,
  CASE WHEN c_custkey % 4 = 0 THEN '2021-24' ELSE CAST(1990 + c_custkey % 30 AS VARCHAR) END AS year_text FROM customer)""",
)
def printed_numbers(spark, sf):
    k = F.col("c_custkey")
    raw = I.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(k % 7 == 0, "W").when(k % 9 == 0, "--").otherwise(C.fmt_thousands(F.floor("c_acctbal"))).alias("printed"),
        F.when(k % 5 != 0, F.concat(F.lit("($/"), F.lower("c_mktsegment"), F.lit(")"))).alias("unit_raw"),
        F.when(k % 4 == 0, "2021-24").otherwise((1990 + k % 30).cast("string")).alias("year_text"),
    )
    return raw.select(
        "c_custkey", "printed", C.trim_chars(F.col("unit_raw")).alias("unit"),
        C.parse_printed_number(F.col("printed")).alias("value"), C.parse_year(F.col("year_text")).alias("year"),
    )


@query(
    "dedup_last",
    "B10 J7",
    """SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, l_quantity FROM lineitem
QUALIFY ROW_NUMBER() OVER (PARTITION BY l_partkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC) = 1""",
)
def dedup_last(spark, sf):
    li = I.table(spark, sf, "lineitem").select(
        "l_partkey", F.col("l_shipdate").cast("date").alias("day"), "l_orderkey", "l_linenumber", "l_quantity"
    )
    tagged = li.withColumn("_order", F.struct("l_orderkey", "l_linenumber", "l_quantity"))
    return C.dedup_last(tagged, ["l_partkey", "day"], "_order").drop("_order")


@query(
    "reject_report",
    "B9 Q29",
    f"""WITH {views("raw_text")}, t AS (SELECT value_raw, {snum("value_raw")} AS v FROM raw_text)
SELECT value_raw AS rejected, COUNT(*) AS n, {r("COUNT(*) * 100.0 / (SELECT COUNT(*) FROM t)")} AS share_pct FROM t WHERE v IS NULL GROUP BY value_raw""",
)
def reject_report(spark, sf):
    raw = I.raw_text(spark, sf)
    counted = raw.groupBy("value_raw").agg(F.count(F.lit(1)).alias("n"))
    _, rejects = C.split_valid(counted, C.strict_double(F.col("value_raw")).isNotNull())
    total = counted.agg(F.sum("n")).scalar()
    return rounded(rejects.select(F.col("value_raw").alias("rejected"), "n", (F.col("n") * 100.0 / total).alias("share_pct")))


@query(
    "flag_latest",
    "B8 J12",
    """WITH y AS (SELECT year(o_orderdate) AS yr, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT CAST(yr AS INTEGER) AS yr, n, CASE WHEN yr = (SELECT MAX(yr) FROM y) THEN 1 ELSE 0 END AS is_estimate FROM y""",
)
def flag_latest(spark, sf):
    y = I.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    return C.flag_latest(y, "yr")


@query(
    "stack_series",
    "B11 B12 K4",
    """SELECT 'orders' AS series_id, CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'shipments', CAST(l_shipdate AS DATE), COUNT(*) FROM lineitem GROUP BY ALL
UNION ALL SELECT 'events', CAST(ts AS DATE), COUNT(*) FROM events GROUP BY ALL""",
)
def stack_series(spark, sf):
    def daily(t, c):
        return I.table(spark, sf, t).groupBy(F.col(c).cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))

    frames = {"orders": daily("orders", "o_orderdate"), "shipments": daily("lineitem", "l_shipdate"), "events": daily("events", "ts")}
    return C.stack_series(frames, ["date", "n"])


@query(
    "classify_text",
    "B13 B14",
    """SELECT metric, shade, COUNT(*) AS n FROM (SELECT CASE WHEN lower(p_name) LIKE '%widget%' THEN 'Widget'
  WHEN lower(p_name) LIKE '%ring%' THEN 'Ring' WHEN lower(p_name) LIKE '%gear%' THEN 'Gear' ELSE 'Other' END AS metric,
  CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'warm' WHEN 'blue' THEN 'cold' ELSE split_part(p_name, ' ', 1) END AS shade FROM part) GROUP BY ALL""",
)
def classify_text(spark, sf):
    p = I.table(spark, sf, "part")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    return p.select(
        C.classify(F.col("p_name"), [("widget", "Widget"), ("ring", "Ring"), ("gear", "Gear")], "Other").alias("metric"),
        C.map_values(first, {"red": "warm", "blue": "cold"}).alias("shade"),
    ).groupBy("metric", "shade").agg(F.count(F.lit(1)).alias("n"))


@query(
    "plain_text",
    "B15",
    """SELECT doc_id, lang, md5(replace(replace(text, '—', ', '), '–', '-')) AS text_md5 FROM documents""",
)
def plain_text(spark, sf):
    d = C.plain_text(I.table(spark, sf, "documents").select("doc_id", "lang", "text"))
    return d.select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query(
    "format_values",
    "B16 B17",
    """SELECT s_suppkey, printf('%.2f', s_acctbal) AS fixed_text, lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS code,
  format('{:,}', CAST(floor(s_acctbal) AS BIGINT)) AS thousands, ROUND(s_acctbal, 1) + 0.0 AS s_acctbal FROM supplier""",
)
def format_values(spark, sf):
    s = I.table(spark, sf, "supplier").select(
        "s_suppkey", C.fmt_fixed(F.col("s_acctbal"), 2).alias("fixed_text"), C.zero_padded(F.col("s_nationkey"), 3).alias("code"),
        C.fmt_thousands(F.floor("s_acctbal")).alias("thousands"), "s_acctbal",
    )
    return C.round_cols(s, {"s_acctbal": 1})


YEARS = {letter: f"y{year}" for year, letter in I.SHEET_YEARS.items()}
# A label without numbers opens a block; blocks are numbered by counting openings, and what holds for a block is a window over it.
SECTION_SQL = views("cells") + f""",
lines_ AS (SELECT excel_row, any_value(value_text) FILTER (excel_col = 'B') AS label,
    {", ".join(f"CAST(any_value(value_text) FILTER (excel_col = '{c}' AND cell_type = 'n') AS DOUBLE) AS {n}" for c, n in YEARS.items())},
    count(*) FILTER (cell_type = 'n') = 0 AND NOT starts_with(label, '*') AS opens
  FROM cells GROUP BY excel_row HAVING label IS NOT NULL),
numbered AS (SELECT *, count(*) FILTER (opens) OVER (ORDER BY excel_row) AS block FROM lines_),
blocks AS (SELECT *, max(label) FILTER (opens) OVER b AS section, min(excel_row) FILTER (opens) OVER b AS section_row,
    min(excel_row) FILTER (label = '{I.SHEET_MARKER}' AND NOT opens) OVER b AS marker_row
  FROM numbered WINDOW b AS (PARTITION BY block)),
sections AS (SELECT * EXCLUDE (opens, block), if(marker_row <= excel_row, 'part', 'all') AS basis FROM blocks
  WHERE NOT opens AND coalesce({", ".join(YEARS.values())}) IS NOT NULL)"""


def sections(spark, sf):
    rows = L.tag_header_rows(L.grid_to_rows(I.cells(spark, sf), "B", YEARS), list(YEARS.values()))
    return L.fill_section(rows).where(F.col("has_number") == 1)


@query(
    "grid_sections",
    "P1 P2 P3 J6",
    f"WITH {SECTION_SQL} SELECT excel_row, label, section, section_row, {', '.join(YEARS.values())} FROM sections",
)
def grid_sections(spark, sf):
    return sections(spark, sf).select("excel_row", "label", "section", "section_row", *YEARS.values())


@query("grid_switch", "P4", f"WITH {SECTION_SQL} SELECT excel_row, label, section, basis FROM sections")
def grid_switch(spark, sf):
    out = L.fill_switch(sections(spark, sf), F.col("label") == I.SHEET_MARKER, "all", "part", "basis")
    return out.select("excel_row", "label", "section", "basis")


@query(
    "unpivot_years",
    "P5",
    f"""WITH {SECTION_SQL} SELECT excel_row, label, section, CAST(substr(y, 2) AS INTEGER) AS year, v AS value
FROM (UNPIVOT sections ON {", ".join(YEARS.values())} INTO NAME y VALUE v)""",
)
def unpivot_years(spark, sf):
    return L.unpivot_years(sections(spark, sf), ["excel_row", "label", "section"], {n: int(n[1:]) for n in YEARS.values()})


COLMAP = {letter: ("known" if year < 1998 else "expected", year) for year, letter in I.SHEET_YEARS.items()}


@query(
    "column_map",
    "P6",
    f"""WITH {views("cells")}, m AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{a}', {y})" for c, (a, y) in COLMAP.items())}) t(excel_col, "case", year))
SELECT sheet, excel_row, "case", year, CAST(value_text AS DOUBLE) AS value FROM cells JOIN m USING (excel_col) WHERE cell_type = 'n'""",
)
def column_map(spark, sf):
    return L.map_columns(I.cells(spark, sf), COLMAP)


HEADERS = {(1, "B"): f"{I.SHEET_HEADING}AFRICA", (21, "B"): f"{I.SHEET_HEADING}AMERICA", (41, "B"): "Something else"}


@query(
    "assert_headers",
    "P7",
    f"""WITH {views("cells")}, e AS (SELECT * FROM (VALUES {", ".join(f"({k[0]}, '{k[1]}', '{t}')" for k, t in HEADERS.items())}) t(excel_row, excel_col, txt))
SELECT COUNT(c.excel_row) AS found, COUNT(*) AS expected FROM e LEFT JOIN cells c ON c.excel_row = e.excel_row AND c.excel_col = e.excel_col AND c.value_text = e.txt""",
)
def assert_headers(spark, sf):
    return L.assert_headers(I.cells(spark, sf), HEADERS)


@query(
    "rows_with_numbers",
    "P8 J7 J8 K6",
    f"""WITH {views("cells")}
SELECT excel_row, value_text AS label, 1 AS has_number FROM cells WHERE excel_col = 'B' AND excel_row IN (SELECT DISTINCT excel_row FROM cells WHERE cell_type = 'n')
UNION ALL SELECT excel_row, value_text, 0 FROM cells WHERE excel_col = 'B' AND excel_row NOT IN (SELECT DISTINCT excel_row FROM cells WHERE cell_type = 'n')""",
)
def rows_with_numbers(spark, sf):
    cells = I.cells(spark, sf)
    keys = cells.where(F.col("cell_type") == "n").select("excel_row").distinct()
    labels = cells.where(F.col("excel_col") == "B").select("excel_row", F.col("value_text").alias("label"))
    yes = L.keep_rows(labels, keys, ["excel_row"]).withColumn("has_number", F.lit(1))
    no = L.keep_rows(labels, keys, ["excel_row"], "left_anti").withColumn("has_number", F.lit(0))
    return yes.unionByName(no)


SHEET_SQL = """s0 AS (SELECT CAST(s_suppkey + 3 AS INTEGER) AS excel_row, s_name, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_name END AS key_,
    CAST(s_nationkey AS VARCHAR) AS b, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 9 = 0 THEN '#REF!' ELSE printf('%.2f', s_acctbal) END AS c,
    CASE WHEN s_suppkey % 5 = 0 THEN '..' END AS d FROM supplier)"""


def supplier_sheet(spark, sf):
    k = F.col("s_suppkey")
    return I.table(spark, sf, "supplier").select(
        (k + 3).cast("int").alias("excel_row"),
        F.when(k % 6 != 0, F.col("s_name")).alias("key_"),
        F.col("s_nationkey").cast("string").alias("b"),
        F.when(k % 4 == 0, None).when(k % 9 == 0, "#REF!").otherwise(C.fmt_fixed(F.col("s_acctbal"), 2)).alias("c"),
        F.when(k % 5 == 0, "..").alias("d"),
    )


def supplier_cells(spark, sf):
    return L.cells_from_wide(supplier_sheet(spark, sf), "S", "excel_row", {"key_": "A", "b": "B", "c": "C", "d": "D"})


CELLS_S_SQL = SHEET_SQL + f""",
cells_s AS (SELECT 'S' AS sheet, excel_row, upper(CASE k WHEN 'key_' THEN 'a' ELSE k END) AS excel_col,
  CASE WHEN substr(v, 1, 1) = '#' THEN 'e' WHEN ({snum("v")}) IS NOT NULL THEN 'n' ELSE 's' END AS cell_type, v AS value_text
  FROM (UNPIVOT (SELECT excel_row, key_, b, c, d FROM s0) ON key_, b, c, d INTO NAME k VALUE v))"""


@query("cell_grid", "A5", f"WITH {CELLS_S_SQL} SELECT * FROM cells_s")
def cell_grid(spark, sf):
    return supplier_cells(spark, sf)


@query(
    "melt_sheet",
    "A4",
    f"""WITH {SHEET_SQL}, hd AS (SELECT * FROM (VALUES ('B', 'nation', CAST(NULL AS VARCHAR)), ('C', 'balance', '($)')) t(col, name, unit))
SELECT 'S' AS sheet, excel_row, key_ AS period, name, unit, CASE col WHEN 'B' THEN b ELSE c END AS value_raw FROM s0 CROSS JOIN hd WHERE key_ IS NOT NULL""",
)
def melt_sheet(spark, sf):
    top = [("S", 1, "B", "s", "nation"), ("S", 1, "C", "s", "balance"), ("S", 2, "C", "s", "($)")]
    heads = TB.inline_rows(spark, top, "sheet string, excel_row int, excel_col string, cell_type string, value_text string")
    return L.melt_sheet(heads.unionByName(supplier_cells(spark, sf)), 1, 2, 3)
