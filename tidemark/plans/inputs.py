"""Series derived from the given star-schema tables.

Each function has a SQL twin of the same name in ``VIEW_SQL`` that the
oracles use, so both sides start from the same definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.panel import month_of, to_monthly


# Column types of the given tables; with them a read needs no job to look at the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def px_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price per brand."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("series_id"))
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy("series_id", F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.avg(F.try_divide("l_extendedprice", "l_quantity")).alias("value"),
            F.count(F.lit(1)).alias("n_obs"),
        )
    )


def px_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly mean of the daily prices, with month-end value and day count."""
    return to_monthly(px_daily(spark, sf_dir), by=["series_id"])


def idx_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily index without a key: the mean order total."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.avg("o_totalprice").alias("value"))
    )


def idx_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_monthly(idx_daily(spark, sf_dir), by=[])


def defl_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly deflator (mean quantity)."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(month_of(F.col("l_shipdate")).alias("month"))
        .agg(F.avg("l_quantity").alias("value"))
    )


def fx_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly exchange rate (one plus the mean discount)."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(month_of(F.col("l_shipdate")).alias("month"))
        .agg((1 + F.avg("l_discount")).alias("value"))
    )


def rates_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deflator and exchange rate side by side, from one scan."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(month_of(F.col("l_shipdate")).alias("month"))
        .agg(F.avg("l_quantity").alias("defl"), (1 + F.avg("l_discount")).alias("fx"))
    )


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production (quantity) and reserves (price) per nation."""
    li = table(spark, sf_dir, "lineitem")
    su = table(spark, sf_dir, "supplier")
    na = table(spark, sf_dir, "nation")
    # Reduce by supplier before any join, so no join sees the fact table.
    per_supplier = li.groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p")
    )
    return (
        per_supplier.join(su, per_supplier.l_suppkey == su.s_suppkey)
        .join(na, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("country"), F.col("n_regionkey").alias("region"))
        .agg(F.sum("q").alias("production"), F.sum("p").alias("reserves"))
    )


def sector_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales per part type."""
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part")
    return (
        li.join(pa, li.l_partkey == pa.p_partkey)
        .groupBy(F.col("p_type").alias("sector"))
        .agg(F.sum("l_extendedprice").alias("sales"))
    )


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells with markers, blanks and junk among the numbers."""
    key = F.col("l_orderkey")
    ship = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(key % 17 == 0, "..")
        .when(key % 19 == 0, "")
        .when(key % 23 == 0, "5d")
        .when(key % 29 == 0, " 5 ")
        .otherwise(F.col("l_quantity").cast("int").cast("string"))
        .alias("value_raw"),
        F.concat(
            F.year(ship).cast("string"), F.lit("M"), F.lpad(F.month(ship).cast("string"), 2, "0")
        ).alias("period_raw"),
    )


#: Years of the sheet and their columns; years before the first or after the last count in the outer columns.
SHEET_YEARS = {1995: "C", 1996: "D", 1997: "E", 1998: "G", 1999: "H", 2000: "I", 2001: "J"}
SHEET_HEADING, SHEET_MARKER = "Shipped from ", "of which by sea"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet as cells: regions as section headers, nations as data rows. The cells of a nation come from one row."""
    li = table(spark, sf_dir, "lineitem")
    na = table(spark, sf_dir, "nation")
    rg = table(spark, sf_dir, "region")
    su = table(spark, sf_dir, "supplier")
    year = F.greatest(F.lit(min(SHEET_YEARS)), F.least(F.lit(max(SHEET_YEARS)), F.year("l_shipdate")))
    wide = (
        li.groupBy("l_suppkey").agg(*[F.sum(F.when(year == y, F.col("l_quantity"))).alias(f"q{y}") for y in SHEET_YEARS])
        .join(su, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey").agg(*[F.sum(f"q{y}").alias(f"q{y}") for y in SHEET_YEARS])
    )
    by_region = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    nat = na.select("n_nationkey", "n_name", "n_regionkey", F.row_number().over(by_region).alias("i"))

    def cell(col: str, kind: str, text: Column) -> Column:
        return F.struct(F.lit(col).alias("excel_col"), F.lit(kind).alias("cell_type"), text.alias("value_text"))

    def sheet_row(row: Column) -> list[Column]:
        return [F.lit("Data").alias("sheet"), row.cast("int").alias("excel_row")]

    head = F.array(cell("B", "s", F.concat(F.lit(SHEET_HEADING), F.col("r_name"))))
    heads = rg.select(*sheet_row(F.col("r_regionkey") * 20 + 1), F.inline(head))
    own = F.array(
        cell("B", "s", F.when(F.col("i") == 3, SHEET_MARKER).otherwise(F.col("n_name"))),
        *[cell(letter, "n", F.col(f"q{y}").cast("bigint").cast("string")) for y, letter in SHEET_YEARS.items()],
        cell("F", "e", F.lit("#REF!")),
    )
    rows = nat.join(wide, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    data = rows.select(*sheet_row(F.col("n_regionkey") * 20 + 1 + F.col("i")), F.inline(own)).where(F.col("value_text").isNotNull())
    return heads.unionByName(data)


VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "px_daily": (
        (),
        "SELECT p_brand AS series_id, CAST(l_shipdate AS DATE) AS date,"
        " AVG(l_extendedprice / l_quantity) AS value, COUNT(*) AS n_obs"
        " FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)",
    ),
    "px_monthly": (
        ("px_daily",),
        "SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month, AVG(value) AS value,"
        " COUNT(*) AS n_days, MAX(date) AS last_day, arg_max(value, date) AS month_end"
        " FROM px_daily GROUP BY series_id, CAST(date_trunc('month', date) AS DATE)",
    ),
    "idx_daily": (
        (),
        "SELECT CAST(o_orderdate AS DATE) AS date, AVG(o_totalprice) AS value"
        " FROM orders GROUP BY CAST(o_orderdate AS DATE)",
    ),
    "idx_monthly": (
        ("idx_daily",),
        "SELECT CAST(date_trunc('month', date) AS DATE) AS month, AVG(value) AS value,"
        " COUNT(*) AS n_days, MAX(date) AS last_day, arg_max(value, date) AS month_end"
        " FROM idx_daily GROUP BY CAST(date_trunc('month', date) AS DATE)",
    ),
    "defl_monthly": (
        (),
        "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, AVG(l_quantity) AS value"
        " FROM lineitem GROUP BY CAST(date_trunc('month', l_shipdate) AS DATE)",
    ),
    "fx_monthly": (
        (),
        "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, 1 + AVG(l_discount) AS value"
        " FROM lineitem GROUP BY CAST(date_trunc('month', l_shipdate) AS DATE)",
    ),
    "supply": (
        (),
        "SELECT n_name AS country, n_regionkey AS region, SUM(l_quantity) AS production,"
        " SUM(l_extendedprice) AS reserves FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"
        " JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name, n_regionkey",
    ),
    "sector_totals": (
        (),
        "SELECT p_type AS sector, SUM(l_extendedprice) AS sales FROM lineitem"
        " JOIN part ON p_partkey = l_partkey GROUP BY p_type",
    ),
    "raw_text": (
        (),
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 17 = 0 THEN '..'"
        " WHEN l_orderkey % 19 = 0 THEN '' WHEN l_orderkey % 23 = 0 THEN '5d'"
        " WHEN l_orderkey % 29 = 0 THEN ' 5 ' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS value_raw,"
        " concat(CAST(year(l_shipdate) AS VARCHAR), 'M', lpad(CAST(month(l_shipdate) AS VARCHAR), 2, '0'))"
        " AS period_raw FROM lineitem",
    ),
    "nat": (
        (),
        "SELECT n_nationkey, n_name, n_regionkey,"
        " ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation",
    ),
    "rev": (
        (),
        f"SELECT s_nationkey, greatest({min(SHEET_YEARS)}, least({max(SHEET_YEARS)}, year(l_shipdate))) AS y, SUM(l_quantity) AS q"
        " FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL",
    ),
    "cells": (
        ("nat", "rev"),
        "SELECT 'Data' AS sheet, CAST(r_regionkey * 20 + 1 AS INT) AS excel_row, 'B' AS excel_col,"
        f" 's' AS cell_type, concat('{SHEET_HEADING}', r_name) AS value_text FROM region"
        " UNION ALL SELECT 'Data', CAST(n_regionkey * 20 + 1 + i AS INT), 'B', 's',"
        f" CASE WHEN i = 3 THEN '{SHEET_MARKER}' ELSE n_name END FROM nat"
        " UNION ALL SELECT 'Data', CAST(n_regionkey * 20 + 1 + i AS INT),"
        f" CASE y {' '.join(f'WHEN {y} THEN {chr(39)}{c}{chr(39)}' for y, c in SHEET_YEARS.items())} END, 'n',"
        " CAST(CAST(q AS BIGINT) AS VARCHAR) FROM nat JOIN rev ON s_nationkey = n_nationkey"
        " UNION ALL SELECT 'Data', CAST(n_regionkey * 20 + 1 + i AS INT), 'F', 'e', '#REF!' FROM nat",
    ),
}


def views(*names: str) -> str:
    """``a AS (...), b AS (...)`` for the named views and what they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        needs, body = VIEW_SQL[name]
        for n in needs:
            add(n)
        done.setdefault(name, f"{name} AS ({body})")

    for n in names:
        add(n)
    return ",\n".join(done.values())
