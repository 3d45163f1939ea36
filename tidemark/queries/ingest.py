"""Ingest and export queries. Files are first written from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.operators import panel as P
from tidemark.plans import inputs as I
from tidemark.plans.inputs import views
from tidemark.queries.common import r, rounded
from tidemark.queries.registry import query
from tidemark.session import shared_folder
from tidemark.sources import store, text


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


@query(
    "raw_text_ingest",
    "A1 B3 B1",
    """SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi, CAST(0 AS BIGINT) AS bad_lines FROM orders GROUP BY 1""",
)
def raw_text_ingest(spark, sf):
    """Orders written as text files, read back line by line with their line numbers."""
    path = _folder(spark)
    o = I.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    o.write.option("header", True).csv(path)
    raw = text.read_raw_text(spark, path, ["o_orderkey", "day"], 0, "S1")
    return raw.groupBy(C.parse_iso_date(F.col("day")).alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("o_orderkey").cast("bigint")).alias("lo"), F.max(F.col("o_orderkey").cast("bigint")).alias("hi"),
        F.count_if(F.col("file_line") < 2).alias("bad_lines"),
    )


@query(
    "raw_csv_ingest",
    "A2",
    """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS source, length(text) AS n_chars, md5(nullif(text, '')) AS text_md5,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) + 1 AS file_line, lang FROM documents""",
)
def raw_csv_ingest(spark, sf):
    """Whole texts in a single-byte encoding, one file a language in parts: read back record by record with their line numbers; blank cells become NULL."""
    path = _folder(spark)
    d = I.table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("source"), "text")
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    # Parts follow each other by doc_id, so no task writes a whole language; the table's splits are of bounded size.
    files = d.repartitionByRange(d.rdd.getNumPartitions(), "lang", "doc_id").sortWithinPartitions("lang", "doc_id").write.partitionBy("lang")
    files.options(header=True, encoding="ISO-8859-1", emptyValue="", escape='"', **keep_spaces).csv(path)
    raw = None
    for lang in sorted(r.lang for r in d.select("lang").distinct().collect()):  # one row a file
        one = text.read_raw_csv(spark, f"{path}/lang={lang}", ["doc_id", "source", "text"], "S2", "windows-1252", empty_to_null=True, parts=True).withColumn("lang", F.lit(lang))
        raw = one if raw is None else raw.unionByName(one)
    return raw.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"),
        F.col("file_line").cast("long").alias("file_line"), "lang",
    )


@query(
    "pick_longest_file",
    "A3",
    """WITH f AS (SELECT source, COUNT(*) AS n, bool_and(lang <> 'zz') AND source <> 'src0' AS ok FROM documents GROUP BY source),
b AS (SELECT source FROM f WHERE ok ORDER BY n DESC, source LIMIT 1)
SELECT source, n, CASE WHEN source = (SELECT source FROM b) THEN 'used' WHEN ok THEN 'ignored' ELSE 'other header' END AS state FROM f""",
)
def pick_longest_file(spark, sf):
    d = I.table(spark, sf, "documents").select("source", "lang")
    _, report = text.pick_longest_file(d, (F.col("lang") != "zz") & (F.col("source") != "src0"), "source")
    return report


@query(
    "profile_ingest",
    "A10",
    f"""WITH {views("raw_text")} SELECT l_linenumber, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE trim(value_raw) IN ('', '.')) AS blanks, MIN(period_raw) AS first, MAX(period_raw) AS last FROM raw_text GROUP BY l_linenumber""",
)
def profile_ingest(spark, sf):
    return text.profile_ingest(I.raw_text(spark, sf), "value_raw", "period_raw", ["l_linenumber"])


@query(
    "optional_input",
    "A8 A9",
    f"""WITH {views("px_monthly")} SELECT series_id, month, {r("value")} AS value, CAST(NULL AS DOUBLE) AS licensed_cash,
  'lineitem, lineitem_data, part, part_data, supplement' AS found FROM px_monthly""",
)
def optional_input(spark, sf):
    """A licensed input that is not there and a supplement without rows: their columns stay empty, the panel still builds."""
    folder = _folder(spark)
    store.save_tables({"supplement": store.stub(spark, "series_id string, month date, licensed_cash double")}, folder)
    paths = {t: f"{sf}/{t}.parquet" for t in ("lineitem", "part")} | {t: f"{folder}/{t}" for t in ("licensed", "supplement")}
    found = store.available(spark, paths)
    store.require_tables(found, ["lineitem_data", "part_data"])
    usable = next((t for t in ("licensed", "supplement") if f"{t}_data" in found), None)
    schema = "series_id string, month date, licensed_cash double"
    extra = spark.read.schema(schema).parquet(paths[usable]) if usable else store.stub(spark, schema)
    px = I.px_monthly(spark, sf).select("series_id", "month", "value")
    return rounded(P.join_on_spine(px, (extra, ["series_id", "month"]))).withColumn("found", F.lit(", ".join(sorted(found))))


@query(
    "result_round_trip",
    "A12 A13 A14",
    "SELECT doc_id, lang, source, length(nullif(text, '')) AS n_chars, md5(nullif(text, '')) AS text_md5 FROM documents",
)
def result_round_trip(spark, sf):
    """Whole texts saved as table and CSV master copy, then loaded as the next build does."""
    folder = _folder(spark)
    store.save_result(I.table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "texts", folder, deny=["n_chars"])
    got = store.load_results(spark, folder, {"texts": "doc_id long, lang string, source string, text string"})["texts"]
    return got.select("doc_id", "lang", "source", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(
    "full_rebuild",
    "A11",
    f"""WITH {views("supply")} SELECT country, region, {r("production")} AS production, {r("production * 100 / SUM(production) OVER (PARTITION BY region)")} AS share_pct FROM supply""",
)
def full_rebuild(spark, sf):
    """Tables built, then all built anew from those that are replaced; a table that is no longer built is gone."""
    folder = _folder(spark)
    supply = I.supply(spark, sf).select("country", "region", "production")
    store.save_tables({"supply": supply, "dropped": supply.limit(0)}, folder, {"supply": ["region"]})
    old = store.load_tables(spark, folder, ["supply"])["supply"]
    whole = old.groupBy("region").agg(F.sum("production").alias("_whole"))
    shares = old.join(whole, "region").withColumn("share_pct", F.try_divide(F.col("production") * 100, "_whole")).drop("_whole")
    store.save_tables({"shares": shares}, folder, {"shares": ["region"]})
    present = store.available(spark, {t: f"{folder}/{t}" for t in ("supply", "dropped", "shares")})
    if present != {"shares", "shares_data"}:
        raise ValueError(f"after the rebuild there are {sorted(present)}")
    return rounded(store.load_tables(spark, folder, ["shares"])["shares"].select("country", "region", "production", "share_pct"))


_BUNDLE = "'[' || c_custkey || ',' || to_json(c_name) || ',' || c_nationkey || ',' || to_json(c_mktsegment) || ']'"


@query(
    "dataset_bundle",
    "A15",
    f"""SELECT 'customers' AS page, 'list' AS dataset, {_BUNDLE} AS row FROM customer WHERE NOT contains(c_mktsegment, 'AUTO')
UNION ALL SELECT 'nations', 'list', '[' || n_nationkey || ',' || to_json(n_name) || ']' FROM nation
UNION ALL SELECT 'nations', 'regions', '[' || r_regionkey || ',' || to_json(r_name) || ']' FROM region""",
)
def dataset_bundle(spark, sf):
    """All datasets of all pages written as one bundle, a folder for each, and read back."""
    folder = _folder(spark)
    tables = [("customers", "list", I.table(spark, sf, "customer")), ("nations", "list", I.table(spark, sf, "nation")), ("nations", "regions", I.table(spark, sf, "region"))]
    drops, rows = {"list": ["c_acctbal", "n_regionkey"]}, {"list": F.lit(False)}
    customers, *rest = tables
    limited = customers[2].where(~F.col("c_mktsegment").contains("AUTO"))
    store.export_datasets([(*customers[:2], limited), *rest], folder, drops, rows, deny=["c_phone"])
    return store.read_datasets(spark, folder)


@query(
    "export_dataset",
    "A15",
    """SELECT 'customers' AS page, 'list' AS dataset, '[' || c_custkey || ',' || to_json(c_name) || ',' || c_nationkey || ',' || CASE WHEN c_custkey % 8 = 0 THEN 'null' ELSE to_json(c_mktsegment) END || ']' AS row
FROM customer WHERE NOT contains(c_mktsegment, 'AUTO')""",
)
def export_dataset(spark, sf):
    c = I.table(spark, sf, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 8 != 0, F.col("c_mktsegment")).otherwise(F.when(F.col("c_mktsegment").contains("AUTO"), F.col("c_mktsegment")).otherwise("")))
    return store.dataset_rows(c, "customers", "list", ["c_acctbal"], F.col("c_mktsegment").contains("AUTO"))


@query("collected_tables", "A6", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def collected_tables(spark, sf):
    """Small register tables kept as CSV, read back with their declared types."""
    folder = _folder(spark)
    store.export_csv({f"{n}.csv": I.table(spark, sf, n) for n in ("nation", "region")}, folder)
    got = store.read_collected(spark, folder, {n: I.SCHEMAS[n] for n in ("nation", "region")})
    return got["nation"].join(got["region"], F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name")
