"""What may be published: denylists, trimming, redaction, leak scan, provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of local user paths and of e-mail addresses.
LEAK_PATTERNS = {
    "local_path": r"[A-Za-z]:[\\/]+Users[\\/]|/Users/[^/\s]+|AppData|/home/[^/\s]+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}

# The same e-mail matches, found in time linear in the text: an attempt starts only where a
# run of name characters starts (or where the last match ended) and never gives characters
# back, so one long token without '@' is read once and not once per character.
_NAME = "[A-Za-z0-9._%+-]"
SCAN_PATTERNS = {
    **LEAK_PATTERNS,
    "email": LEAK_PATTERNS["email"].replace(f"{_NAME}+@", rf"(?:\G|(?<!{_NAME})){_NAME}++@", 1),
}


def assert_no_columns(df: DataFrame, deny: Sequence[str], name: str) -> DataFrame:
    """Stop before any work if a licensed column is about to leave."""
    bad = sorted(set(df.columns) & set(deny))
    if bad:
        raise ValueError(f"{name}: column(s) {bad} must never be exported")
    return df


def redact(df: DataFrame, when: Column, keep: Column, text: str, col: str = "detail") -> DataFrame:
    """Replace the detail text of matching rows, with exceptions."""
    hide = F.coalesce(when, F.lit(False)) & ~F.coalesce(keep, F.lit(False))
    return df.withColumn(col, F.when(hide, text).otherwise(F.col(col)))


def trim_restricted(df: DataFrame, drop_cols: Sequence[str], drop_rows: Column | None) -> DataFrame:
    """Leave out restricted columns, and rows that match the condition (NULL does not match)."""
    out = df if drop_rows is None else df.where(~F.coalesce(drop_rows, F.lit(False)))
    return out.drop(*drop_cols)


# Plain texts of which every match holds at least one: texts without them skip the pattern.
NEEDLES = {"local_path": ("Users", "AppData", "/home/"), "email": ("@",)}


def scan_text(
    df: DataFrame, text: str, patterns: Mapping[str, str] = SCAN_PATTERNS, needles: Mapping[str, Sequence[str]] = NEEDLES
) -> DataFrame:
    """Every match of the patterns in whole texts: pattern, match, rows and hits."""
    def hits(name: str, p: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        words = needles.get(name, ())
        if not words:
            return found
        near = reduce(lambda a, b: a | b, [F.col(text).contains(w) for w in words])
        return F.when(near, found)

    found = F.array(*[F.struct(F.lit(n).alias("pattern"), hits(n, p).alias("hits")) for n, p in patterns.items()])
    each = df.select(F.monotonically_increasing_id().alias("_row"), F.inline(found)).where(F.size("hits") > 0)
    # Two sums, linear in the hits of a text: of a row, then of all rows.
    per_row = each.select("_row", "pattern", F.explode("hits").alias("match")).groupBy("_row", "pattern", "match").agg(F.count(F.lit(1)).alias("k"))
    return per_row.groupBy("pattern", "match").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("k").alias("n_hits"))


def check_manifest(catalog: DataFrame, manifest: DataFrame, large_rows: int = 100) -> DataFrame:
    """Datasets without a manifest entry, without sources, or large without approval."""
    j = catalog.select("table_name", "n_rows").join(manifest, "table_name", "left")
    problem = (
        F.when(F.col("sources").isNull(), "not in the manifest")
        .when(F.col("sources") == "", "no sources")
        .when((F.col("n_rows") >= large_rows) & ~F.coalesce(F.col("large_ok"), F.lit(False)), "large and not approved")
        .otherwise("ok")
    )
    return j.select("table_name", "n_rows", problem.alias("finding"))


def cited_checks(datasets: DataFrame, checks: DataFrame) -> DataFrame:
    """One row per dataset and check of its table."""
    return datasets.select("dataset", "table_name").join(
        checks.select("table_name", "check_no", "description", "status"), "table_name"
    )


def provenance(datasets: DataFrame, manifest: DataFrame, checks: DataFrame) -> DataFrame:
    """Dataset -> table, writer, sources, its table's checks (number, description and status, by number), and how many there are (and are judged).

    A table's list is as long as the check report has rows for it.
    """
    told = F.sort_array(F.collect_list(F.struct("check_no", "description", "status")))
    per_table = checks.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if(F.col("status") != "INFO").alias("n_judged"), told.alias("checks")
    )
    return (
        datasets.join(manifest.select("table_name", "sources"), "table_name", "left")
        .join(per_table, "table_name", "left")
        .fillna(0, ["n_checks", "n_judged"])
        .withColumn("checks", F.coalesce("checks", F.array().cast(checks.select(F.array(F.struct("check_no", "description", "status")).alias("c")).schema["c"].dataType)))
    )


def check_provenance(cited: DataFrame, prov: DataFrame, shown: DataFrame) -> DataFrame:
    """Cited checks that are not shown with that table and status, and datasets without a judged check."""
    stale = cited.join(shown.select("check_no", "table_name", "status"), ["check_no", "table_name", "status"], "left_anti")
    a = stale.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).select("dataset", F.lit("cited check not shown").alias("finding"), "n")
    b = prov.where(F.col("n_judged") == 0).select("dataset", F.lit("no judged check").alias("finding"), F.lit(1).cast("bigint").alias("n"))
    return a.unionByName(b)
