"""Strict text-to-value parsing. What does not fit the pattern becomes NULL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English month names as they appear in exported files.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def looks_numeric(c: Column) -> Column:
    """Holds a digit and nothing but digits, '.', 'e', 'E', '+', '-'."""
    return c.rlike("[0-9]") & ~c.rlike("[^0-9.eE+-]")


def strict_double(c: Column) -> Column:
    """Number or NULL. The guard runs before the cast, which alone would accept ' 5 ', '5d' or 'NaN'."""
    return F.when(looks_numeric(c), c.try_cast("double"))


def parse_period(c: Column) -> Column:
    """'2026M08' -> 2026-08-01; months 13-19 pass the pattern but are not dates, so NULL."""
    iso = F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 6, 2), F.lit("-01"))
    return F.when(c.rlike(r"\A[0-9]{4}M[01][0-9]\z"), iso.try_cast("date"))


def parse_iso_date(c: Column) -> Column:
    """'2026-08-31' -> date."""
    return F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.trim(c).try_cast("date"))


def parse_dmy(c: Column) -> Column:
    """'31 Dec 1998' -> date; summary lines and unknown month names -> NULL."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    mm = F.array_position(names, F.substring(c, 4, 3))
    iso = F.concat_ws("-", F.substring(c, 8, 4), F.lpad(mm.cast("string"), 2, "0"), F.substring(c, 1, 2))
    return F.when(c.rlike(r"\A[0-3][0-9] [A-Z][a-z][a-z] [12][0-9]{3}\z") & (mm > 0), iso.try_cast("date"))


def trim_chars(c: Column, chars: str = "() ") -> Column:
    """Trim a set of characters; NULL becomes ''."""
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(chars))


def parse_printed_number(c: Column) -> Column:
    """'1,230' -> 1230.0; 'W' or '--' -> NULL. Keep the printed column beside it."""
    return strict_double(F.regexp_replace(c, ",", ""))


def parse_year(c: Column) -> Column:
    """'2025' -> 2025; a range such as '2021-24' -> NULL."""
    return F.when(c.rlike(r"\A[0-9]{4}\z"), c.try_cast("int"))


def empty_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def flag_latest(df: DataFrame, col: str, alias: str = "is_estimate") -> DataFrame:
    """1 where the column has its largest value in the table, 0 elsewhere (and for NULL)."""
    top = df.agg(F.max(col)).scalar()
    return df.withColumn("_top", top).withColumn(
        alias, F.coalesce((F.col(col) == F.col("_top")).cast("int"), F.lit(0))
    ).drop("_top")


def split_valid(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that do not; an unknown (NULL) result is a reject."""
    sure = F.coalesce(ok, F.lit(False))
    return df.where(sure), df.where(~sure)


def dedup_last(df: DataFrame, keys: Sequence[str], load_order: str) -> DataFrame:
    """Keep the last loaded row of each key.

    A max_by aggregate, not a row_number window: duplicates of a hot key are
    dropped before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), load_order).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def stack_series(frames: Mapping[str, DataFrame], cols: Sequence[str]) -> DataFrame:
    """Like tables to one long table with the table's name as series_id."""
    out = None
    for name, df in frames.items():
        one = df.select(F.lit(name).alias("series_id"), *cols)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables to stack")
    return out


def classify(c: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Label of the first keyword contained in the text, ignoring case."""
    low = F.lower(c)
    out = None
    for word, label in rules:
        hit = low.contains(word.lower())
        out = F.when(hit, label) if out is None else out.when(hit, label)
    if out is None:
        raise ValueError("no rules")
    return out.otherwise(otherwise) if otherwise is not None else out


def map_values(c: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, keep the others."""
    out = c
    for old, new in mapping.items():
        out = F.when(c == old, new).otherwise(out)
    return out


def plain_text(df: DataFrame) -> DataFrame:
    """Em dash to ', ' and en dash to '-' in every text column."""
    cols = [
        F.regexp_replace(F.regexp_replace(f.name, "—", ", "), "–", "-").alias(f.name)
        if isinstance(f.dataType, T.StringType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def fmt_thousands(c: Column, decimals: int = 0) -> Column:
    return F.format_number(c, decimals)


def fmt_fixed(c: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", c)


def zero_padded(c: Column, width: int) -> Column:
    """Code with leading zeros; NULL becomes ''."""
    return F.coalesce(F.lpad(c.cast("string"), width, "0"), F.lit(""))


def round_cols(df: DataFrame, decimals: Mapping[str, int], half_even: bool = False) -> DataFrame:
    """Round the listed columns for output (half up, or half even)."""
    fn = F.bround if half_even else F.round
    return df.select(*[fn(c, decimals[c]).alias(c) if c in decimals else F.col(c) for c in df.columns])


def sigfig_band(c: Column, digits: int = 2) -> tuple[Column, Column]:
    """Value range that rounds to the printed ``digits`` significant figures.

    The order of magnitude is the truncated logarithm (towards zero).
    """
    half = 0.5 * F.pow(F.lit(10.0), F.log10(c).cast("int") - (digits - 1))
    return c - half, c + half


def with_position(df: DataFrame, by: Sequence[str], order: str, alias: str = "n") -> DataFrame:
    return df.withColumn(alias, F.row_number().over(Window.partitionBy(*by).orderBy(order)))
