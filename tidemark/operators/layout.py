"""Spreadsheet cells to relations: labels, sections, units and years are derived."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cleaning import strict_double
from tidemark.operators.scan import carry_forward


def grid_to_rows(cells: DataFrame, label_col: str, value_cols: Mapping[str, str]) -> DataFrame:
    """One row per sheet row: label and numbers of the named columns (only 'n' cells are numbers)."""
    number = F.when(F.col("cell_type") == "n", strict_double(F.col("value_text")))
    wanted = [label_col, *value_cols]
    return (
        cells.where(F.col("excel_col").isin(wanted))
        .groupBy("sheet", "excel_row")
        .agg(
            F.max(F.when(F.col("excel_col") == label_col, F.col("value_text"))).alias("label"),
            *[F.max(F.when(F.col("excel_col") == c, number)).alias(name) for c, name in value_cols.items()],
        )
        .where(F.col("label").isNotNull())
    )


def tag_header_rows(rows: DataFrame, value_names: Sequence[str], footnote: str = "*") -> DataFrame:
    """has_number, and is_header: a label without any number that is not a footnote."""
    has = F.coalesce(*[F.col(c) for c in value_names]).isNotNull()
    return rows.select(
        "*",
        has.cast("int").alias("has_number"),
        (~has & ~F.col("label").startswith(footnote)).cast("int").alias("is_header"),
    )


def fill_section(tagged: DataFrame, by: Sequence[str] = ("sheet",), order: str = "excel_row", **kw) -> DataFrame:
    """Nearest header above each row: its row number and label."""
    header = F.when(F.col("is_header") == 1, F.struct(F.col(order).alias("row"), F.col("label").alias("label")))
    out = carry_forward(tagged, by, order, header, "_h", **kw)
    return out.withColumns({"section": F.col("_h.label"), "section_row": F.col("_h.row")}).drop("_h")


def fill_switch(
    sectioned: DataFrame,
    marker: Column,
    before: str,
    after: str,
    alias: str,
    by: Sequence[str] = ("sheet",),
    order: str = "excel_row",
    **kw,
) -> DataFrame:
    """``after`` from a marker row on, until the next header; ``before`` elsewhere.

    The latest marker row at or above is carried forward; it counts only if it lies
    below the row's own header.
    """
    at = F.when(marker, F.col(order))
    out = carry_forward(sectioned, by, order, at, "_m", include_current=True, **kw)
    on = F.col("_m") > F.coalesce(F.col("section_row"), F.lit(0))
    return out.withColumn(alias, F.when(on, after).otherwise(before)).drop("_m")


def unpivot_years(rows: DataFrame, ids: Sequence[str], years: Mapping[str, int]) -> DataFrame:
    """Year columns to rows; missing values are dropped."""
    items = F.array(
        *[F.struct(F.lit(y).alias("year"), F.col(c).alias("value")) for c, y in years.items()]
    )
    long = rows.select(*ids, F.explode(F.filter(items, lambda e: e["value"].isNotNull())).alias("_e"))
    return long.select(*ids, "_e.year", "_e.value")


def map_columns(cells: DataFrame, colmap: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Numeric cells whose column letter is in the dictionary, with its case and year."""
    lookup = F.create_map(
        *[
            x
            for c, (case, year) in colmap.items()
            for x in (F.lit(c), F.struct(F.lit(case).alias("case"), F.lit(year).alias("year")))
        ]
    )
    hit = F.try_element_at(lookup, F.col("excel_col"))
    return (
        cells.where((F.col("cell_type") == "n") & F.col("excel_col").isin(list(colmap)))
        .withColumn("_m", hit)
        .select(
            "sheet", "excel_row", F.col("_m.case").alias("case"), F.col("_m.year").alias("year"),
            strict_double(F.col("value_text")).alias("value"),
        )
    )


def assert_headers(cells: DataFrame, expected: Mapping[tuple[int, str], str]) -> DataFrame:
    """How many named headers sit in their named cell: one row with found and expected."""
    hit = F.lit(False)
    for (row, col), text in expected.items():
        hit = hit | ((F.col("excel_row") == row) & (F.col("excel_col") == col) & (F.col("value_text") == text))
    return cells.where(F.col("excel_row").isin(sorted({r for r, _ in expected}))).agg(
        F.count_if(hit).alias("found"), F.lit(len(expected)).cast("bigint").alias("expected")
    )


def keep_rows(df: DataFrame, keys: DataFrame, on: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows whose key is (left_semi) or is not (left_anti) among ``keys``."""
    return df.join(keys.select(*on), list(on), how)


def melt_sheet(cells: DataFrame, header_row: int, unit_row: int, first_row: int, key_col: str = "A") -> DataFrame:
    """Sheet with a header row, a unit row and data rows -> one row per data cell.

    Rows without a key and columns without a header are left out; an empty cell in
    a headed column stays as a NULL value, as in a full read of the grid.
    """
    heads = cells.where(F.col("excel_row").isin(header_row, unit_row) & (F.col("excel_col") != key_col))
    heads = (
        heads.groupBy("sheet", "excel_col")
        .agg(
            F.max(F.when(F.col("excel_row") == header_row, F.col("value_text"))).alias("name"),
            F.max(F.when(F.col("excel_row") == unit_row, F.col("value_text"))).alias("unit"),
        )
        .where(F.col("name").isNotNull())
    )
    data = cells.where(F.col("excel_row") >= first_row)
    keys = data.where(F.col("excel_col") == key_col).select("sheet", "excel_row", F.col("value_text").alias("period"))
    body = data.where(F.col("excel_col") != key_col).select("sheet", "excel_row", "excel_col", "value_text")
    # A sheet has at most 16,384 columns, so the headers of a sheet travel as one bounded array.
    per_sheet = heads.groupBy("sheet").agg(F.collect_list(F.struct("excel_col", "name", "unit")).alias("_heads"))
    slots = keys.join(per_sheet, "sheet").select("sheet", "excel_row", "period", F.inline("_heads"))
    return slots.join(body, ["sheet", "excel_row", "excel_col"], "left").select(
        "sheet", "excel_row", "period", "name", "unit", F.col("value_text").alias("value_raw")
    )


def cells_from_wide(df: DataFrame, sheet: str, row: str, letters: Mapping[str, str]) -> DataFrame:
    """Wide table to non-empty cells with a type: n number, e error, s other text."""
    items = F.array(
        *[
            F.struct(F.lit(letter).alias("excel_col"), F.col(c).cast("string").alias("value_text"))
            for c, letter in letters.items()
        ]
    )
    text = F.col("value_text")
    kind = F.when(text.startswith("#"), "e").when(strict_double(text).isNotNull(), "n").otherwise("s")
    return (
        df.select(F.col(row).alias("excel_row"), F.inline(items))
        .where(text.isNotNull())
        .select(F.lit(sheet).alias("sheet"), "excel_row", "excel_col", kind.alias("cell_type"), "value_text")
    )
