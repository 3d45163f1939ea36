import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from tidemark.functions import cleaning as C
from tidemark.operators import layout as L


def one_column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(fn(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_strict_double_rejects_what_a_cast_would_accept(spark):
    values = ["5", " 5 ", "5d", "NaN", "", None, "..", "1e3", "-2.5", "1-2", "1,230", "Infinity", "+7"]
    assert one_column(spark, values, C.strict_double) == [5.0, None, None, None, None, None, None, 1000.0, -2.5, None, None, None, 7.0]


def test_periods_and_dates(spark):
    assert one_column(spark, ["2026M08", "2026M13", "2026M00", "2026M08\n", "x2026M08", None], C.parse_period) == [dt.date(2026, 8, 1)] + [None] * 5
    assert one_column(spark, ["2024-02-29", "2023-02-29", "2024-2-29", "2024-02-29 "], C.parse_iso_date) == [dt.date(2024, 2, 29), None, None, None]
    assert one_column(spark, ["31 Dec 1998", "31 Xyz 1998", "31 Feb 1998", "Averages", None], C.parse_dmy) == [dt.date(1998, 12, 31)] + [None] * 4


def test_printed_numbers_years_and_trim(spark):
    assert one_column(spark, ["1,230", "W", "--", "12"], C.parse_printed_number) == [1230.0, None, None, 12.0]
    assert one_column(spark, ["2025", "2021-24", None], C.parse_year) == [2025, None, None]
    assert one_column(spark, ["($/mt)", None, " (x) "], C.trim_chars) == ["$/mt", "", "x"]


def test_sigfig_band_uses_the_truncated_logarithm(spark):
    lo, hi = C.sigfig_band(F.col("x"))
    df = spark.createDataFrame([(14.0,), (4.0,), (0.25,)], "x double").select(lo, hi)
    # log10(0.25) = -0.6 truncates to 0, so the step there is that of 1 to 10.
    got = [tuple(round(v, 9) for v in r) for r in df.collect()]
    assert got == [(13.5, 14.5), (3.95, 4.05), (0.2, 0.3)]


def test_dedup_last_keeps_the_latest_load(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 1, "z")], "k string, ord int, v string")
    assert rows(C.dedup_last(df, ["k"], "ord")) == [("a", 3, None), ("b", 1, "z")]


def test_split_valid_sends_unknown_to_rejects(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    ok, bad = C.split_valid(df, F.col("x") > 0)
    assert rows(ok) == [(1,)] and rows(bad) == [(-1,), (None,)]


def sheet(spark):
    cells = [
        ("S", 1, "B", "s", "Installed capacity"), ("S", 2, "B", "s", "Total"), ("S", 2, "C", "n", "10"),
        ("S", 3, "B", "s", "IT"), ("S", 3, "C", "n", "4"), ("S", 4, "B", "s", "*note"), ("S", 5, "B", "s", "Cloud"),
        ("S", 5, "C", "n", "3"), ("S", 5, "D", "e", "#REF!"), ("S", 70, "B", "s", "Load factor"), ("S", 75, "B", "s", "Total"),
        ("S", 75, "D", "n", "7"), ("T", 2, "B", "s", "Total"), ("T", 2, "C", "n", "1"),
    ]
    df = spark.createDataFrame(cells, "sheet string, excel_row int, excel_col string, cell_type string, value_text string")
    return L.tag_header_rows(L.grid_to_rows(df, "B", {"C": "y1", "D": "y2"}), ["y1", "y2"])


def test_sections_and_switch_do_not_depend_on_the_block_size(spark):
    results = []
    for block in (1, 2, 7, 65_536):
        s = L.fill_section(sheet(spark), block_rows=block).where("has_number = 1")
        out = L.fill_switch(s, F.col("label") == "IT", "Whole", "IT", "basis", block_rows=block)
        results.append(rows(out.select("sheet", "excel_row", "section", "basis")))
    assert results[0] == [
        ("S", 2, "Installed capacity", "Whole"), ("S", 3, "Installed capacity", "IT"), ("S", 5, "Installed capacity", "IT"),
        ("S", 75, "Load factor", "Whole"), ("T", 2, None, "Whole"),
    ]
    assert all(r == results[0] for r in results)
