import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import facts as FA
from tidemark.operators import scenario as SC


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def series(spark, values, extra=None):
    data = [("a", month(i), v, (extra or values)[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "series_id string, month date, value double, real double")


def test_records_take_the_first_month_on_ties(spark):
    r = FA.records(series(spark, [1.0, 5.0, 5.0, 4.0], [2.0, 1.0, None, 2.0]), ["series_id"], "value", "real").first()
    assert (r.nominal_peak_month, r.nominal_peak, r.at_nominal_record) == (month(1), 5.0, 0)
    assert (r.real_peak_month, r.latest_real, r.at_real_record) == (month(0), 2.0, 1)
    assert r.latest_pct_of_nominal_peak == 80.0


def test_rank_and_run_above(spark):
    s = series(spark, [3.0, 1.0, 4.0, 2.0, 3.0, 5.0, 3.0])
    k = FA.latest_rank(s, ["series_id"], "value").first()
    assert (k.months_above, k.months_below, k["rank"]) == (2, 2, 3)
    run = FA.run_above(s, ["series_id"], "value", F.lit(2.0)).first()
    assert (run.last_below, run.first_of_run, run.run_months) == (month(3), month(4), 3)
    assert run.share_above_pct == pytest.approx(500 / 7)
    always = FA.run_above(s, ["series_id"], "value", F.lit(0.5)).first()
    assert (always.last_below, always.first_of_run, always.run_months) == (None, month(0), 7)


def test_record_holds_until_first_exceeded(spark):
    s = series(spark, [1.0, 3.0, 2.0, 3.0, 4.0])
    r = FA.record_holds_until(s, ["series_id"], "value", "2000-02-01").first()
    assert (r.value_then, r.was_record, r.first_exceeded) == (3.0, 1, month(4))


def test_identical_until(spark):
    df = spark.createDataFrame([("a", month(i), x, y) for i, (x, y) in enumerate([(1, 1), (2, 2), (3, 4), (5, 6)])], "k string, month date, x int, y int")
    r = FA.identical_until(df, ["x", "y"], ["k"]).first()
    assert (r.last_same, r.first_break, r.unbroken) == (month(1), month(2), 1)


def test_breakeven_closed_form(spark):
    rows_ = [("k", "new", "conductivity_pct", 61.0), ("k", "new", "density", 2.70), ("k", "old", "density", 8.89)]
    r = FA.breakeven(spark.createDataFrame(rows_, "k string, material string, property string, value double"), ["k"]).first()
    mass = (1 / 0.61) * (2.70 / 8.89)
    assert (r.area_factor, r.width_factor, r.breakeven_ratio) == pytest.approx((1 / 0.61, (1 / 0.61) ** 0.5, 1 / mass))


def test_period_changes_skip_missing_starts(spark):
    px = [None, 2.0, None, 4.0, 8.0, 6.0]
    idx = [None, None, None, 10.0, 20.0, 15.0]
    data = [("a", month(i), px[i], idx[i], None if i == 0 else float((-1) ** i), None if i == 0 else float((-1) ** (i + 1))) for i in range(6)]
    df = spark.createDataFrame(data, "k string, month date, px double, idx double, ra double, rb double")
    out = FA.period_changes(df, ["k"], {("own", "quoted"): "px", ("own", "real"): "ra", ("other", "quoted"): "idx"}, {"3m": 3, "all": None}, "idx", "ra", "rb", {("own", "quoted"): {"second": "idx"}}, {("other", "quoted"): "px"})
    assert sorted({(r.currency, r.basis) for r in out.collect()}) == [("other", "quoted"), ("own", "quoted"), ("own", "real")]
    other = {r.period: r for r in out.where("currency = 'other'").collect()}
    # The other currency starts later, but its window of the second series starts with the anchor; it has no companion.
    assert (other["all"].start_month, other["all"].change_pct, other["all"].second_start_month, other["all"].second_rebased) == (month(3), 50.0, month(3), None)
    got = {r.period: r for r in out.where("currency = 'own' AND basis = 'quoted'").collect()}
    assert got["3m"].second_rebased == 150.0
    # Three months back is a month without a price, so the window starts one month later.
    assert (got["3m"].start_month, got["3m"].change_pct) == (month(3), 50.0)
    assert (got["all"].start_month, got["all"].change_pct) == (month(1), 200.0)
    assert (got["all"].second_start_month, got["all"].second_change_pct) == (month(3), 50.0)
    assert (got["all"].second_rose_n, got["all"].fell_when_rose_n, got["all"].second_fell_n, got["all"].rose_when_fell_n) == (1, 1, 1, 1)


def test_interpolation_and_total_band(spark):
    df = spark.createDataFrame([("x", 2025, 100.0, 50.0), ("x", 2035, 400.0, 80.0), ("y", 2025, 1.0, 1.0)], "k string, year int, v double, s double")
    out = SC.interpolate(df, ["k"], ["v", "s"], 2025, 2035, 2030)
    got = {(r.k, r.path_method, r.year): r.v for r in out.collect()}
    assert got[("x", "linear", 2030)] == 250.0 and got[("x", "constant_growth", 2030)] == pytest.approx(200.0)
    assert ("y", "linear", 2030) not in got and len(got) == 5


def test_constant_growth_build_adds_up(spark):
    df = spark.createDataFrame([("x", 90.0, 6)], "k string, total double, n int")
    got = {r.path: r for r in SC.build_path(df, "total", "n", F.lit(0.08)).collect()}
    first = got["constant_growth"].first_year
    assert sum(first * 1.08**i for i in range(6)) == pytest.approx(90.0)
    assert got["constant_growth"].target_year == pytest.approx(first * 1.08**5)
    assert got["even"].target_year == 15.0


def test_separable_range_equals_the_full_product(spark):
    a = [("k", float(v), f"a{i}") for i, v in enumerate([3, -1, 7])]
    b = [("k", float(v), f"b{i}") for i, v in enumerate([10, 2])]
    out = SC.separable_range(
        spark.createDataFrame(a, "k string, va double, la string"), spark.createDataFrame(b, "k string, vb double, lb string"), ["k"], "va", "vb", "la", "lb"
    )
    sums = {x[1] + y[1]: f"{x[2]}; {y[2]}" for x, y in itertools.product(a, b)}
    assert rows(out) == [("k", "high", max(sums), sums[max(sums)], 6), ("k", "low", min(sums), sums[min(sums)], 6)]


def test_sensitivity_and_tornado(spark):
    data = [("g", p, q, float(10 * i + j)) for i, p in enumerate("abc") for j, q in enumerate("xy")]
    df = spark.createDataFrame(data, "g string, p string, q string, v double")
    over = [(1, "P", "b", {"p": "b"}), (1, "P", "c", {"p": "c"}), (2, "Q", "y and c", {"q": "y", "p": "c"})]
    sens = SC.sensitivity(df, ["p", "q"], ["g"], {"p": "a", "q": "x"}, over, "v")
    assert rows(sens.select("bar_order", "alt_label", "value", "change_vs_reference")) == [
        (0, "Reference case", 0.0, 0.0), (1, "b", 10.0, 10.0), (1, "c", 20.0, 20.0), (2, "y and c", 21.0, 21.0)]
    bars = {r.bar: (r.low, r.high, r.low_label, r.high_label, r.swing) for r in SC.tornado(sens, ["g"]).collect()}
    assert bars == {"P": (0.0, 20.0, "", "c", 20.0), "Q": (0.0, 21.0, "", "y and c", 21.0)}


def test_sensitivity_of_a_sum_looks_up_both_grids(spark):
    a = spark.createDataFrame([(g, p, q, float(10 * i + j), 200.0) for g in "gh" for i, p in enumerate("abc") for j, q in enumerate("xy")], "g string, p string, q string, v double, base double")
    b = spark.createDataFrame([(g, s, float(100 * i), f"note {s}") for g in "gh" for i, s in enumerate("mn") if (g, s) != ("h", "n")], "g string, s string, w double, note string")
    over = [(1, "P", "c", {"p": "c"}), (2, "S", "n", {"s": "n"}), (3, "both", "y and n", {"q": "y", "s": "n"}), (4, "none", "z", {"q": "z"})]
    out = SC.sensitivity_of_sum(a, b, ["g"], (["p", "q"], ["s"]), ("v", "w"), {"p": "a", "q": "x", "s": "m"}, over, F.col("base"), ((), ["note"]))
    assert rows(out.where("g = 'g'").select("bar_order", "alt_label", "v", "w", "note", "total", "change_vs_reference", "pct_of_base")) == [
        (0, "Reference case", 0.0, 0.0, "note m", 0.0, 0.0, 0.0), (1, "c", 20.0, 0.0, "note m", 20.0, 20.0, 10.0),
        (2, "n", 0.0, 100.0, "note n", 100.0, 100.0, 50.0), (3, "y and n", 1.0, 100.0, "note n", 101.0, 101.0, 50.5)]
    assert sorted(r.bar_order for r in out.where("g = 'h'").collect()) == [0, 1]


def test_supply_shares_use_the_published_world_total(spark):
    prod = spark.createDataFrame([("a", 60.0), ("b", 20.0), ("other", 15.0)], "country string, production double")
    res = spark.createDataFrame([("a", 600.0), ("c", 100.0)], "country string, reserves double")
    names = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("other", 0)], "country string, placeable int")
    world = spark.createDataFrame([(100.0, 1000.0)], "production double, reserves double")
    got = {r.country: r for r in FA.supply_table(prod, res, names, world=world).collect()}
    assert (got["a"].share_of_production_pct, got["a"].share_of_reserves_pct, got["a"].life_years, got["a"]["rank"]) == (60.0, 60.0, 10.0, 1)
    assert (got["b"]["rank"], got["c"]["rank"], got["other"]["rank"]) == (2, 3, None)
    assert (got["c"].production, got["b"].reserves, got["World total"].share_of_production_pct) == (None, None, 100.0)
    listed = {r.country: r for r in FA.supply_table(prod, res, names).collect()}
    assert listed["World total"].production == 95.0


def test_events_off_the_series_or_without_a_source_stop_the_job(spark):
    months = "month date, value double"
    series = spark.createDataFrame([(dt.date(2020, 1, 1), 5.0), (dt.date(2020, 2, 1), None)], months)
    sources = spark.createDataFrame([("S1", "one")], "source_id string, source_name string")
    event = lambda month, source, status="approved": spark.createDataFrame([("e", month, status, source)], "label string, month date, status string, source_id string")
    on = FA.events_on_series(event(dt.date(2020, 1, 1), "S1").unionByName(event(dt.date(2020, 2, 1), "S1")), series, sources)
    assert sorted((r.month.month, r.value) for r in on.collect()) == [(1, 5.0), (2, None)]
    for bad, said in ((event(dt.date(2020, 3, 1), "S1"), "2020-03-01 is not on the series"), (event(dt.date(2020, 1, 1), "S9"), "S9 is not in the register"), (event(None, "S1"), "none.* is not on the series")):
        with pytest.raises(Exception, match=said):
            FA.events_on_series(bad, series, sources).collect()
    assert FA.events_on_series(event(dt.date(2020, 3, 1), "S9", "draft"), series, sources).collect() == []
