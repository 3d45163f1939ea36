import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import governance as G
from tidemark.operators import quality as Q


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def status(df):
    return [r.status for r in df.collect()]


def test_gaps_and_duplicates(spark):
    good = spark.createDataFrame([("a", month(i)) for i in range(4)], "k string, month date")
    assert status(Q.check_no_gaps(good, ["k"], "t")) == ["PASS"]
    assert status(Q.check_no_gaps(good.where(F.col("month") != month(1)), ["k"], "t")) == ["WARN"]
    # A duplicate must not hide a missing month.
    hidden = good.where(F.col("month") != month(1)).unionByName(good.where(F.col("month") == month(2)))
    assert status(Q.check_no_gaps(hidden, ["k"], "t")) == ["WARN"]
    assert status(Q.check_unique(hidden, ["k", "month"], "t")) == ["FAIL"]


def test_identity_ignores_unknown_but_counts_violations(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, None), (1.0, 2.0)], "a double, b double")
    r = Q.check_identity(df, F.abs(F.col("a") - F.col("b")) > 1e-9, "t", "a = b").first()
    assert (r.status, r.detail) == ("FAIL", "1 violations in 3 rows")


def test_equal_needs_the_same_nulls_and_keys(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    assert status(Q.check_equal(a, a, ["k"], ["v"], 0.0, "t")) == ["PASS"]
    assert status(Q.check_equal(a, a.fillna(0.0), ["k"], ["v"], 0.0, "t")) == ["FAIL"]
    assert status(Q.check_equal(a, a.where("k < 3"), ["k"], ["v"], 0.0, "t")) == ["FAIL"]


def test_profile_finds_changed_new_and_missing(spark):
    def prof(data):
        df = spark.createDataFrame(data, "t string, n int")
        return Q.profile(df, ["t"], ["n"], [["t"]], "n")

    now = prof([("a", 1), ("a", 2), ("b", None), (None, 5)])
    got = {(r.grouping, r.key_value): r for r in now.collect()}
    n = got[("column:n", "ALL")]
    assert (n.n_rows, n.n_values, n.n_distinct, n.sum_value, n.min_num, n.max_num) == (4, 3, 3, 8.0, 1.0, 5.0)
    assert got[("group:t", "")].sum_value == 5.0 and got[("column:t", "ALL")].max_text == "b"
    frozen = prof([("a", 1), ("a", 2), ("c", 5)])
    diffs = {(r.grouping, r.key_value): r.difference for r in Q.diff_profile(now, frozen).collect()}
    assert diffs[("group:t", "b")] == "new" and diffs[("group:t", "c")] == "missing" and diffs[("column:n", "ALL")] == "changed"
    assert ("group:t", "a") not in diffs and Q.diff_profile(now, now).count() == 0


def test_episode_check_sees_a_wrong_start(spark):
    ok = [("a", 1, 2, 1, 1, 1), ("a", 2, 2, 0, None, 0), ("a", 3, 2, 1, 1, 0), ("a", 9, 2, 1, 2, 1)]
    cols = "k string, n int, horizon int, signal_on int, episode_id int, is_episode_start int"
    assert status(Q.check_episode(spark.createDataFrame(ok, cols), ["k"], "n", "t")) == ["PASS", "PASS"]
    bad = ok[:3] + [("a", 9, 2, 1, 1, 0)]
    assert sorted(status(Q.check_episode(spark.createDataFrame(bad, cols), ["k"], "n", "t"))) == ["FAIL", "PASS"]


def test_foreign_keys_and_empty_ids(spark):
    reg = spark.createDataFrame([("S1",), ("S2",)], "id string")
    df = spark.createDataFrame([("S1",), (None,), ("S9",), ("S9",)], "id string")
    r = Q.check_fk(df, reg, "id", "t").first()
    assert (r.status, r.detail) == ("FAIL", "1 unknown ids; 1 rows without one")
    assert rows(Q.unused_ids(reg, [df], "id")) == [("S2",)]


def test_runner_skips_what_is_not_present_and_keeps_the_order(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    out = Q.run_checks(spark, [("b", ["x"], None), ("a", ["t"], Q.check_unique(df, ["k"], "t"))], ["t"], "2026-01-01").orderBy("check_no").collect()
    assert [(r.check_no, r.status) for r in out] == [(1, "INFO"), (2, "FAIL")]
    assert "needs x" in out[0].detail


def test_stop_on_first_failed_figure(spark):
    df = spark.createDataFrame([("A", 1.0, 1.004, 0.005, None, None), ("B", None, None, None, "x", "x")], "figure_id string, expected double, computed double, tolerance double, expected_text string, computed_text string")
    Q.stop_on_failure(Q.check_figures(df))
    with pytest.raises(ValueError, match="'A'"):
        Q.stop_on_failure(Q.check_figures(df.withColumn("tolerance", F.lit(0.001))))


def test_redaction_and_trim(spark):
    df = spark.createDataFrame([("paid", "d", "secret"), ("paid", "keep", "figure"), (None, "d", "open")], "table_name string, description string, detail string")
    got = G.redact(df, F.col("table_name") == "paid", F.col("description") == "keep", "withheld")
    assert [r.detail for r in got.collect()] == ["withheld", "figure", "open"]
    assert rows(G.trim_restricted(df, ["detail"], F.col("table_name") == "paid")) == [(None, "d")]


def test_scan_finds_every_leak_in_a_long_text(spark):
    text = "x" * 2_000_000 + " p.q@r.co_s@t.org mail a.b@c.org and C:\\Users\\me " + "y" * 50_000 + " /home/joe a.b@c.org"
    df = spark.createDataFrame([(1, text), (2, "clean"), (3, None), (4, "a.b@c.org")], "i int, text string")
    got = {(r.pattern, r["match"]): (r.n_rows, r.n_hits) for r in G.scan_text(df, "text").collect()}
    assert got[("email", "a.b@c.org")] == (2, 3)
    assert ("email", "p.q@r.co") in got and ("email", "_s@t.org") in got
    assert ("local_path", "C:\\Users\\") in got and ("local_path", "/home/joe") in got


def test_provenance_finds_stale_citations(spark):
    checks = spark.createDataFrame([(1, "t1", "x", "PASS"), (2, "t2", "y", "INFO")], "check_no int, table_name string, description string, status string")
    ds = spark.createDataFrame([("d1", "t1"), ("d2", "t2")], "dataset string, table_name string")
    man = spark.createDataFrame([("t1", "S1"), ("t2", "S2")], "table_name string, sources string")
    prov = G.provenance(ds, man, checks)
    cited = G.cited_checks(ds, checks)
    assert rows(G.check_provenance(cited, prov, checks)) == [("d2", "no judged check", 1)]
    changed = checks.withColumn("status", F.when(F.col("check_no") == 1, "FAIL").otherwise(F.col("status")))
    assert rows(G.check_provenance(cited, prov, changed)) == [("d1", "cited check not shown", 1), ("d2", "no judged check", 1)]


def test_a_text_of_many_hits_is_scanned_in_linear_time(spark):
    import time

    text = " ".join(f"user{i % 20000}@example{i % 7}.com" for i in range(50_000))
    df = spark.createDataFrame([(text,), ("a@b.org a@b.org",), (None,)], "text string")
    start = time.perf_counter()
    out = {r.match: (r.n_rows, r.n_hits) for r in G.scan_text(df, "text").where("pattern = 'email'").collect()}
    assert time.perf_counter() - start < 60
    assert out["a@b.org"] == (1, 2) and sum(h for _, h in out.values()) == 50_002


def test_lists_of_too_many_values_stop_before_they_are_made(spark):
    from tidemark.operators import tables as TB

    df = spark.createDataFrame([("a", f"v{i:03d}") for i in range(30)] * 2 + [("b", "x")], "k string, v string")
    assert {r.k: len(r.vs.split(", ")) for r in TB.list_values(df, ["k"], "v", "vs", most=30).collect()} == {"a": 30, "b": 1}
    with pytest.raises(ValueError, match="more than 29 values of v"):
        TB.list_values(df, ["k"], "v", "vs", most=29)


def test_provenance_lists_the_checks_in_order(spark):
    sets = spark.createDataFrame([("d1", "t", "job"), ("d2", "none", "job")], "dataset string, table_name string, writer string")
    man = spark.createDataFrame([("t", "S1", True)], "table_name string, sources string, large_ok boolean")
    checks = spark.createDataFrame([(2, "t", "second", "PASS"), (1, "t", "first", "INFO"), (3, "u", "other", "FAIL")], "check_no int, table_name string, description string, status string")
    got = {r.dataset: r for r in G.provenance(sets, man, checks).collect()}
    assert [tuple(c) for c in got["d1"].checks] == [(1, "first", "INFO"), (2, "second", "PASS")] and got["d1"].n_judged == 1
    assert got["d2"].checks == [] and got["d2"].n_checks == 0
