import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.special import incomplete_beta
from tidemark.operators import bootstrap as B
from tidemark.operators import regression as R
from tidemark.operators import signals as S
from tidemark.operators import stats as T


def frame(spark, n, seed, keys=("a", "b")):
    rng = np.random.default_rng(seed)
    data = []
    for k in keys:
        x = rng.normal(size=n)
        z = rng.normal(size=n) + 0.4 * x
        y = 0.3 - 0.8 * x + 0.2 * z + np.convolve(rng.normal(size=n + 2), [1, 0.6, 0.3], "valid")
        data += [(k, dt.date(2000 + i // 12, i % 12 + 1, 1), float(x[i]), float(z[i]), float(y[i])) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, month date, x double, z double, y double")


def numpy_hac(y, cols, lags):
    X = np.column_stack([np.ones(len(y)), *cols])
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    u = y - X @ b
    s = X * u[:, None]
    meat = s.T @ s
    for lag in range(1, lags + 1):
        g = s[lag:].T @ s[:-lag]
        meat += (1 - lag / (lags + 1)) * (g + g.T)
    v = inv @ meat @ inv
    return b, np.sqrt(np.diag(v)), 1 - (u @ u) / ((y - y.mean()) @ (y - y.mean()))


@pytest.mark.parametrize("xs", [["x"], ["x", "z"]])
def test_ols_hac_equals_matrix_form(spark, xs):
    data, df = frame(spark, 70, 5)
    got = {(r.k, r.variable): r for r in R.ols_hac(df, "y", xs, ["k"], 4).collect()}
    for k in ("a", "b"):
        rows = [r for r in data if r[0] == k]
        cols = [np.array([r[2 if c == "x" else 3] for r in rows]) for c in xs]
        b, se, r2 = numpy_hac(np.array([r[4] for r in rows]), cols, 4)
        for i, c in enumerate(xs, 1):
            g = got[(k, c)]
            assert g.coefficient == pytest.approx(b[i], abs=1e-12)
            assert g.se == pytest.approx(se[i], abs=1e-12)
            assert g.intercept == pytest.approx(b[0], abs=1e-12)
            assert g.r2 == pytest.approx(r2, abs=1e-12)
            assert g.p == pytest.approx(math.erfc(abs(b[i] / se[i]) / math.sqrt(2)), rel=1e-9)


def test_hac_lag_length_can_differ_by_group(spark):
    _, df = frame(spark, 60, 6)
    tagged = df.withColumn("lag_n", F.when(F.col("k") == "a", 2).otherwise(5))
    mixed = {r.k: r.se for r in R.ols_hac(tagged, "y", ["x"], ["k"], "lag_n", max_lags=5).collect()}
    two = {r.k: r.se for r in R.ols_hac(df, "y", ["x"], ["k"], 2).collect()}
    five = {r.k: r.se for r in R.ols_hac(df, "y", ["x"], ["k"], 5).collect()}
    assert mixed["a"] == pytest.approx(two["a"], abs=1e-13) and mixed["b"] == pytest.approx(five["b"], abs=1e-13)


def test_rows_beside_a_dropped_gap_are_neighbours(spark):
    data, df = frame(spark, 40, 7, ("a",))
    holed = df.withColumn("y", F.when(F.col("month") != dt.date(2001, 3, 1), F.col("y")))
    keep = [r for r in data if r[1] != dt.date(2001, 3, 1)]
    _, se, _ = numpy_hac(np.array([r[4] for r in keep]), [np.array([r[2] for r in keep])], 3)
    assert R.ols_hac(holed, "y", ["x"], ["k"], 3).first().se == pytest.approx(se[1], abs=1e-12)


def test_constant_regressor_gives_null_not_an_error(spark):
    df = spark.createDataFrame([("a", dt.date(2000, m, 1), 1.0, float(m)) for m in range(1, 9)], "k string, month date, x double, y double")
    row = R.ols_hac(df, "y", ["x"], ["k"], 2).first()
    assert row.coefficient is None and row.se is None and row.p is None
    assert T.pearson(df, "x", "y", ["k"]).first().r is None


def test_student_tail_known_values():
    # Closed forms: with 1 degree of freedom P(|T| > 1) = 0.5, with 2 it is 1 - 1/sqrt(3).
    assert incomplete_beta(0.5, 0.5, 1 / 2) == pytest.approx(0.5, abs=1e-14)
    assert incomplete_beta(1.0, 0.5, 2 / 3) == pytest.approx(1 - 1 / math.sqrt(3), abs=1e-14)
    assert incomplete_beta(3.0, 2.0, 0.0) == 0.0 and incomplete_beta(3.0, 2.0, 1.0) == 1.0


def test_spearman_uses_average_ranks(spark):
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in [(1, 5), (1, 6), (2, 6), (3, 7), (4, 9)]], "k string, x double, y double")
    rx, ry = np.array([1.5, 1.5, 3, 4, 5]), np.array([1, 2.5, 2.5, 4, 5])
    assert T.spearman(df, "x", "y", ["k"]).first().rho == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-12)


def test_block_sums_equal_resampled_rows():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=50), rng.normal(size=50)
    starts = B.block_starts(50, 6, 40, 42)
    assert starts.min() >= 0 and starts.max() <= 44
    take = (starts[:, :, None] + np.arange(6)).reshape(40, -1)[:, :50]
    want = [np.corrcoef(x[t], y[t])[0, 1] for t in take]
    assert B.resampled_corr(x, y, 6, starts) == pytest.approx(want, abs=1e-12)


def test_draws_are_spread_evenly():
    starts = B.block_starts(245, 6, 5000, 42).ravel()
    counts = np.bincount(starts, minlength=240)
    assert len(counts) == 240
    chi2 = ((counts - counts.mean()) ** 2 / counts.mean()).sum()
    assert chi2 < 239 + 4 * math.sqrt(2 * 239)


def test_bootstrap_short_group_is_null(spark):
    df = spark.createDataFrame([("a", dt.date(2000, m, 1), float(m), float(m * m)) for m in range(1, 5)], "k string, month date, x double, y double")
    row = B.block_bootstrap_corr(df, "x", "y", ["k"], block=6, n_boot=50).first()
    assert (row.n, row.ci_low, row.ci_high) == (4, None, None)


def brute_holm(ps):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, top = [0.0] * len(ps), 0.0
    for rank, i in enumerate(order):
        top = max(top, (len(ps) - rank) * ps[i])
        out[i] = min(1.0, top)
    return out


def test_holm_equals_step_down_for_any_number_of_blocks(spark):
    rng = np.random.default_rng(9)
    ps = [float(round(v, 2)) if i % 3 else float(v / 50) for i, v in enumerate(rng.random(120))]
    want = dict(enumerate(brute_holm(ps)))
    # Tied p-values get the same, largest adjustment of their run.
    for i, p in enumerate(ps):
        want[i] = max(want[j] for j in range(len(ps)) if ps[j] == p)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)] + [(999, None)], "i int, p double")
    for blocks in (2, 16):
        got = {r.i: r.p_holm for r in S.holm(df, "p", block_rows=blocks).collect()}
        assert got.pop(999) is None
        assert got == pytest.approx(want, abs=1e-12)


def test_wilson_interval(spark):
    low, high = T.wilson_ci(F.col("k"), F.col("n"))
    df = spark.createDataFrame([(3, 3), (0, 5), (0, 0)], "k int, n int").select(low, high)
    got = [tuple(r) for r in df.collect()]
    z2 = 1.959963984540054**2
    assert got[0] == pytest.approx((100 * 3 / (3 + z2), 100.0))
    assert got[1] == pytest.approx((0.0, 100 * z2 / (5 + z2)), abs=1e-9)
    assert got[2] == (None, None)


def test_direction_counts_treat_zero_as_unchanged(spark):
    df = spark.createDataFrame([("a", x, y) for x, y in [(1.0, -1.0), (-1.0, 1e-300), (2.0, 3.0), (0.0, 1.0), (1e-300, -1e-300), (None, 1.0)]], "k string, a double, b double")
    r = T.direction_counts(df, "a", "b", ["k"]).first()
    assert (r.n, r.opposite, r.same, r.unchanged) == (5, 3, 1, 1)


def test_corr_rows_against_resamples_built_row_by_row(spark):
    data, df = frame(spark, 47, 9)
    short = spark.createDataFrame([("short", dt.date(2000, m, 1), float(m * m), None, float(m)) for m in range(1, 5)] + [("flat", dt.date(2000, m, 1), 1.0, None, float(m)) for m in range(1, 9)], df.schema)
    got = {r.k: r for r in B.corr_rows(df.unionByName(short), "y", "x", ["k"], lags=3, block=6, n_boot=300, seed=5).collect()}
    starts = B.block_starts(47, 6, 300, 5)
    for k in ("a", "b"):
        rows = sorted((r[1], r[4], r[2]) for r in data if r[0] == k)
        y, x = (np.array([r[i] for r in rows]) for i in (1, 2))
        rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
        take = (starts[:, :, None] + np.arange(6)).reshape(300, -1)[:, :47]
        row = got[k]
        for r, low, high, (u, v) in ((row.r, row.ci_low, row.ci_high, (y, x)), (row.rho, row.rho_low, row.rho_high, (rank(y), rank(x)))):
            assert r == pytest.approx(np.corrcoef(u, v)[0, 1])
            assert (low, high) == pytest.approx(tuple(np.percentile([np.corrcoef(u[i], v[i])[0, 1] for i in take], [2.5, 97.5])))
        b, se, _ = numpy_hac(y, [x], 3)
        assert (row.slope, row.slope_high - row.slope) == pytest.approx((b[1], 1.959963984540054 * se[1]))
        assert row.n == 47 and 0 < row.p < 1 and row.p == pytest.approx(incomplete_beta(22.5, 0.5, 1 - row.r**2))
    assert got["short"].r is not None and got["short"].ci_low is None and got["short"].rho == pytest.approx(1.0)
    assert got["flat"].n == 8 and got["flat"].r is None and got["flat"].slope is None and got["flat"].rho_low is None


def test_measures_periods_and_versions(spark):
    rows = [("a", dt.date(2000, m, 1), float(m), None if m < 4 else float(-m), 2.0 * m) for m in range(1, 11)]
    df = spark.createDataFrame(rows, "k string, month date, y double, one double, two double")
    periods = [("early", "2000-01-01", "2000-05-01"), ("all", "2000-01-01", "2000-12-01")]
    long = T.by_measure_and_period(df, "y", {"one": "one", "two": "two"}, periods, ["k"], skip=[("one", "early")])
    got = {(r.measure, r.period): (r.n, r.r) for r in B.corr_rows(long, "y", "x", ["k", "measure", "period"], n_boot=20).collect()}
    assert {k: n for k, (n, _) in got.items()} == {("one", "all"): 7, ("two", "early"): 5, ("two", "all"): 10}
    assert got["one", "all"][1] == pytest.approx(-1.0)
    versions = T.by_version(df, {"first": ("y", "one"), "second": ("y", "two")}, ["k"])
    assert {r.version: r["count"] for r in versions.groupBy("version").count().collect()} == {"first": 7, "second": 7}
