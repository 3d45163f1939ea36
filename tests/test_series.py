import datetime as dt
import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import panel as P
from tidemark.operators import percentile as PC
from tidemark.operators import scan as SN
from tidemark.operators import signals as S


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def series(spark, values, key="a"):
    data = [(key, month(i), float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(data, "series_id string, month date, value double")


def test_on_spine_equals_join_to_the_calendar(spark):
    df = series(spark, [1, None, None, 4, 5, None, 7]).unionByName(series(spark, [None, 2], "b"))
    joined = P.join_on_spine(P.month_spine(df, ["series_id"]), (df, ["series_id", "month"]))
    assert rows(P.on_spine(df, ["series_id"])) == rows(joined)
    assert P.on_spine(df, ["series_id"]).count() == 8


def test_changes_are_null_next_to_a_gap(spark):
    df = P.on_spine(series(spark, [1, 2, None, 4, 8]), ["series_id"])
    got = [r.value_pct_m for r in P.monthly_changes(df, ["value"], ["series_id"]).orderBy("month").collect()]
    assert got == [None, 100.0, None, None, 100.0]


def test_zero_and_negative_prices_give_null_not_an_error(spark):
    df = series(spark, [0, 5, -5, 5])
    got = [r.value_logret_m for r in P.monthly_changes(df, ["value"], ["series_id"]).orderBy("month").collect()]
    assert got == [None, None, None, None]


def test_monthly_rollup_and_incomplete_last_month(spark):
    days = [("a", dt.date(2020, 1, d), float(d)) for d in (2, 10, 30)] + [("a", dt.date(2020, 2, 3), 9.0)]
    m = P.to_monthly(spark.createDataFrame(days, "series_id string, date date, value double"), ["series_id"])
    assert rows(m) == [("a", dt.date(2020, 1, 1), 14.0, 3, dt.date(2020, 1, 30), 30.0), ("a", dt.date(2020, 2, 1), 9.0, 1, dt.date(2020, 2, 3), 9.0)]
    assert P.drop_incomplete_last(m, ["series_id"]).count() == 1


def test_forward_changes_end_in_null(spark):
    got = P.forward_changes(series(spark, [1, 2, 4, 8]), ["value"], [2], ["series_id"]).orderBy("month").collect()
    assert [r.value_fwd_2m_pct for r in got] == [300.0, 300.0, None, None]


def brute_percentile(values, warmup, lookback=None):
    out = []
    for i, v in enumerate(values):
        past = values[:i] if lookback is None else values[max(0, i - lookback):i]
        n = i if lookback is None else lookback
        out.append(None if i < warmup else sum(p <= v for p in past) * 100.0 / n)
    return out


def test_past_percentiles_count_ties_and_never_look_ahead(spark):
    rng = random.Random(1)
    values = [float(rng.randint(0, 9)) for _ in range(60)]
    df = series(spark, values)
    got = df.select(
        "month", PC.past_percentile("value", ["series_id"], 12).alias("p"), PC.trailing_percentile("value", ["series_id"], 10, 12).alias("q")
    ).orderBy("month").collect()
    assert [r.p for r in got] == brute_percentile(values, 12)
    assert [r.q for r in got] == brute_percentile(values, 12, 10)


def test_long_percentile_equals_brute_force_on_both_paths(spark):
    rng = random.Random(2)
    data, want = [], {}
    for key, n in (("hot", 200), ("cold", 9)):
        # Positions with gaps and many equal values.
        pos = sorted(rng.sample(range(512), n))
        values = [float(rng.randint(0, 12)) for _ in pos]
        for i, (p, v) in enumerate(zip(pos, values)):
            data.append((key, p, v))
            past = values[:i]
            want[(key, p)] = None if i < 5 else sum(x <= v for x in past) * 100.0 / i
    df = spark.createDataFrame(data, "k string, pos int, v double")
    for base, plain in ((0, 16), (0, 3), (2, 5), (9, 16)):
        out = PC.past_percentile_long(df, "v", ["k"], "pos", 9, 5, "p", base_log2=base, plain_levels=plain, block_rows=20)
        got = {(r.k, r.pos): r.p for r in out.collect()}
        assert got == want


def test_long_percentile_has_no_span_of_its_own(spark):
    rng = random.Random(4)
    pos = sorted([*rng.sample(range(-900, 3000), 120), 1 << 40])
    values = [float(rng.randint(0, 9)) for _ in pos]
    want = {p: None if i < 2 else sum(x <= v for x in values[:i]) * 100.0 / i for i, (p, v) in enumerate(zip(pos, values))}
    df = spark.createDataFrame([("a", p, v) for p, v in zip(pos, values)], "k string, pos long, v double")
    for most in (None, 5):
        out = PC.past_percentile_long(df, "v", ["k"], "pos", most, 2, "p", base_log2=2)
        assert {r.pos: r.p for r in out.collect()} == want
    with pytest.raises(ValueError):
        PC.past_percentile_long(df.withColumn("pos", F.lit(None).cast("long")), "v", ["k"], "pos", None, 2, "p")


def test_blocked_scans_equal_plain_windows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.8 else "cold", float(i), rng.randint(-5, 5)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, o double, v int")
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("k", "o", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"))
    blocked = SN.running_max(SN.running_sum(df, ["k"], "o", "v", "s", 20), ["k"], "o", "v", "m", 9).select("k", "o", "s", "m")
    assert rows(plain) == rows(blocked)


def test_blocks_follow_the_rows_and_tied_values_are_split(spark):
    rng = random.Random(8)
    names = [f"customer#{i:06d}" + ("é" if i % 2 else "") for i in range(900)]
    data = [("hot", 5.0, n, 1.0) for n in names] + [("hot", None, n + "z", 1.0) for n in names[:400]] + [("cold", float(i), "same", 1.0) for i in range(50)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, v double, name string, w double")
    blocks = SN.block_ids(df.withColumn("o", F.coalesce("v", F.lit(float("inf")))), ["k"], "o", 60, ["name"])
    sizes = {(r.k, tuple(r._b)): r["count"] for r in blocks.groupBy("k", "_b").count().collect()}
    assert sum(k == "hot" for k, _ in sizes) > 10 and max(sizes.values()) <= 120 and sum(k == "cold" for k, _ in sizes) == 1
    out = SN.rank_rows(df, ["k"], F.col("v"), ["name"], "rank", block_rows=60, also_sum="w").collect()
    for key in ("hot", "cold"):
        mine = sorted((r for r in out if r.k == key), key=lambda r: (r.v is None, r.v or 0, r.name))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) == [int(r.running_w) for r in mine]


def test_ties_of_every_type_keep_their_order(spark):
    values = "(1, -3.5D, DATE'2001-02-03', true, TIMESTAMP'2001-02-03 04:05:06', 'ab'), (2, -3.5D, DATE'2001-02-04', false, TIMESTAMP'2001-02-03 04:05:07', 'a'), (3, NULL, NULL, NULL, NULL, NULL), (4, 0D, DATE'1969-01-01', true, TIMESTAMP'1960-01-01', 'é')"
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t(i, d, day, flag, at, name)").withColumn("o", F.lit(1.0)).crossJoin(spark.range(30).select(F.col("id").alias("copy")))
    for tie in ("d", "day", "flag", "at", "name"):
        got = {(r.i, r.copy): r.n for r in SN.rank_rows(df, [], F.col("o"), [tie, "i", "copy"], "n", block_rows=7).collect()}
        want = df.orderBy(tie, "i", "copy").select("i", "copy").collect()
        assert got == {(r.i, r.copy): n for n, r in enumerate(want, 1)}


def test_carry_forward_include_current(spark):
    df = spark.createDataFrame([("a", i, "h" + str(i) if i % 10 == 0 else None) for i in range(1, 45)], "k string, o int, v string")
    for block in (1, 8, 100):
        out = SN.carry_forward(df, ["k"], "o", F.col("v"), "last", include_current=True, block_rows=block)
        want = {i: (f"h{i // 10 * 10}" if i >= 10 else None) for i in range(1, 45)}
        assert {r.o: r["last"] for r in out.collect()} == want


def brute_episodes(on, horizon):
    out, last, eid = [], None, 0
    for i, flag in enumerate(on):
        if not flag:
            out.append((None, 0))
            continue
        start = last is None or i - last > horizon
        eid += start
        out.append((eid, int(start)))
        last = i
    return out


def test_episodes_split_only_when_the_gap_exceeds_the_horizon(spark):
    rng = random.Random(4)
    for horizon in (1, 3, 6):
        on = [int(rng.random() < 0.3) for _ in range(80)]
        df = spark.createDataFrame([("a", i, f) for i, f in enumerate(on)], "k string, n int, signal_on int")
        got = S.episodes(df, ["k"], "n", F.lit(horizon)).orderBy("n").collect()
        assert [(r.episode_id, r.is_episode_start) for r in got] == brute_episodes(on, horizon)


def test_date_gaps_and_records(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, d)) for d in (1, 1, 4, 20)], "k string, date date")
    assert [r.gap_days for r in P.date_gaps(df, ["k"]).orderBy("date").collect()] == [None, 3, 16]
    rec = series(spark, [3, 2, 3, 5, 4]).select("month", P.is_record("value", ["series_id"]).alias("r")).orderBy("month")
    assert [r.r for r in rec.collect()] == [1, 0, 1, 1, 0]


def test_pair_ratio_needs_both_legs(spark):
    df = series(spark, [2, 4, None, 8], "a").unionByName(series(spark, [1, None, 3, 4], "b"))
    pairs = spark.createDataFrame([("a/b", "a", "b"), ("b/a", "b", "a")], "pair_id string, num string, den string")
    got = [(r.pair_id, r.month, r.ratio) for r in P.pair_ratio(df, pairs).orderBy("pair_id", "month").collect()]
    assert got == [("a/b", month(0), 2.0), ("a/b", month(3), 2.0), ("b/a", month(0), 0.5), ("b/a", month(3), 0.5)]
