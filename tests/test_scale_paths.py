"""The ways taken for large units give the same rows as the ways taken for small ones."""

import random

import pytest
from pyspark.sql import functions as F

from trialweave.operators import bootstrap, exclude, order, quantiles, summarise
from trialweave.operators.units import profile_units, unit_join


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        user = "hot" if rng.random() < 0.35 else (None if rng.random() < 0.05 else f"u{rng.randrange(60)}")
        value = None if rng.random() < 0.1 else round(rng.expovariate(0.01), 2)
        rows.append((i, user, rng.choice("ab"), value))
    return spark.createDataFrame(rows, "i long, user string, kind string, v double").repartition(5)


@pytest.fixture(scope="module")
def small(log):
    return profile_units(log, ["user"])


@pytest.fixture(scope="module")
def large(log):
    p = profile_units(log, ["user"], rows_per_task=50, broadcast_bytes=5)
    splits = {r.user: r._splits for r in p.hot.collect()}
    assert splits["hot"] > 15 and not p.broadcastable(log.select("user"))
    return p


def test_alike_rows_of_a_hot_unit_use_every_salt(spark):
    df = spark.createDataFrame([("hot", 1)] * 400 + [("u", 2)], "user string, v int").repartition(4)
    p = profile_units(df, ["user"], rows_per_task=100, broadcast_bytes=0)
    side = df.groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    joined = unit_join(df, side, ["user"], "inner", p)
    same(joined, df.withColumn("n", F.when(F.col("user") == "hot", 400).otherwise(1)))
    plan = joined._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_chunks_hold_about_the_limit_whatever_the_spacing(spark):
    """Times that are dense in one second and far apart elsewhere."""
    rows = [("a", 10**15 + i) for i in range(900)] + [("a", 10**15 + 10**12 + i * 10**9) for i in range(100)] + [("b", i) for i in range(5)]
    df = spark.createDataFrame(rows, "u string, i long").withColumn("at", F.timestamp_micros("i"))
    p = profile_units(df, ["u"], rows_per_task=100, broadcast_bytes=0)
    chunks = order._chunked(df, ["u"], "at", p).groupBy("u", "_chunk").count().collect()
    sizes = [r["count"] for r in chunks if r.u == "a"]
    assert len(sizes) <= 11 and max(sizes) <= 130 and [r._chunk for r in chunks if r.u == "b"] == [0]
    got = order.sequence_number(df, ["u"], "at", "n", p).collect()
    assert all(r.n == 1 + sorted(x[1] for x in rows if x[0] == r.u).index(r.i) for r in got)


def test_rows_are_numbered_without_gaps(spark):
    df = spark.createDataFrame([(i * 7 % 501, i % 3) for i in range(501)], "a long, b long").repartition(6)
    got = order.number_rows(df, ["a"], "n", start=1).collect()
    assert sorted((r.a, r.n) for r in got) == [(i, i + 1) for i in range(501)]
    assert order.number_rows(df.limit(0), ["a"], "n").count() == 0


def test_poisson_counts():
    limits = bootstrap.poisson_limits()
    assert abs(limits[0] / 2**32 - 0.36787944117) < 1e-9 and limits == sorted(limits)
    # the expected count is one
    assert abs(sum(1 - x / 2**32 for x in limits) - 1) < 1e-8


def same(a, b):
    b = b.select(*a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_joins(log, small, large, how):
    side = log.filter("v > 20").groupBy("user").agg(F.max("i").alias("top")).filter("top % 2 = 0 or user = 'hot'")
    same(unit_join(log, side, ["user"], how, small), unit_join(log, side, ["user"], how, large))


def test_slow_trials(log, small, large):
    cut = lambda p: exclude.exclude_slow_trials(log, ["user"], "v", profile=p).select("i", "v")
    same(cut(small), cut(large))


def test_order_operators(log, small, large):
    for p, q in ((small, large),):
        same(order.cycle_number(log, ["user"], "i", 7, profile=p), order.cycle_number(log, ["user"], "i", 7, profile=q))
        same(order.carry_forward(log, ["user"], "i", "v", "f", p), order.carry_forward(log, ["user"], "i", "v", "f", q))


def test_quantiles(log):
    probs = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.9, "e": 1.0}
    for by in (["user"], ["kind"], []):
        a = quantiles.group_quantiles(log, by, "v", probs).toPandas()
        b = quantiles.group_quantiles(log, by, "v", probs, group_limit=0).toPandas()[a.columns]
        if by:
            a, b = a.sort_values(by, ignore_index=True), b.sort_values(by, ignore_index=True)
        assert ((a[list(probs)] - b[list(probs)]).abs().max() < 1e-9).all()


def test_bootstrap_joins_agree(log):
    units = summarise.stage_means(log, [["user", "kind"]], "v")
    a = bootstrap.percentile_ci(units, ["kind"], ["user"], "v", 50)
    b = bootstrap.percentile_ci(units.repartition(3), ["kind"], ["user"], "v", 50, broadcast_bytes=0)
    key = lambda df: sorted((r.kind, round(r.ci_low, 9), round(r.ci_high, 9)) for r in df.collect())
    assert key(a) == key(b)


def test_bootstrap_contains_mean_and_narrows(spark):
    rng = random.Random(2)
    wide = {}
    for n in (30, 480):
        df = spark.createDataFrame([("g", i, rng.gauss(10, 3)) for i in range(n)], "g string, u int, v double")
        mean = df.agg(F.avg("v")).first()[0]
        r = bootstrap.percentile_ci(df, ["g"], ["u"], "v", 200).first()
        assert r.ci_low < mean < r.ci_high
        wide[n] = r.ci_high - r.ci_low
    assert wide[480] < wide[30] / 2


def test_row_level_plan_does_not_shuffle_the_log(log, small):
    plan = exclude.exclude_slow_trials(log, ["user"], "v", profile=small)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_refuses_huge_tables(log):
    with pytest.raises(ValueError):
        summarise.contingency(log, ["user", "kind"], max_cells=10)
    assert summarise.contingency(log, ["user", "kind"], max_cells=122).count() == 122
