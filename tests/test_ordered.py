import numpy as np
import pytest
from pyspark.sql import functions as F

from presage.operators import ordered
from presage.operators.histogram import distinct_with_null, histogram, share_over
from presage.operators.joins import latest_as_of, lookback_join, prefix_at
from presage.operators.ordered import column_quantiles, exact_quantiles, running


@pytest.fixture(autouse=True, params=[(16, 4), (8192, 1024)])
def path(request, monkeypatch):
    """The same plan with many buckets in a deep tree and with few in a flat one."""
    for name, value in zip(("BUCKET_ROWS", "FANOUT"), request.param):
        monkeypatch.setattr(ordered, name, value)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key and one value."""
    rng = np.random.default_rng(7)
    rows = [("hot", 5.0) for _ in range(1500)]
    rows += [("hot" if k < 0.5 else "cold", float(v)) for k, v in zip(rng.random(3000), rng.normal(5, 2, 3000).round(3))]
    rows += [("cold", None), (None, 1.0), (None, 2.0)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(8).cache()


def by_key(rows):
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    return groups


@pytest.mark.parametrize("descending", [False, True])
def test_running_equals_brute_force(skewed, descending):
    rows, df = skewed
    got = running(df, "v", {"n": ("sum", F.lit(1)), "top": ("max", F.col("v") * 2), "low": ("min", F.col("v"))},
                  ["k"], descending).collect()
    for key, values in by_key(rows).items():
        ours = sorted((r["v"], r["n"], r["n_run"], r["n_total"], r["top_run"], r["low_run"]) for r in got if r["k"] == key)
        a = np.array(values)
        want = []
        for v in sorted(set(values)):
            seen = a[a >= v] if descending else a[a <= v]
            want.append((v, int((a == v).sum()), len(seen), len(a), seen.max() * 2, seen.min()))
        assert ours == want


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_exact_quantiles_per_key(skewed, method):
    rows, df = skewed
    got = {r["k"]: r for r in exact_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.99}, ["k"], method).collect()}
    for key, values in by_key(rows).items():
        s = np.sort(values)
        for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
            want = np.quantile(s, q) if method == "linear" else s[int(np.floor((len(s) - 1) * q + 0.5))]
            assert got[key][name] == pytest.approx(want, abs=1e-12)


def test_column_quantiles(spark):
    rng = np.random.default_rng(3)
    a, b = rng.exponential(1, 20000), np.where(rng.random(20000) < 0.4, 7.0, rng.random(20000) * 10)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)], "a double, b double, c double").cache()
    got = {r["feature"]: r for r in column_quantiles(df, ["a", "b", "c"], {"p0": 0.0, "p50": 0.5, "p100": 1.0}).collect()}
    assert "c" not in got
    for name, values in (("a", a), ("b", b)):
        assert [got[name][p] for p in ("p0", "p50", "p100")] == pytest.approx(list(np.quantile(values, [0, 0.5, 1])), abs=1e-12)
    empty = df.where("a < 0")
    assert column_quantiles(empty, ["a"], {"p50": 0.5}).count() == 0
    assert exact_quantiles(empty, "a", {"p50": 0.5}).first()["p50"] is None


def test_brackets_stay_narrow_on_sorted_input(spark, monkeypatch):
    seen, plain = [], ordered.running
    monkeypatch.setattr(ordered, "running", lambda df, *a, **k: (seen.append(df.count()), plain(df, *a, **k))[1])
    df = spark.range(0, 1_000_000, 1, 100).select(F.col("id").cast("double").alias("x"))
    assert column_quantiles(df, ["x"], {"m": 0.5}).first()["m"] == 499_999.5
    assert seen[0] < 20_000


def test_one_exchange_after_the_collapse(spark, skewed):
    _, df = skewed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = running(df, "v", {"n": ("sum", F.lit(1))}, ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one of the rows, one of the bucket totals, and those of the small table of starts
    over_rows = [line for line in plan.splitlines() if "Exchange hashpartitioning(__at" in line]
    assert len(over_rows) == 2


def test_partition_count_does_not_matter(spark, skewed):
    _, df = skewed
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = exact_quantiles(df.repartition(n), "v", {"m": 0.37}, ["k"]).collect()
            seen.add(tuple(sorted((str(r["k"]), r["m"]) for r in rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_prefix_at_equals_pairs(spark):
    rng = np.random.default_rng(1)
    points = [(int(k), int(t), float(t % 17)) for k, t in zip(rng.integers(0, 3, 400), rng.integers(0, 300, 400))]
    probes = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(-5, 320, 60)))]
    got = prefix_at(
        spark.createDataFrame(points, "k long, t long, x double"), spark.createDataFrame(probes, "k long, t long, id long"),
        ["k"], "t", {"n": ("sum", F.lit(1)), "first": ("min", F.struct("t", "x")), "last": ("max", F.struct("t", "x"))},
    ).collect()
    assert len(got) == len(probes)
    for r in got:
        past = [(t, x) for k, t, x in points if k == r["k"] and t <= r["t"]]
        assert r["n_run"] == len(past)
        assert (tuple(r["first_run"]) if past else r["first_run"]) == (min(past) if past else None)
        assert (tuple(r["last_run"]) if past else r["last_run"]) == (max(past) if past else None)


def test_lookback_join_equals_pairs(spark):
    rng = np.random.default_rng(2)
    series = [(int(k), int(t)) for k, t in zip(rng.integers(0, 2, 300), rng.integers(-50, 500, 300))]
    anchors = [(int(k), int(t)) for k, t in zip(rng.integers(0, 2, 20), rng.integers(0, 520, 20))]
    got = lookback_join(
        spark.createDataFrame(anchors, "k long, at long"), spark.createDataFrame(series, "k long, t long"), "k", "at", "t", 60
    ).select("k", "at", "t").collect()
    assert sorted(map(tuple, got)) == sorted((k, a, t) for k, a in anchors for j, t in series if j == k and a - 60 <= t <= a)


def test_latest_as_of(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 10, "c")], "k long, t long, v string")
    assert [tuple(r) for r in latest_as_of(df, ["k"], "t", 9).collect()] == [(1, 9, "b")]


def test_histogram(spark):
    values = [0.0, 0.1, 0.9, 1.0, 1.0, 2.0, 10.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = histogram(df, "x", 10).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=10)
    assert [r["n"] for r in got] == counts.tolist()
    assert [r["bin_start"] for r in got] == pytest.approx(edges[:-1].tolist())
    flat = histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 4).collect()
    assert sum(r["n"] for r in flat) == 2
    assert share_over(df, "x", 0.95).first()[0] == pytest.approx(50.0)


def test_distinct_counts_null_once(spark):
    df = spark.createDataFrame([(1,), (None,), (None,), (2,)], "x int")
    assert df.agg(distinct_with_null("x")).first()[0] == 3
    assert df.where("x IS NOT NULL").agg(distinct_with_null("x")).first()[0] == 2


def test_buckets_stay_small_for_a_hot_key(spark):
    """A third of the rows under one key, most values in a narrow band."""
    rng = np.random.default_rng(9)
    values = np.where(rng.random(60000) < 0.9, rng.normal(100, 0.01, 60000), rng.exponential(1e6, 60000))
    df = spark.createDataFrame(
        [("hot" if i % 3 == 0 else str(i % 50), float(v)) for i, v in enumerate(values)], "k string, v double"
    ).repartition(6)
    rows, nodes = ordered.in_buckets(df, ["k", "v"])
    sizes = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "v")).alias("low"), F.max(F.struct("k", "v")).alias("high")).collect()
    assert max(r["n"] for r in sizes) <= ordered.BUCKET_ROWS and max(r["__bucket"] for r in sizes) < nodes
    sizes.sort(key=lambda r: r["__bucket"])
    assert all(a["high"] <= b["low"] for a, b in zip(sizes, sizes[1:]))
    total = running(df, "v", {"n": ("sum", F.lit(1))}, ["k"]).groupBy("k").agg(F.max("n_run").alias("a"), F.max("n_total").alias("b"))
    assert {r["k"]: r["a"] for r in total.collect()} == {r["k"]: r["b"] for r in total.collect()} == {
        r["k"]: r["count"] for r in df.groupBy("k").count().collect()
    }


def test_no_window_gets_more_than_a_bucket_or_a_block(spark, monkeypatch):
    """10^5 values in buckets of 4: the tree has many levels, and the driver has seen two numbers."""
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 4)
    monkeypatch.setattr(ordered, "FANOUT", 64)
    levels, real = [], ordered.before_each
    monkeypatch.setattr(ordered, "before_each", lambda totals, n, nodes, *a: (levels.append((totals.groupBy((F.col("__at.b") / 64).cast("long")).count().agg(F.max("count")).first()[0], nodes)), real(totals, n, nodes, *a))[1])
    df = spark.range(100_000).select(((F.col("id") * 7919) % 100_003).cast("double").alias("v"), (F.col("id") % 3).alias("x"))
    out = running(df, "v", {"n": ("sum", F.lit(1)), "s": ("sum", F.col("x")), "low": ("min", F.col("x"))})
    assert len(levels) >= 3 and max(n for n, _ in levels) <= 64 and levels[-1][1] <= 64
    got = out.agg(F.max("n_run"), F.max("s_run"), F.max("s_total"), F.count_if(F.col("low_run") > 1)).first()
    assert got[0] == 100_000 and got[1] == got[2] == df.agg(F.sum("x")).first()[0]
    want = df.orderBy("v").toPandas()["x"].cumsum().tolist()
    assert [r["s_run"] for r in out.orderBy("v").select("s_run").collect()] == want
