import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.functions.hashing import seeded_hash
from evenkeel.operators import groups


def test_exact_quantiles_of_skewed_values(spark):
    rng = np.random.default_rng(1)
    values = {
        "spread": rng.lognormal(0, 3, 5000),
        "repeated": np.repeat([0.0, 1.0, 5.0], [3000, 1500, 501]),
        "two": np.array([1.0, 2.0]),
        None: rng.normal(size=777),
    }
    rows = [(k, float(v), float(-v)) for k, vs in values.items() for v in vs] + [("spread", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = groups.exact_quantiles(df, ["k"], ["x", "y"], probs).collect()
    assert len(got) == len(values) * 2 * len(probs)
    for r in got:
        v = values[r.k] if r.metric == "x" else -values[r.k]
        assert r.value == pytest.approx(np.quantile(v, r["quantile"]), abs=1e-9)


def test_exact_quantiles_beyond_the_sketch(spark):
    """A group of 400,000: the bracket holds a small part of it and both neighbours of each rank."""
    n = 400_000
    df = spark.range(0, n, 1, 8).select(((F.col("id") * 7919) % n / 8).alias("x"), F.lit("a").alias("k"))
    ties = spark.range(0, n, 1, 8).select(F.floor(F.col("id") % 3).cast("double").alias("x"), F.lit("b").alias("k"))
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {(r.k, r["quantile"]): r.value for r in groups.exact_quantiles(df.unionByName(ties), ["k"], ["x"], probs).collect()}
    for p in probs:
        assert got["a", p] == pytest.approx((n - 1) * p / 8, abs=1e-9)
        assert got["b", p] == np.quantile(np.arange(n) % 3, p)


def test_quantiles_without_keys(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    row = groups.aggregate_with_quantiles(df, [], [F.count("x").alias("n")], {"m": ("x", 0.5)}, 10).first()
    assert (row.n, row.m) == (1001, 500.0)


@pytest.mark.parametrize("k", [1, 7, 1500, 2500, 10_000])
def test_first_k_by_hash(spark, k):
    sizes = {"a": 4000, "b": 3, "c": 2000}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, i int")
    draw = seeded_hash(3, F.col("g"), F.col("i"))
    drawn = df.withColumn("d", draw).collect()
    expected = {
        (r.g, r.i)
        for g in sizes
        for r in sorted((r for r in drawn if r.g == g), key=lambda r: (r.d, r.i))[:k]
    }
    got = [(r.g, r.i) for r in groups.first_k_by_hash(df, ["g"], k, draw, ["i"]).collect()]
    assert len(got) == len(expected) and set(got) == expected
    overall = {(r.g, r.i) for r in sorted(drawn, key=lambda r: (r.d, r.i, r.g))[:k]}
    got = [(r.g, r.i) for r in groups.first_k_by_hash(df, [], k, draw, ["i", "g"]).collect()]
    assert len(got) == len(overall) and set(got) == overall


def test_pin_small_knows_its_size(spark):
    df = spark.range(50)
    pinned = groups.pin_small(df, 100)
    assert sorted(r.id for r in pinned.collect()) == list(range(50))
    assert "LocalTableScan" in pinned._jdf.queryExecution().executedPlan().toString()
    assert groups.pin_small(df, 10) is df


@pytest.mark.parametrize("margin", [1e-3, 4e-3])
def test_a_bracket_that_misses_is_widened(spark, margin, monkeypatch):
    """A coarse sketch and brackets far too narrow: long ties, far ends, infinities, null keys; no miss is left."""
    monkeypatch.setattr(groups, "SKETCH_ACCURACY", 3)
    rounds, once = [], groups._bracketed
    monkeypatch.setattr(groups, "_bracketed", lambda *a: rounds.append(a[3]) or once(*a))
    rng = np.random.default_rng(3)
    values = {
        "steps": np.repeat(rng.normal(size=40), rng.integers(1, 400, 40)),
        "far": np.concatenate([rng.normal(size=3000), 1e300 * rng.random(5), [float("inf")] * 3, [float("-inf")] * 2]),
        None: 1e-12 * rng.normal(size=2500) + 1,
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    probs = [0.0, 0.003, 0.5, 0.77, 1.0]
    got = {(r.k, r["quantile"]): r.value for r in groups.exact_quantiles(df, ["k"], ["x"], probs, margin).collect()}
    assert len(rounds) > 1 and len(got) == len(values) * len(probs)
    for (k, p), value in got.items():
        ordered = np.sort(values[k])
        at = (len(ordered) - 1) * p
        low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        assert value == pytest.approx(low if low == high else low + (at - np.floor(at)) * (high - low), rel=1e-12)


def test_first_ranks(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v), int(c)) for g in ("a", None) for v, c in zip(rng.permutation(900), rng.integers(1, 9, 900))]
    df = spark.createDataFrame(rows, "g string, value double, copies long").repartition(3)
    got = sorted((tuple(r) for r in groups.first_ranks(df, ["g"], 7).collect()), key=str)
    expected = []
    for g in ("a", None):
        total = 0
        for _, v, c in sorted(r for r in rows if r[0] == g):
            expected.append((g, v, c, total))
            total += c
    assert got == sorted(expected, key=str)
