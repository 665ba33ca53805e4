import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.functions.hashing import numbered_hashes, seeded_hash
from evenkeel.operators import stats

SCHEMA = "model string, question_id string, x double, y double"


def table(spark):
    data = [("a", f"q{i}", float(i % 7), None) for i in range(60)]
    data += [("b", "q0", 0.7, float("nan")), ("b", "q1", float("nan"), None), (None, "q0", 9.0, 9.0)]
    return spark.createDataFrame(data, SCHEMA)


def test_interval_brackets_mean(spark):
    got = {r.model: r for r in stats.model_summary(table(spark), ["x", "y", "absent"], n_boot=300).collect()}
    a, b = got["a"], got["b"]
    assert set(got) == {"a", "b"} and (a.n_questions, b.n_questions) == (60, 2)
    assert a.x_ci_low < a.x_mean < a.x_ci_high
    assert (b.x_mean, b.x_ci_low, b.x_ci_high) == (0.7, 0.7, 0.7)
    assert a.y_mean is None and a.y_ci_low is None and b.y_ci_high is None


def test_interval_is_repeatable_and_depends_on_seed(spark):
    runs = [
        {r.model: (r.x_ci_low, r.x_ci_high) for r in stats.bootstrap_ci(table(spark).repartition(n), ["x"], 200, seed=s).collect()}
        for n, s in ((1, 1), (5, 1), (1, 2))
    ]
    assert runs[0] == runs[1] and runs[0] != runs[2]


def test_one_scheme_at_every_size(spark):
    """200,000 questions of one model: the interval is that of the plain draw formula."""
    n, boots = 200_000, 3
    values = [((i * 7919) % 1000) / 1000 for i in range(n)]
    rows = spark.range(n).selectExpr("'m' as model", "concat('q', id) as question_id", "(id * 7919 % 1000) / 1000 as x")
    ordered = sorted(values)
    means = []
    for r in range(boots):
        picks = (int(hashlib.md5(f"42|m|{r}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(n))
        means.append(sum(ordered[p] for p in picks) / n)
    got = stats.bootstrap_ci(rows, ["x"], boots).first()
    assert got.x_ci_low == pytest.approx(np.quantile(means, 0.025), abs=1e-9)
    assert got.x_ci_high == pytest.approx(np.quantile(means, 0.975), abs=1e-9)


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        stats.bootstrap_ci(table(spark), ["x"], ci=1.0)
    with pytest.raises(ValueError):
        stats.bootstrap_ci(table(spark), ["x"], n_boot=0)


def test_parts_of_a_model_add_up(spark):
    rows = spark.range(50).selectExpr("'m' AS model", "id % 9 / 3 AS x", "if(id < 20, id / 7, null) AS y")
    whole, cut = (
        {r.replicate: (r.x, r.y) for r in stats._replicates_by_draw(rows, ["x", "y"], 7, 42, part_ranks=n).collect()} for n in (1 << 22, 6)
    )
    assert whole.keys() == cut.keys() == set(range(7))
    for r in whole:
        assert cut[r] == pytest.approx(whole[r], abs=1e-12)


def test_draws_and_ranks_are_not_joined(spark):
    rows = spark.range(120_000).selectExpr("'m' AS model", "id / 7 AS x")
    plan = stats._replicates_by_draw(rows, ["x"], 8, 42)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(model") == 2


@pytest.mark.parametrize("prefix", ["42|m|0", "x" * 49, "x" * 54, "x" * 80, "42|mé|9"])
def test_numbered_hashes_are_those_of_the_column(spark, prefix):
    got = numbered_hashes(prefix, 95, 1010).tolist()
    assert got == [int(hashlib.md5(f"{prefix}|{i}".encode()).hexdigest()[:8], 16) for i in range(95, 1010)]
    assert got[:30] == [r[0] for r in spark.range(95, 125).select(seeded_hash(prefix, F.col("id"))).collect()]
