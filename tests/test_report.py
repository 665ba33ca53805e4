import numpy as np
import pytest

from evenkeel.operators import compare, report, stats

SCHEMA = "model string, question_id string, run_index int, response_text string"


def test_pairwise(spark):
    rows = [("m1", "q1", 0, "Same."), ("m2", "q1", 0, "same"), ("m3", "q2", 0, "alone"), ("m1", "q1", 1, "x"), ("m2", "q1", 1, "y")]
    rows += [("m1", "q1", 0, "zzz"), (None, "q1", 0, "same"), ("m4", "q1", None, "same")]
    got = {(r.model_a, r.model_b): r.similarity for r in compare.pairwise_model_similarity(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 9 and all(got[m, m] == 1.0 for m in ("m1", "m2", "m3"))
    assert got["m1", "m3"] == got["m3", "m1"] == 0.0
    assert got["m1", "m2"] == got["m2", "m1"]


def test_pairwise_first_answer_by_order(spark):
    rows = [("m1", "q1", 0, "b", 1), ("m1", "q1", 0, "a", 2), ("m2", "q1", 0, "b", 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", at int")
    got = {(r.model_a, r.model_b): r.similarity for r in compare.pairwise_model_similarity(df, ["at"]).collect()}
    assert got["m1", "m2"] == 1.0
    wide = {r.model: r for r in compare.similarity_matrix(compare.pairwise_model_similarity(df, ["at"])).collect()}
    assert wide["m2"].m1 == 1.0


def test_pairwise_against_plain(spark):
    rng = np.random.default_rng(3)
    rows = [
        (f"m{m}", f"q{q}", r, f"t{rng.integers(3)}") for m in range(6) for q in range(8) for r in range(4) if rng.random() < 0.7
    ]
    got = {(r.model_a, r.model_b): r.similarity for r in compare.pairwise_model_similarity(spark.createDataFrame(rows, SCHEMA)).collect()}
    cells = {(m, q, r): t for m, q, r, t in rows}
    for a in {r[0] for r in rows}:
        for b in {r[0] for r in rows}:
            both = [cells[a, q, r] == t for (m, q, r), t in cells.items() if m == b and (a, q, r) in cells]
            assert got[a, b] == pytest.approx(np.mean(both) if both else 0.0)


def test_tables_keep_only_present_columns(spark):
    df = spark.createDataFrame([("a", 0.5, "t"), ("b", 0.9, "t"), (None, 0.1, None)], "model string, token_f1 double, response_text string")
    quality = report.quality_by_model(df)
    assert quality.columns == ["model", "token_f1_avg", "token_f1_median"]
    assert [r.model for r in quality.collect()] == ["b", "a", None]
    assert report.performance_by_model(df).columns == ["note"]
    rates = {r.model: r for r in report.global_uniqueness(df).collect()}
    assert rates["a"].global_response_uniqueness_rate == 1.0 and rates[None].global_response_uniqueness_rate is None
    approx = {r.model: r.unique_outputs for r in report.global_uniqueness(df, approximate=True).collect()}
    assert approx == {"a": 1, "b": 1, None: 0}


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_medians_and_box(spark, limit):
    rng = np.random.default_rng(2)
    values = {"a": rng.exponential(size=400), "b": np.repeat(0.5, 30)}
    df = spark.createDataFrame([(m, float(v)) for m, vs in values.items() for v in vs], "model string, latency_ms double")
    perf = {r.model: r for r in report.performance_by_model(df, limit).collect()}
    boxes = {r.model: r for r in report.string_similarity_box(df, "latency_ms", limit).collect()}
    for m, v in values.items():
        assert perf[m].latency_ms_median == pytest.approx(np.median(v))
        q1, q3 = np.quantile(v, [0.25, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert (boxes[m].q1, boxes[m].q3) == pytest.approx((q1, q3))
        assert (boxes[m].whisker_low, boxes[m].whisker_high) == pytest.approx((inside.min(), inside.max()))
        assert boxes[m].outliers == len(v) - len(inside)


def test_interval_table_and_bars(spark):
    summary = spark.createDataFrame(
        [("a", 0.0625, 0.0005, 1.0), ("b", None, None, None), ("c", 0.2, 0.3, 0.1)],
        "model string, token_f1_mean_mean double, token_f1_mean_ci_low double, token_f1_mean_ci_high double",
    )
    table = report.mean_ci_table(summary, report.QUALITY_TITLES)
    assert [tuple(r) for r in table.collect()] == [
        ("a", "0.062 [0.001, 1.000]"), ("b", "nan [nan, nan]"), ("c", "0.200 [0.300, 0.100]")
    ]
    bars = {r.model: (r.whisker_low, r.whisker_high) for r in report.ci_bars(summary, ["token_f1_mean", "absent"]).collect()}
    assert bars == {"a": pytest.approx((0.062, 0.9375)), "b": (None, None), "c": (0.0, 0.0)}


def test_heatmap_and_least_reproducible(spark):
    agg = spark.createDataFrame(
        [("a", "q1", 0.5, 0.2, 0.9, 2), ("a", "q2", 0.7, 0.2, 1.0, 2), ("b", "q1", None, 1.0, 0.1, 2)],
        "model string, question_id string, token_f1_mean double, normalized_self_agreement_rate double, "
        "normalized_response_uniqueness_rate double, n_runs int",
    )
    wide = {r.model: r for r in report.token_f1_heatmap(agg, ["q1", "q2"]).collect()}
    assert (wide["a"].q1, wide["a"].q2, wide["b"].q1) == (0.5, 0.7, None)
    assert [(r.model, r.question_id) for r in report.least_reproducible(agg, 2).collect()] == [("a", "q2"), ("a", "q1")]
    assert stats.model_means(agg, ["token_f1_mean"]).count() == 2
