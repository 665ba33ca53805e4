import math

import pytest

from evenkeel.operators import repro

SCHEMA = "model string, question_id string, run_index int, response_text string, gold_answer string, token_f1 double"


def rows(n=4):
    return [
        (m, q, r, "alpha" if r % 2 else "Alpha.", "alpha", 0.25 * r) for m in ("a", "b") for q in ("q1", "q2") for r in range(n)
    ]


def test_full_stop_is_the_same_answer(spark):
    df = spark.createDataFrame(
        [("m", "q1", 0, "Yes it is", "g", 0.5), ("m", "q1", 1, "Yes it is.", "g", 0.7)], SCHEMA
    )
    row = repro.compute_aggregates(df).first()
    assert (row.n_runs, row.unique_responses, row.unique_normalized_responses) == (2, 2, 1)
    assert row.normalized_self_agreement_rate == 1.0 and row.normalized_response_uniqueness_rate == 0.5
    assert row.token_f1_mean == pytest.approx(0.6) and row.token_f1_median == pytest.approx(0.6)
    assert row.avg_response_length == 9.5


def test_null_keys_null_texts_and_nan(spark):
    data = [
        (None, "q1", 0, None, "g", float("nan")),
        (None, "q1", 1, None, "g", 0.5),
        (None, "q1", None, "x", "g", None),
        ("m", "q1", 0, "x", "g", 1.0),
    ]
    got = {r.model: r for r in repro.compute_aggregates(spark.createDataFrame(data, SCHEMA)).collect()}
    lost = got[None]
    assert (lost.n_runs, lost.unique_responses, lost.modal_normalized_response_count) == (2, 1, 2)
    assert lost.token_f1_mean == 0.5 and lost.token_f1_std is None
    assert got["m"].token_f1_std is None and got["m"].normalized_self_agreement_rate == 1.0
    named = {r.model: r for r in repro.compute_aggregates(spark.createDataFrame(data, SCHEMA), missing_text="nan").collect()}
    assert (named[None].unique_responses, named[None].avg_response_length) == (1, pytest.approx(7 / 3))


def test_no_runs_gives_null_rates(spark):
    df = spark.createDataFrame([("m", "q1", None, "x", "g", 1.0)], SCHEMA)
    row = repro.compute_aggregates(df).first()
    assert row.n_runs == 0 and row.normalized_self_agreement_rate is None and row.response_uniqueness_rate is None


def test_large_group_path_gives_the_same_table(spark):
    data = rows(9) + [("a", "hot", r, f"text {r % 3}", "g", (r * 37 % 101) / 7) for r in range(500)]
    data += [(None, "hot", r, "t", "g", float(r)) for r in range(60)]
    df = spark.createDataFrame(data, SCHEMA)
    key = lambda r: (r.model or "", r.question_id)
    small = sorted(repro.compute_aggregates(df).collect(), key=key)
    large = sorted(repro.compute_aggregates(df, in_memory_rows=20).collect(), key=key)
    assert [r.asDict().keys() for r in small] == [r.asDict().keys() for r in large]
    for a, b in zip(small, large):
        for name, value in a.asDict().items():
            assert b[name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), name
    assert sorted(map(str, repro.metric_stats(df, 20).collect())) == sorted(
        str(r) for r in repro.compute_aggregates(df, in_memory_rows=20).select(*repro.metric_stats(df).columns).collect()
    )


def test_group_ratio_keeps_every_row(spark):
    data = rows() + [(None, "q1", 0, "x", "g", 1.0)]
    got = repro.group_ratio(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    assert {(r.is_unique_response, r.is_unique_normalized_response) for r in got} == {(0.5, 0.25), (None, None)}


def test_semantic_columns(spark):
    agg = repro.compute_aggregates(spark.createDataFrame(rows(), SCHEMA))
    assert "semantic_self_similarity_mean" not in agg.columns
    side = spark.createDataFrame(
        [("a", "q1", 0.91, 0.01, 6), ("a", "q2", 0.88, 0.02, 6)],
        "model string, question_id string, semantic_self_similarity_mean double, "
        "semantic_self_similarity_std double, n_semantic_pairs long",
    )
    merged = repro.compute_aggregates(spark.createDataFrame(rows(), SCHEMA), side).collect()
    assert {r.semantic_self_similarity_mean for r in merged} == {0.91, 0.88, None} and len(merged) == 4
    assert not any(isinstance(v, float) and math.isnan(v) for r in merged for v in r)


def test_raw_counts_skip_missing_text_under_the_nan_policy(spark):
    from evenkeel.operators import report

    rows = spark.createDataFrame(
        [("m", "q", 0, None), ("m", "q", 1, "a")], "model string, question_id string, run_index int, response_text string"
    )
    told = repro.run_stats(rows, missing_text="nan").first()
    assert told.unique_responses == 1 and told.unique_normalized_responses == 2
    overall = report.global_uniqueness(rows, missing_text="nan").first()
    assert (overall.total_outputs, overall.unique_outputs, overall.unique_normalized_outputs) == (1, 1, 2)
