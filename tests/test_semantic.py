from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evenkeel.functions import pairs, vectors
from evenkeel.operators import semantic
from evenkeel.operators.score import score_semantic
from evenkeel.plans.derived import hash_encoder

SCHEMA = "model string, question_id string, run_index int, response_text string"


def runs(spark, sizes):
    rows = [("m", q, r, f"word{r % 7} common text {r % 3}") for q, n in sizes.items() for r in range(n)]
    return spark.createDataFrame(rows + [(None, "q", 0, "x")], SCHEMA)


def test_all_pairs_or_a_sample(spark):
    df = runs(spark, {"four": 4, "twenty": 20, "one": 1, "ten": 10})
    got = semantic.run_pairs(df, 10).collect()
    per = Counter(r.question_id for r in got)
    assert per == {"four": 6, "twenty": 10, "ten": 10}
    assert all(r.run_i < r.run_j for r in got) and len({(r.question_id, r.run_i, r.run_j) for r in got}) == len(got)
    assert all(r.text_i == f"word{r.run_i % 7} common text {r.run_i % 3}" for r in got)
    key = lambda r: (r.question_id, r.run_i, r.run_j)
    assert sorted(map(key, got)) == sorted(map(key, semantic.run_pairs(df.repartition(5), 10).collect()))
    assert sorted(map(key, got)) != sorted(map(key, semantic.run_pairs(df, 10, seed=1).collect()))
    assert Counter(r.question_id for r in semantic.run_pairs(df, 45).collect())["ten"] == 45


def test_sample_is_even_over_runs(spark):
    df = spark.createDataFrame([("m", f"q{q}", r, "t") for q in range(300) for r in range(12)], SCHEMA)
    got = semantic.run_pairs(df, 6).collect()
    assert len(got) == 1800
    seen = Counter(x for r in got for x in (r.run_i, r.run_j))
    assert min(seen.values()) > 220 and max(seen.values()) < 380  # expected 300 each
    pairs = Counter((r.run_i, r.run_j) for r in got)
    assert len(pairs) == 66 and max(pairs.values()) < 60  # expected 27 each


def test_large_group_and_large_budget(spark):
    big = semantic.run_pairs(runs(spark, {"hot": 5000, "few": 3}), 45).collect()
    assert Counter(r.question_id for r in big) == {"hot": 45, "few": 3}
    wide = semantic.run_pairs(runs(spark, {"hot": 1500}), 600).collect()
    assert len({(r.run_i, r.run_j) for r in wide}) == 600


def test_semantic_repro(spark):
    df = runs(spark, {"four": 4, "one": 1, "two": 2})
    got = {r.question_id: r for r in semantic.semantic_repro(df, hash_encoder).collect()}
    assert set(got) == {"four", "one", "two"}
    assert (got["one"].semantic_self_similarity_mean, got["one"].n_semantic_pairs) == (None, 0)
    assert got["two"].semantic_self_similarity_std is None and got["two"].n_semantic_pairs == 1
    encode = hash_encoder()
    texts = [f"word{r % 7} common text {r % 3}" for r in range(4)]
    f1 = [plain_match(*encode([texts[i], texts[j]]))[2] for i in range(4) for j in range(i + 1, 4)]
    assert got["four"].semantic_self_similarity_mean == pytest.approx(np.mean(f1), abs=1e-12)
    assert got["four"].semantic_self_similarity_std == pytest.approx(np.std(f1), abs=1e-12)


def plain_match(a, b):
    cos = [[float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) for y in b] for x in a]
    p = np.mean([max(row) for row in cos])
    r = np.mean([max(col) for col in zip(*cos)])
    return p, r, 2 * p * r / (p + r)


def test_match_vectors_and_texts(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(3, 4)), rng.normal(size=(5, 4))
    df = spark.createDataFrame(
        [(a.tolist(), b.tolist()), ([], b.tolist()), (None, b.tolist())], "x array<array<double>>, y array<array<double>>"
    )
    got = [tuple(r.m) for r in df.select(vectors.match_vectors(F.col("x"), F.col("y")).alias("m")).collect()]
    assert got[0] == pytest.approx(plain_match(a, b), abs=1e-12)
    assert got[1] == (0.0, 0.0, 0.0) and got[2] == (None, None, None)
    texts = spark.createDataFrame(
        [("q1", "a b c", "c b"), ("q1", "", "a"), ("q2", None, "a"), ("q2", "same", "same")],
        "question_id string, response_text string, gold_answer string",
    )
    rows = {r.response_text: r for r in score_semantic(texts, hash_encoder, batch_size=2).collect()}
    expected = plain_match(*hash_encoder()(["a b c", "c b"]))
    row = rows["a b c"]
    assert (row.bertscore_precision, row.bertscore_recall, row.bertscore_f1) == pytest.approx(expected, abs=1e-12)
    assert rows[""].bertscore_f1 == 0.0 and rows[None].bertscore_f1 is None
    assert rows["same"].bertscore_f1 == pytest.approx(1.0)


def test_each_distinct_text_is_encoded_once(spark):
    df = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "t string")
    got = {r.text: len(r.vectors) for r in vectors.encode(df, "t", hash_encoder).collect()}
    assert got == {"a b": 2, "c": 1}


def test_groups_are_encoded_in_a_fixed_number_of_tasks(spark):
    rows = spark.sql("SELECT 'm' AS model, 'q' AS question_id, id AS run_index, 'a b' AS response_text FROM range(3)")
    plan = semantic.semantic_repro(rows, hash_encoder)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.index("ArrowEvalPython") :].split("Join")[0]


def test_vectors_are_read_as_views_of_their_batch():
    kind = pa.list_(pa.list_(pa.float32()))
    column = pa.array([[[9.0, 9.0]], [[1.0, 2.0], [3.0, 4.0]], None, []], kind).slice(1)
    got = list(vectors._matrices(column))
    assert got[0].tolist() == [[1.0, 2.0], [3.0, 4.0]] and got[1] is None and got[2].shape[0] == 0
    assert got[0].base is not None
    with pytest.raises(ValueError):
        list(vectors._matrices(pa.array([[[1.0], [1.0, 2.0]]], kind)))


def test_a_pair_that_comes_again_is_counted_once():
    pred, gold = pa.array(["a b", None, "a b", "a b", "c", None, "", "a b"]), pa.array(["a", "a", "a", None, "a", None, "", "a"])
    *some, copy = pairs._distinct(pred, gold)
    assert len(some[0]) == len({*zip(pred.to_pylist(), gold.to_pylist())}) == 6
    assert [x.take(pa.array(copy)).to_pylist() for x in some] == [pred.to_pylist(), gold.to_pylist()]


def test_texts_scaled_together_are_as_each_alone():
    draw = np.random.default_rng(3)
    wide = [draw.standard_normal((n, 5)) for n in (3, 0, 1, 7)] + [np.zeros((2, 5))]
    for encoded in (wide, [*wide, draw.standard_normal((2, 4))], [x.tolist() for x in wide], wide[:1], []):
        assert [x.tolist() for x in vectors._units(encoded)] == [vectors._unit(x).tolist() for x in encoded]


def test_rows_that_stand_together_are_not_sorted(spark):
    rows = [(f"q{i // 6}", None if i % 7 == 0 else f"a{i % 3} b", f"a{i // 6} b") for i in range(30)]
    df = spark.createDataFrame(rows, "question_id string, response_text string, gold_answer string").coalesce(1)
    plain, together = (score_semantic(df, hash_encoder, together=x) for x in (False, True))
    assert sorted(map(tuple, together.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    has_sort = ["Sort " in x._jdf.queryExecution().executedPlan().toString() for x in (plain, together)]
    assert has_sort == [True, False]
