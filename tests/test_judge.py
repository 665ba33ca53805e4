import json
import os

import pytest

from evenkeel.operators import judge
from evenkeel.plans.evaluate import judge_answers, judge_reliability
from evenkeel.sources import stages

N = None
# Published repeated judge scores (rows are responses, columns passes) and the published summaries.
STUDY_1 = [
    [0.0, 0.0, 0.0, 0.0, 0.0], [0.6, 0.7, 0.7, 0.7, 0.7], [0.2, 0.3, 0.3, 0.2, 0.1], [0.5, N, N, 0.6, 0.5],
    [N, N, N, N, N], [N, 0.95, N, N, N], [0.7, 0.6, 0.85, 0.7, 0.8], [0.1, 0.1, 0.0, 0.0, 0.0],
    [0.0, 0.0, 0.0, 0.0, 0.0], [0.95, 0.9, 0.9, N, 0.95], [0.3, 0.6, 0.4, 0.4, N], [0.8, 0.5, 0.4, 0.6, 0.6],
    [0.1, 0.0, 0.1, 0.0, 0.1], [0.0, 0.1, 0.1, 0.0, 0.0], [0.9, N, 0.9, N, 0.75], [0.0, 0.0, 0.0, 0.0, 0.0],
    [0.6, 0.5, 0.2, 0.5, 0.3], [0.0, 0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0, 0.0], [0.9, N, 0.95, 0.9, 0.9],
    [0.9, 0.9, 0.95, 0.95, 0.95], [0.7, 0.95, 0.3, 0.6, 0.75], [0.4, 0.4, 0.3, 0.4, 0.4],
    [0.9, 0.75, 0.95, 0.85, 0.85], [N, N, N, N, 0.95],
]
STUDY_2 = [
    [1.0, 1.0, 1.0, 1.0, 1.0], [0.95, 0.4, N, 0.3, 0.6], [1.0, 0.9, 0.8, 0.95, 1.0], [1.0, 0.95, 1.0, 1.0, 1.0],
    [1.0, 1.0, 0.0, 1.0, 1.0], [1.0, 1.0, 1.0, 1.0, 1.0], [1.0, 0.95, 1.0, 1.0, 1.0], [0.8, 1.0, 0.95, 0.8, 0.6],
    [0.95, 1.0, 1.0, 0.95, 1.0], [1.0, 0.2, 0.0, 1.0, 1.0], [1.0, 0.95, 1.0, 1.0, 1.0], [0.0, 0.0, 0.0, 0.2, 0.2],
    [0.9, 0.95, 0.95, 1.0, 0.95], [0.8, 0.95, 1.0, 1.0, 1.0], [1.0, N, 1.0, 1.0, 1.0], [0.2, 0.3, 0.2, 0.2, 0.2],
    [0.9, 0.7, 0.9, 0.4, 0.9], [0.8, 0.9, 0.8, 0.8, 0.9], [1.0, 1.0, 1.0, 1.0, 1.0], [0.0, 0.0, 0.0, 0.0, 1.0],
    [1.0, 1.0, 1.0, 1.0, 1.0], [0.95, 1.0, 0.8, 1.0, 0.9], [0.95, 0.9, 0.9, 0.95, 0.95], [0.4, 0.5, 0.5, 0.3, 0.3],
    [1.0, 1.0, 1.0, 1.0, 1.0],
]


def long(spark, scores):
    rows = [(i, p, s) for i, passes in enumerate(scores) for p, s in enumerate(passes)]
    return spark.createDataFrame(rows, "response_idx int, pass_index int, judge_score double")


@pytest.mark.parametrize(
    "scores, expected",
    [
        (STUDY_1, (5.0, 22.0, 0.06415184190282797, 0.05477225575051661, 0.9419210863685175)),
        (STUDY_2, (5.0, 25.0, 0.11100338017076539, 0.04472135954999579, 0.685518382777059)),
    ],
)
@pytest.mark.parametrize("in_memory_rows", [1_000_000, 5])
def test_published_summaries(spark, scores, expected, in_memory_rows):
    row = judge.judge_summary(long(spark, scores), in_memory_rows).first()
    assert tuple(row) == pytest.approx(expected, abs=1e-12)


def test_icc_limits(spark):
    def icc(scores):
        return judge.icc1(long(spark, scores)).first()[0]

    assert icc([[0.1, 0.1, 0.1], [0.5, 0.5, 0.5], [0.9, 0.9, 0.9]]) >= 0.9
    assert icc([[0.0, 1.0], [1.0, 0.0], [0.0, 1.0]]) < 0.1
    assert icc([[0.2, 0.3, 0.4]]) is None
    assert icc([[0.3, 0.3], [0.3, 0.3]]) is None
    assert icc([[0.3, None], [0.4, None]]) is None


def answers(spark, models, runs, questions=1):
    rows = [
        (m, f"q{q}", r, "what?", "gold", f"answer {r}") for m in models for q in range(questions) for r in range(runs)
    ]
    return spark.createDataFrame(
        rows, "model string, question_id string, run_index int, question string, gold_answer string, response_text string"
    )


def test_stratified_subset(spark):
    df = answers(spark, ["a", "b", "c"], 10)
    got = judge.stratified_subset(df, 6).collect()
    assert len(got) == 6 and {r.model for r in got} == {"a", "b", "c"}
    assert got == judge.stratified_subset(df.repartition(7), 6).collect()
    assert got != judge.stratified_subset(df, 6, seed=1).collect()
    # fewer slots than models: one each, the first models win; nulls are no model; a small model's rest is lost
    assert [r.model for r in judge.stratified_subset(df, 2).collect()] == ["a", "b"]
    assert judge.stratified_subset(df.filter("false"), 5).count() == 0
    small = answers(spark, ["a"], 1).unionByName(answers(spark, ["b"], 10))
    assert len(judge.stratified_subset(small, 8).collect()) == 5
    assert len(judge.stratified_subset(answers(spark, ["a", "b"], 900, 2), 3000).collect()) == 3000


def test_rejudge_and_apply(spark):
    def factory():
        return lambda prompt: "score=0.5 rationale=ok" if "Return JSON" in prompt else "x"

    df = answers(spark, ["a", "b"], 4)
    calls = judge.rejudge(df, factory, subset=4, passes=4)
    assert {r.judge_error for r in calls.collect()} == {None}
    rows = calls.collect()
    assert len(rows) == 16 and {r.response_idx for r in rows} == {0, 1, 2, 3}
    assert judge.judge_summary(calls).first().n_responses == 4.0
    judged = judge.apply_judge(df, factory)
    assert {(r.judge_score, r.judge_rationale) for r in judged.collect()} == {(0.5, "score=0.5 rationale=ok")}
    off = judge.apply_judge(df, None, enabled=False).first()
    assert (off.judge_score, off.judge_rationale) == (None, "")
    with pytest.raises(ValueError):
        judge.apply_judge(df, None)


def test_empty_reply_is_asked_once_more(spark, tmp_path):
    log = str(tmp_path / "calls")

    def factory():
        def ask(prompt):
            with open(log, "a") as out:
                out.write("json\n" if "Return JSON" in prompt else "plain\n")
            return "  \n" if "Return JSON" in prompt else ""

        return ask

    judged = judge.apply_judge(answers(spark, ["a"], 3), factory)
    rows = judged.collect()
    assert [(r.judge_score, r.judge_rationale) for r in rows] == [(None, "")] * 3
    assert sorted(open(log).read().split()) == ["json"] * 3 + ["plain"] * 3
    with pytest.raises(RuntimeError):
        judge.require_parsed(spark.createDataFrame(rows, judged.schema))


def test_request_is_valid_json(spark):
    df = spark.createDataFrame(
        [('a "quoted"\nline\t\\', "gold é", None)], "question string, gold_answer string, response_text string"
    )
    row = judge.judge_requests(df, "rub'ric").first()
    lead, _, body = row.judge_prompt.partition("\n")
    assert lead.startswith("You are a strict evaluator")
    expected = {
        "instructions": "rub'ric",
        "question": 'a "quoted"\nline\t\\',
        "gold_answer": "gold é",
        "model_answer": "nan",
        "output_format": {"score": "float_0_to_1", "rationale": "short_string"},
    }
    assert json.loads(body) == expected and body == json.dumps(expected, ensure_ascii=False)
    assert row.judge_fallback.endswith("MODEL_ANSWER: nan\n") and os.linesep in row.judge_fallback


def logging_judge(log, broken="", reply="score=0.5"):
    def factory():
        def ask(prompt):
            with open(log, "a") as out:
                out.write("call\n")
            if broken and broken in prompt:
                raise TimeoutError("no reply")
            return reply

        return ask

    return factory


def asked(log):
    return len(open(log).read().split())


def test_reliability_asks_once_and_summarises_what_is_stored(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")

    logged = logging_judge(log)

    def factory():
        ask = logged()
        return lambda prompt: f"{ask(prompt)}{os.urandom(1)[0] % 10}"

    df = answers(spark, ["a", "b", "c", "d", "e"], 10)
    tables = judge_reliability(df, factory, out)
    assert asked(log) == 125 and tables["judge_reliability_scores"].count() == 125
    again = judge.judge_summary(stages.read_stage(spark, out, "judge_reliability_scores")).first()
    assert tuple(tables["judge_reliability_summary"].first()) == pytest.approx(tuple(again), abs=1e-12)
    judge_reliability(df, factory, out, resume=True)
    assert asked(log) == 125


def test_one_failing_call_loses_one_row(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    df = answers(spark, ["a"], 6)
    first = judge_answers(df, logging_judge(log, "answer 3"), out, waves=2).collect()
    assert sorted(r.run_index for r in first if r.judge_error is None) == [0, 1, 2, 4, 5]
    assert [r.judge_error for r in first if r.run_index == 3] == ["TimeoutError: no reply"]
    second = judge_answers(df, logging_judge(log), out, resume=True, waves=2).collect()
    assert [r.judge_score for r in second] == [0.5] * 6 and asked(log) == 7


def test_run_without_any_score_can_be_resumed(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    df = answers(spark, ["a"], 3)
    for reply, broken in (("undecided", ""), ("", "answer")):
        with pytest.raises(RuntimeError):
            judge_answers(df, logging_judge(log, broken, reply), out, resume=True)
    assert {r.judge_score for r in judge_answers(df, logging_judge(log), out, resume=True).collect()} == {0.5}


def test_icc_of_scores_that_lie_close_together(spark):
    """0.5 + 1e-9 i + 1e-10 p: the shares of variance against exact arithmetic."""
    from fractions import Fraction

    rows = [(f"r{i}", p, 0.5 + 1e-9 * i + 1e-10 * p) for i in range(40) for p in range(5 if i % 3 else 4)]
    by = {}
    for r, _, x in rows:
        by.setdefault(r, []).append(Fraction(x))
    n, total = len(by), sum(map(len, by.values()))
    grand = sum(sum(v) for v in by.values()) / total
    means = {r: sum(v) / len(v) for r, v in by.items()}
    between = sum(len(v) * (means[r] - grand) ** 2 for r, v in by.items()) / (n - 1)
    within = sum((x - means[r]) ** 2 for r, v in by.items() for x in v) / (total - n)
    exact = (between - within) / (between + (Fraction(total, n) - 1) * within)
    long = spark.createDataFrame(rows, "response_idx string, pass_index int, judge_score double")
    assert judge.icc1(long).first().icc1 == pytest.approx(float(exact), abs=1e-6)
    summary = judge.judge_summary(long).first()
    assert summary.icc1 == pytest.approx(float(exact), abs=1e-6) and (summary.n_responses, summary.passes) == (40, 5)
