import pytest

from evenkeel.operators import grid
from evenkeel.plans.evaluate import collect_answers, evaluate
from evenkeel.plans.derived import hash_encoder
from evenkeel.sources import stages

MODELS = [grid.ModelSpec("a"), grid.ModelSpec("b", 3, "other")]


@pytest.fixture()
def questions(spark):
    return spark.createDataFrame(
        [("q1", "first?", "one"), ("q2", "second?", "two")], "id string, question string, gold_answer string"
    )


def counting(log, fail=""):
    def factory():
        def generate(model, prompt, seed, system):
            with open(log, "a") as out:
                out.write(f"{model} {prompt} {seed} {system}\n")
            if fail and fail in prompt:
                raise TimeoutError("no answer")
            return {"response": f"{model} says {prompt}", "done": True, "total_duration": 5, "eval_count": 3}

        return generate

    return factory


def calls(log):
    return open(log).read().splitlines()


def test_request_grid(spark, questions):
    rows = grid.request_grid(MODELS, questions, 2, base_seed=10, shared_instruction="  be kind\n").collect()
    assert len(rows) == 2 * 2 + 2 * 3
    assert {r.run_index for r in rows if r.model == "b"} == {0, 1, 2}
    assert all(r.seed == 10 + r.run_index and r.system == "be kind" for r in rows)
    loose = grid.request_grid(MODELS, questions, 1, base_seed=10, deterministic=False, shared_instruction="  ")
    assert {(r.seed, r.system) for r in loose.collect()} == {(None, None)}
    with pytest.raises(ValueError):
        grid.ModelSpec("x", 0)


def test_resume_makes_no_call_twice(spark, questions, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    one = [grid.ModelSpec("a")]
    first = collect_answers(questions, one, counting(log), out, 2, base_seed=1)
    assert first.count() == 4 and len(calls(log)) == 4
    again = collect_answers(questions, one, counting(log), out, 2, base_seed=1, resume=True)
    assert again.count() == 4 and len(calls(log)) == 4
    more = collect_answers(questions, one, counting(log), out, 3, base_seed=1, resume=True, waves=2)
    assert more.count() == 6 and len(calls(log)) == 6
    fresh = collect_answers(questions, one, counting(log), out, 1, base_seed=1)
    assert fresh.count() == 2 and len(calls(log)) == 8
    assert {r.shared_instruction for r in fresh.collect()} == {""}


def test_failed_calls_come_back(spark, questions, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    one = [grid.ModelSpec("a")]
    part = collect_answers(questions, one, counting(log, fail="second"), out, 2)
    assert {r.question_id for r in part.collect()} == {"q1"} and len(calls(log)) == 4
    whole = collect_answers(questions, one, counting(log), out, 2, resume=True)
    assert whole.count() == 4 and len(calls(log)) == 6
    progress = grid.run_progress(grid.request_grid(one, questions, 2), part).first()
    assert (progress.total_calls, progress.completed_calls, progress.pending_calls) == (4, 2, 2)


def test_union_prefers_the_checkpoint(spark):
    schema = "model string, question_id string, run_index int, response_text string"
    done = spark.createDataFrame([("a", "q1", 0, "old"), ("a", "q1", 0, "older"), ("a", "q1", 1, "x")], schema)
    new = spark.createDataFrame([("a", "q1", 0, "new"), ("a", "q2", 0, "y")], schema)
    got = {(r.question_id, r.run_index): r.response_text for r in grid.union_responses(done, new).collect()}
    assert got == {("q1", 0): "old", ("q1", 1): "x", ("q2", 0): "y"}
    asked = spark.createDataFrame([("a", "q2", 0)], "model string, question_id string, run_index int")
    assert grid.within_grid(done.unionByName(new), asked).count() == 1


def test_whole_evaluation_and_resume(spark, questions, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")

    def judge_factory():
        return lambda prompt: "score=0.5"

    kwargs = dict(encoder=hash_encoder, judge_factory=judge_factory, runs_per_prompt=2, n_boot=50)
    tables = evaluate(questions, MODELS, counting(log), out, **kwargs)
    assert {r.Model for r in tables["table_1_quality"].collect()} == {"a", "b"}
    assert tables["table_1_quality"].columns == ["Model", "BERTScore F1", "Token F1", "ROUGE-L", "Judge"]
    assert len(tables["table_2_reproducibility"].columns) == 4
    assert tables["part_5_similarity"].count() == 4 and tables["part_3_least_reproducible"].count() == 4
    assert all(stages.stage_exists(spark, out, s) for s in (stages.RAW, stages.SCORED, stages.AGGREGATES))
    assert len(calls(log)) == 10
    resumed = evaluate(questions, MODELS, counting(log), out, resume=True, **kwargs)
    assert len(calls(log)) == 10
    assert sorted(map(str, resumed["model_summary"].collect())) == sorted(map(str, tables["model_summary"].collect()))


def test_provider_reaches_a_function_that_takes_it(spark, questions):
    def factory():
        return lambda model, prompt, seed, system, provider: {"response": f"{model} at {provider}"}

    got = grid.run_requests(grid.request_grid(MODELS, questions, 1), factory).collect()
    assert {r.response_text for r in got} == {"a at ollama", "b at other"} and {r.error for r in got} == {None}


def test_raw_answers_in_other_formats(spark, questions, tmp_path):
    out = str(tmp_path / "out")
    evaluate(questions, MODELS[:1], counting(str(tmp_path / "log")), out, runs_per_prompt=2, n_boot=20, raw_jsonl=True, raw_csv=True)
    assert stages.read_responses(spark, f"{out}/{stages.RAW}.jsonl").count() == 4
    assert stages.read_csv(spark, f"{out}/{stages.RAW}.csv", stages.RESPONSE_SCHEMA).count() == 4


def test_keys_are_joined_in_many_tasks(spark):
    asked = grid.request_grid([grid.ModelSpec("m", 2)], spark.sql("SELECT 'q' AS id, 'a' AS question, 'b' AS gold_answer, 7 AS more"), extra=["more"])
    assert {r.more for r in asked.collect()} == {7}
    for joined in (grid.pending_requests(asked, asked.filter("run_index = 0")), grid.run_progress(asked, asked)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count(f"run_index#") and plan.count(f", {grid.TASKS * 4}), REPARTITION_BY_NUM") == 2
