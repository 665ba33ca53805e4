"""A whole evaluation, judge and encoder included, with every report table held against SQL over the raw answers."""

import os
from difflib import SequenceMatcher

import pytest

from evenkeel.functions.vectors import store_vectors
from evenkeel.operators import report
from evenkeel.operators.grid import ModelSpec
from evenkeel.operators.score import METRICS
from evenkeel.plans import derived, oracle
from evenkeel.plans.catalog import r9
from evenkeel.plans.evaluate import evaluate
from evenkeel.sources import stages
from tests.check_oracle import table

SF = "/root/testdata/sf0.001"
RUNS, PAIRS, BOOTS = 10, 12, 60
MODELS = [ModelSpec(f"m{i}", RUNS) for i in (1, 2, 3)]
COLUMNS = (*report.QUALITY_TITLES, *report.REPRODUCIBILITY_TITLES)


def counting_encoder(log):
    """An encoder that notes every text it is given in a file."""

    def factory():
        encode = derived.hash_encoder()

        def noted(texts):
            with open(log, "a") as file:
                file.write("".join(f"{derived.digits(t)}\n" for t in texts))
            return encode(texts)

        return noted

    return factory


def counting_judge(log):
    def factory():
        judge = derived.hash_judge()

        def noted(prompt):
            with open(log, "a") as file:
                file.write("x\n")
            return judge(prompt)

        return noted

    return factory


def lines(path):
    return open(path).read().split("\n")[:-1] if os.path.exists(path) else []


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("evaluation")
    out, asked, judged = str(folder / "out"), str(folder / "encoded"), str(folder / "judged")
    questions = derived.questions(spark, SF)

    def run(resume):
        return evaluate(
            questions, MODELS, derived.hash_generate, out, encoder=counting_encoder(asked), judge_factory=counting_judge(judged),
            base_seed=42, max_pairs=PAIRS, n_boot=BOOTS, batch_size=16, resume=resume, waves=3,
        )

    tables = run(False)
    first = len(lines(asked)), len(lines(judged))
    resumed = run(True)
    assert (len(lines(asked)), len(lines(judged))) == first  # everything was read back
    return out, tables, resumed, lines(asked)


def evaluation_sql(out):
    """All tables by name, from the raw answers alone."""
    raw = f"raw0 AS (SELECT * FROM read_parquet('{out}/{stages.RAW}.parquet/*.parquet'))"
    answers = f"{raw}, {oracle.PROMPTS.replace('FROM answers', 'FROM raw0')}, answers AS (SELECT *, reply AS judge_text FROM replied)"
    scored = f"""{oracle.SCORED.replace(oracle.ANSWERS, answers)}, {oracle.RUNS},
      {oracle.text_match('answers', 'response_text', 'gold_answer', '_g')}, full_scored AS (
      SELECT scored.*, ratio(nr, ng) AS string_similarity, p AS bertscore_precision, r AS bertscore_recall, f1 AS bertscore_f1
      FROM scored LEFT JOIN matched_g ON x = response_text AND y = gold_answer)"""
    means = ", ".join(f"avg({m}) AS {m}_mean" for m in METRICS)
    aggregates = f"""{scored}, {oracle.run_pairs(PAIRS)}, {oracle.text_match('chosen', 'text_i', 'text_j')}, {oracle.SEMANTIC}, aggs AS (
      SELECT *, sm AS semantic_self_similarity_mean FROM (SELECT model, question_id, {means} FROM full_scored GROUP BY ALL)
      JOIN run_stats USING (model, question_id) LEFT JOIN semantic USING (model, question_id))"""
    summary = f"{aggregates}, {oracle.bootstrap('aggs', COLUMNS, BOOTS)}"
    r9 = oracle.r9

    def cells(titles):
        return ", ".join(f"""format('{{:.3f}} [{{:.3f}}, {{:.3f}}]', {c}_mean, {c}_ci_low, {c}_ci_high) AS "{t}\"""" for c, t in titles.items())

    def both(columns, source):
        calls = ", ".join(r9(f"{f}({c})", f"{c}_{s}") for s, f in (("avg", "avg"), ("median", "median")) for c in columns)
        return f"SELECT model, {calls} FROM {source} GROUP BY model"

    sim = f"""{scored}, sim AS (SELECT a.model AS model_a, b.model AS model_b, avg((a.nr = b.nr)::INTEGER) AS similarity
      FROM normed a JOIN normed b USING (question_id, run_index) GROUP BY ALL)"""
    box = "quantile_cont(string_similarity, {}) AS {}"
    return {
        "model_summary": f"WITH {summary} SELECT model, n_questions, {oracle.summary_columns(COLUMNS)} FROM summary",
        "table_1_quality": f'WITH {summary} SELECT model AS "Model", {cells(report.QUALITY_TITLES)} FROM summary',
        "table_2_reproducibility": f'WITH {summary} SELECT model AS "Model", {cells(report.REPRODUCIBILITY_TITLES)} FROM summary',
        "part_1_quality": f"WITH {scored} {both(report.QUALITY, 'full_scored')}",
        "part_2_reproducibility": f"WITH {scored} SELECT model, {', '.join(r9(f'avg({c})', c) for c in report.REPRODUCIBILITY)} FROM run_stats GROUP BY model",
        "part_3_least_reproducible": f"""WITH {scored} SELECT model, question_id, n_runs, {', '.join(r9(c) for c in report.REPRODUCIBILITY)} FROM run_stats
            ORDER BY {report.REPRODUCIBILITY[0]}, {report.REPRODUCIBILITY[1]} DESC, model, question_id LIMIT 20""",
        "part_4_global_uniqueness": f"""WITH {scored}, u AS (SELECT model, count(response_text) AS n, count(DISTINCT response_text) AS a, count(DISTINCT nr) AS b
            FROM normed GROUP BY model) SELECT model, n AS total_outputs, a AS unique_outputs, b AS unique_normalized_outputs,
            {r9('a::DOUBLE / n', 'global_response_uniqueness_rate')}, {r9('b::DOUBLE / n', 'global_normalized_uniqueness_rate')} FROM u""",
        "part_5_similarity": f"WITH {sim} SELECT model_a, model_b, {r9('similarity')} FROM sim",
        "part_5_similarity_matrix": f"""WITH {sim} SELECT model_a AS model, {', '.join(
            f"round(max(similarity) FILTER (model_b = 'm{i}'), 9) AS m{i}" for i in (1, 2, 3))} FROM sim GROUP BY model_a""",
        "part_6_performance": f"WITH {scored} {both(report.PERFORMANCE, 'full_scored')}",
        "figure_ci_bars": f"WITH {summary} " + " UNION ALL ".join(
            f"SELECT model, '{c}' AS metric, {r9(f'{c}_mean', 'mean')}, {r9(f'greatest({c}_mean - {c}_ci_low, 0)', 'whisker_low')}, "
            f"{r9(f'greatest({c}_ci_high - {c}_mean, 0)', 'whisker_high')} FROM summary" for c in COLUMNS),
        "figure_token_f1_bar": f"""WITH {scored}, b AS (SELECT model, avg(token_f1) AS mean, stddev_samp(token_f1) AS sd FROM scored GROUP BY model)
            SELECT model, {r9('mean')}, {r9('sd')}, {r9('mean - sd', 'low')}, {r9('mean + sd', 'high')} FROM b""",
        "figure_token_f1_heatmap": f"WITH {scored} SELECT model, question_id, {r9('avg(token_f1)', 'token_f1_mean')} FROM scored GROUP BY ALL",
        "figure_string_similarity_box": f"""WITH {scored}, q AS (SELECT model, {box.format(0.25, 'q1')}, {box.format(0.5, 'median')}, {box.format(0.75, 'q3')}
            FROM full_scored GROUP BY model), w AS (SELECT f.*, q1, median, q3, string_similarity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
            FROM full_scored f JOIN q USING (model))
            SELECT model, {', '.join(r9(f'any_value({c})', c) for c in ('q1', 'median', 'q3'))}, {r9('min(string_similarity) FILTER (inside)', 'whisker_low')},
            {r9('max(string_similarity) FILTER (inside)', 'whisker_high')}, count(*) FILTER (NOT inside) AS outliers FROM w GROUP BY model""",
    }


def test_every_table_equals_sql(spark, whole):
    import duckdb

    out, tables, resumed, _ = whole
    con = duckdb.connect()
    con.create_function("ratio", lambda a, b: SequenceMatcher(None, a, b).ratio(), ["VARCHAR", "VARCHAR"], "DOUBLE")
    wanted = evaluation_sql(out)
    assert set(tables) == set(resumed) == set(wanted) and len(wanted) == 14
    for name, sql in wanted.items():
        got = con.execute(sql)
        theirs = table([d[0] for d in got.description], got.fetchall())
        for made in (tables[name], resumed[name]):
            assert table(made.columns, [tuple(r) for r in r9(made).collect()]) == theirs, name


def test_every_cell_was_asked_and_judged(spark, whole):
    out = whole[0]
    asked = derived.questions(spark, SF).count() * len(MODELS) * RUNS
    assert stages.read_stage(spark, out, stages.RAW).count() == stages.read_stage(spark, out, stages.SCORED).count() == asked


def test_each_text_is_encoded_once(spark, whole, tmp_path):
    out, _, _, seen = whole
    raw = stages.read_stage(spark, out, stages.RAW)
    texts = raw.selectExpr("explode(array(response_text, gold_answer)) AS text").dropna().distinct()
    assert len(seen) == len(set(seen)) == texts.count()
    log, path = str(tmp_path / "log"), str(tmp_path / "store")  # a store that is added to
    store_vectors(texts.limit(7), counting_encoder(log), path)
    assert store_vectors(texts, counting_encoder(log), path).count() == len(lines(log)) == len(set(lines(log))) == texts.count()
