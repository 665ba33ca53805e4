"""A whole evaluation: run, score, report, with a committed table between stages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from evenkeel.functions.text import with_policy
from evenkeel.functions.vectors import Encoder, store_vectors
from evenkeel.operators import compare, grid, judge, report, repro, score, semantic, stats
from evenkeel.sources import stages
from evenkeel.sources.questions import sample_questions


def _in_waves(
    asked: DataFrame,
    call: Callable[[DataFrame], DataFrame],
    path: str,
    error: str,
    resume: bool,
    waves: int,
    wanted: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> tuple[DataFrame | None, DataFrame]:
    """(kept, new): rows of ``call`` that earlier runs left without an error, and all rows of this run's calls.

    The open cells are stored once, by wave, and every wave is committed on its own. A fresh run starts a new series
    of waves; so does a resumed one whose series holds no row that is ``wanted``.
    """
    spark = asked.sparkSession

    def wave_path(series: int, wave: int) -> str:
        return f"{path}/series-{series}/wave-{wave}"

    def attempts(first: int, last: int) -> DataFrame:
        return spark.read.parquet(*[wave_path(series, i) for i in range(first, last)])

    def without_error(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col(error).isNull())

    series = done = 0
    while stages.committed(spark, wave_path(series, 0)):
        series += 1
    if resume and series:
        series -= 1
        while stages.committed(spark, wave_path(series, done)):
            done += 1
        if wanted(without_error(attempts(0, done))).isEmpty():
            series, done = series + 1, 0
    pending = grid.pending_requests(asked, without_error(attempts(0, done))) if done else asked
    parts = [pending]
    if waves > 1:
        wave_of = F.pmod(F.xxhash64(*grid.KEY), F.lit(waves)).cast("int")
        open_cells = f"{path}/series-{series}/open-{done}"
        pending.withColumn("_wave", wave_of).write.mode("overwrite").partitionBy("_wave").parquet(open_cells)
        kept = spark.read.schema(StructType([*pending.schema.fields, StructField("_wave", IntegerType())])).parquet(open_cells)
        parts = [kept.filter(F.col("_wave") == wave).drop("_wave") for wave in range(waves)]
    for wave, part in enumerate(parts):
        call(part).write.mode("overwrite").parquet(wave_path(series, done + wave))
    return without_error(attempts(0, done)) if done else None, attempts(done, done + len(parts))


def collect_answers(
    questions: DataFrame,
    models: Sequence[grid.ModelSpec],
    generate: Callable[[], grid.Generate],
    out_dir: str,
    runs_per_prompt: int = 100,
    base_seed: int | None = None,
    deterministic: bool = True,
    shared_instruction: str | None = None,
    resume: bool = False,
    tasks: int | None = None,
    waves: int = 1,
    only_grid: bool = False,
) -> DataFrame:
    """Calls the model function for every open cell and returns all answers.

    The open cells are asked in ``waves``, each committed on its own, so an interrupted run loses at most the
    wave it was in. Failed calls stay in their wave with the error and are asked again by a resumed run. A
    fresh run starts a new series of waves and never reads an older one.
    """
    asked = grid.request_grid(
        models, questions, runs_per_prompt, base_seed, deterministic, shared_instruction
    )
    kept, tried = _in_waves(
        asked, lambda part: grid.run_requests(part, generate, tasks), f"{out_dir}/attempts", "error", resume, waves
    )
    new = tried.filter(F.col("error").isNull()).drop("error")
    rows = new if kept is None else grid.union_responses(kept.drop("error"), new)
    return grid.within_grid(rows, asked) if only_grid else rows


def judge_answers(
    answers: DataFrame,
    factory: Callable[[], judge.Judge],
    out_dir: str,
    rubric: str = judge.DEFAULT_RUBRIC,
    resume: bool = False,
    waves: int = 1,
) -> DataFrame:
    """``model, question_id, run_index, judge_score, judge_rationale, judge_error`` of every answer.

    The judge is asked in ``waves``, each committed on its own. A failed call is a row with ``judge_error`` that a
    resumed run asks again; so are all rows if no earlier reply could be parsed. Raises if there are answers and none
    has a score.
    """
    columns = ["judge_score", "judge_rationale", "judge_error"]
    kept, tried = _in_waves(
        answers.select(*grid.KEY, "question", "gold_answer", "response_text"),
        lambda part: judge.apply_judge(part, factory, rubric).select(*grid.KEY, *columns),
        f"{out_dir}/judge_attempts", "judge_error", resume, waves, lambda rows: rows.filter("judge_score IS NOT NULL"),
    )
    return judge.require_parsed(tried if kept is None else kept.unionByName(tried))


def judge_reliability(
    answers: DataFrame,
    factory: Callable[[], judge.Judge],
    out_dir: str,
    subset: int = 25,
    passes: int = 5,
    rubric: str = judge.DEFAULT_RUBRIC,
    seed: int = 42,
    order_by: str | None = None,
    resume: bool = False,
) -> dict[str, DataFrame]:
    """Scores of repeated judging and their summary, both committed in ``out_dir`` (parquet and CSV).

    The judge is asked ``subset`` × ``passes`` times; the summary is made from the stored scores. With ``resume``
    stored scores are used again unless none of them could be parsed.
    """
    spark, names = answers.sparkSession, ("judge_reliability_scores", "judge_reliability_summary")
    good = resume and stages.stage_exists(spark, out_dir, names[0]) and not (
        stages.read_stage(spark, out_dir, names[0]).filter("judge_score IS NOT NULL").isEmpty()
    )
    long = judge.rejudge(answers, factory, subset, passes, rubric, seed, order_by)
    stages.write_stage(long, out_dir, names[0], good, csv=True)
    stored = judge.require_parsed(stages.read_stage(spark, out_dir, names[0]))
    stages.write_stage(judge.judge_summary(stored), out_dir, names[1], csv=True)
    return {name: stages.read_stage(spark, out_dir, name) for name in names}


def report_tables(
    scored: DataFrame,
    aggregates: DataFrame,
    n_boot: int = 1000,
    ci: float = 0.95,
    seed: int = 42,
    commit: Callable[[str, DataFrame], DataFrame] = lambda name, table: table,
) -> dict[str, DataFrame]:
    """Every report and figure table by name. Pass stored tables: each is read by several of them.

    ``commit(name, table)`` gets the tables that others are made from and returns what they are to be made of: with a
    function that stores them, the bootstrap and the model comparison run once.
    """
    columns = [*report.QUALITY_TITLES, *report.REPRODUCIBILITY_TITLES]
    summary = commit("model_summary", stats.model_summary(aggregates, columns, n_boot, ci, seed))
    order = [c for c in ("timestamp_utc",) if c in scored.columns]
    pairs = commit("part_5_similarity", compare.pairwise_model_similarity(scored, order))
    tables = {
        "model_summary": summary,
        "table_1_quality": report.mean_ci_table(summary, report.QUALITY_TITLES),
        "table_2_reproducibility": report.mean_ci_table(summary, report.REPRODUCIBILITY_TITLES),
        "part_1_quality": report.quality_by_model(scored),
        "part_2_reproducibility": report.reproducibility_by_model(aggregates),
        "part_3_least_reproducible": report.least_reproducible(aggregates),
        "part_4_global_uniqueness": report.global_uniqueness(scored),
        "part_5_similarity": pairs,
        "part_5_similarity_matrix": compare.similarity_matrix(pairs),
        "part_6_performance": report.performance_by_model(scored),
        "figure_ci_bars": report.ci_bars(summary, columns),
    }
    if "token_f1" in scored.columns:
        tables["figure_token_f1_bar"] = report.token_f1_bar(scored)
        tables["figure_token_f1_heatmap"] = report.token_f1_heatmap(aggregates)
    if "string_similarity" in scored.columns:
        tables["figure_string_similarity_box"] = report.string_similarity_box(scored)
    return tables


def evaluate(
    questions: DataFrame,
    models: Sequence[grid.ModelSpec],
    generate: Callable[[], grid.Generate],
    out_dir: str,
    encoder: Callable[[], Encoder] | None = None,
    judge_factory: Callable[[], judge.Judge] | None = None,
    rubric: str = judge.DEFAULT_RUBRIC,
    head: int | None = None,
    random: int | None = None,
    sample_seed: int = 42,
    runs_per_prompt: int = 100,
    base_seed: int | None = None,
    deterministic: bool = True,
    shared_instruction: str | None = None,
    resume: bool = False,
    tasks: int | None = None,
    waves: int = 1,
    max_pairs: int = semantic.MAX_PAIRS,
    n_boot: int = 1000,
    ci: float = 0.95,
    seed: int = 42,
    batch_size: int = 8,
    missing_text: str | None = None,
    raw_jsonl: bool = False,
    raw_csv: bool = False,
) -> dict[str, DataFrame]:
    """run → judge → score → report; with ``resume`` finished stages are read back instead of run again.

    ``raw_jsonl`` and ``raw_csv`` write the raw answers in those formats too, from the committed table. Each distinct
    text is encoded once, into a committed store that scoring and run similarity read.
    """
    spark = questions.sparkSession

    def vectors_of(rows: DataFrame) -> DataFrame | None:
        if encoder is None:
            return None
        both = F.explode(F.array(*[with_policy(F.col(c), missing_text) for c in ("response_text", "gold_answer")]))
        return store_vectors(rows.select(both.alias("text")), encoder, f"{out_dir}/vectors", batch_size)

    if not (resume and stages.stage_exists(spark, out_dir, stages.SCORED)):
        chosen = sample_questions(questions, head, random, sample_seed)
        answers = collect_answers(
            chosen, models, generate, out_dir, runs_per_prompt, base_seed, deterministic,
            shared_instruction, resume, tasks, waves,
        )
        stages.write_stage(answers, out_dir, stages.RAW)
        raw = stages.read_stage(spark, out_dir, stages.RAW)
        if raw_jsonl or raw_csv:
            stages.write_responses(raw, out_dir, jsonl=raw_jsonl, parquet=False, csv=raw_csv)
        scored = score.score_responses(raw, encoder, batch_size, missing_text, vectors_of(raw))
        if judge_factory is None:
            scored = judge.apply_judge(scored, None, rubric, enabled=False)
        else:  # audited before the stage is committed, so a run whose replies all failed can be resumed
            judged = judge_answers(raw, judge_factory, out_dir, rubric, resume, waves)
            scored = scored.join(judged.dropDuplicates(list(grid.KEY)), list(grid.KEY), "left")
        stages.write_scored(scored, out_dir)
    scored = stages.read_stage(spark, out_dir, stages.SCORED)
    if not (resume and stages.stage_exists(spark, out_dir, stages.AGGREGATES)):
        similar = None
        if encoder is not None:
            store = vectors_of(scored)
            similar = semantic.semantic_repro(scored, encoder, max_pairs, seed, batch_size, missing_text, store)
        stages.write_stage(
            repro.compute_aggregates(scored, similar, missing_text), out_dir, stages.AGGREGATES, csv=True
        )
    aggregates = stages.read_stage(spark, out_dir, stages.AGGREGATES)
    stored: dict[str, DataFrame] = {}

    def commit(name: str, table: DataFrame) -> DataFrame:
        if name not in stored:
            stages.write_stage(table, f"{out_dir}/report", name, resume)
            stored[name] = stages.read_stage(spark, f"{out_dir}/report", name)
        return stored[name]

    tables = report_tables(scored, aggregates, n_boot, ci, seed, commit)
    return {name: commit(name, table) for name, table in tables.items()}
