"""One registered query per operator, over the given tables or tables Spark derives from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evenkeel.functions import render, text, vectors
from evenkeel.operators import compare, grid, judge, report, repro, score, semantic, stats
from evenkeel.plans import derived
from evenkeel.plans import evaluate as staged
from evenkeel.plans.oracle import PAIR_BUDGET, QUALITY_COLUMNS, REPRO_COLUMNS
from evenkeel.sources import questions, stages
from evenkeel.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
CELL = ("model", "question_id", "run_index")
RAW = (*CELL, "response_text", "eval_count", "total_duration")
SEMANTIC = ("semantic_self_similarity_mean", "semantic_self_similarity_std", "n_semantic_pairs")
CATALOG: dict[str, Query] = {}


def query(build: Query) -> Query:
    CATALOG[build.__name__] = build
    return build


def r9(df: DataFrame) -> DataFrame:
    """Doubles at nine decimals: the order of a float sum decides the digits beyond."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def placed(df: DataFrame) -> DataFrame:
    """An ordered report with the place of every row, which a comparison of row sets can see."""
    at = df.withColumn("_at", F.monotonically_increasing_id())
    return at.withColumn("place", F.row_number().over(Window.orderBy("_at"))).drop("_at")


def _f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.scored(spark, sf_dir, ("exact_match", "normalized_exact_match", "token_f1"))


def _agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run statistics only; the wide table is its own query."""
    return repro.run_stats(derived.answers(spark, sf_dir))


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = derived.scored(spark, sf_dir, ("token_f1", "rouge_l"))
    return scored.groupBy("model", "question_id").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in ("token_f1", "rouge_l", "judge_score")]
    )


# --- sources and sinks -----------------------------------------------------------------------------------


@query
def read_gold_csv(spark, sf_dir):
    path = stages.scratch_dir(spark)
    rows = derived.questions(spark, sf_dir).orderBy("conv_id", "turn")
    stages.write_csv(rows.select("question", F.col("gold_answer").alias("answer")), path)
    return questions.read_gold_csv(spark, path)


@query
def read_gold_markdown(spark, sf_dir):
    path = stages.scratch_dir(spark)
    cells = [
        F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
        for c in (F.col("id"), F.col("question"), F.col("gold_answer"), F.col("category"))
    ]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = derived.questions(spark, sf_dir).select("id", line.alias("value"))
    head = spark.createDataFrame(
        [("", "| id | question | gold_answer | category |\n| --- | --- | --- | --- |")], "id string, value string"
    )
    head.unionByName(body).orderBy("id").select("value").write.text(path)
    return questions.read_gold_markdown(spark, path)


@query
def normalize_qa_source(spark, sf_dir):
    turns = derived.table(spark, sf_dir, "conversations")
    raw = turns.select(
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), "text", F.lit("\n")))
        .otherwise(F.col("text"))
        .alias("Question"),
        F.when(F.col("conv_id") % 5 == 0, "  ").otherwise(F.col("text")).alias("Answer"),
        F.col("role").alias("Focus (Drug)"),
        F.when(F.col("turn") % 2 == 0, "").otherwise("turn").alias("Question Type"),
    )
    return questions.normalize_qa_source(raw)


@query
def read_responses(spark, sf_dir):
    path = stages.scratch_dir(spark)
    stages.write_jsonl(derived.answers(spark, sf_dir), path)
    return stages.read_responses(spark, path).select(*RAW)


@query
def write_responses(spark, sf_dir):
    path = stages.scratch_dir(spark)
    stages.write_responses(derived.answers(spark, sf_dir).drop("h", "judge_text"), path)
    base = f"{path}/{stages.RAW}"
    back = {
        "jsonl": stages.read_responses(spark, f"{base}.jsonl"),
        "parquet": spark.read.parquet(f"{base}.parquet"),
        "csv": stages.read_csv(spark, f"{base}.csv", stages.RESPONSE_SCHEMA),
    }
    parts = [
        df.select(F.lit(kind).alias("kind"), *RAW, "question", "gold_answer") for kind, df in back.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def read_stage(spark, sf_dir):
    rows = derived.answers(spark, sf_dir).drop("h", "judge_text")
    both, csv_only = stages.scratch_dir(spark), stages.scratch_dir(spark)
    stages.write_stage(rows, both, stages.RAW)
    stages.write_csv(rows, f"{csv_only}/{stages.RAW}.csv")
    parts = [
        stages.read_stage(spark, path, stages.RAW).select(F.lit(kind).alias("kind"), *RAW)
        for kind, path in (("csv", csv_only), ("parquet", both))
    ]
    return parts[0].unionByName(parts[1])


@query
def write_stage(spark, sf_dir):
    path = stages.scratch_dir(spark)
    rows = derived.answers(spark, sf_dir)
    stages.write_stage(rows, path, stages.RAW, resume=True)
    stages.write_stage(rows.filter("run_index > 100"), path, stages.RAW, resume=True)  # skipped: committed
    return stages.read_stage(spark, path, stages.RAW).select(*RAW)


@query
def write_scored(spark, sf_dir):
    path = stages.scratch_dir(spark)
    stages.write_scored(_f1(spark, sf_dir), path)
    return r9(
        stages.read_csv(spark, f"{path}/{stages.SCORED}.csv", stages.SCORED_SCHEMA).select(
            *CELL, "response_text", "token_f1", "exact_match"
        )
    )


@query
def write_aggregates(spark, sf_dir):
    path = stages.scratch_dir(spark)
    stages.write_aggregates(_agg(spark, sf_dir), path)
    stored = stages.read_stage(spark, path, stages.AGGREGATES)
    counts = ("n_runs", "unique_responses", "unique_normalized_responses", "modal_normalized_response_count")
    return r9(stored.withColumns({c: F.col(c).cast("bigint") for c in counts}))


@query
def write_judge_reliability(spark, sf_dir):
    path = stages.scratch_dir(spark)
    long = derived.judge_passes(spark, sf_dir)
    stages.write_judge_reliability(long, judge.judge_summary(long), path)
    kinds = {
        "scores": "response_idx string, model string, question_id string, pass_index int, judge_score double, judge_text string",
        "summary": "passes double, n_responses double, mean_within_response_std double, "
        "median_within_response_std double, icc1 double",
    }
    back = [
        stages.read_csv(spark, f"{path}/judge_reliability_{kind}.csv", shape).withColumn("kind", F.lit(kind))
        for kind, shape in kinds.items()
    ]
    return r9(back[0].unionByName(back[1], allowMissingColumns=True))


@query
def export_sample(spark, sf_dir):
    path = stages.scratch_dir(spark)
    questions.export_sample(derived.questions(spark, sf_dir), 50, 42, path)
    return stages.read_csv(spark, path).select("id", "question", "gold_answer")


# --- projections and filters -----------------------------------------------------------------------------


@query
def head_sample(spark, sf_dir):
    asked = derived.questions(spark, sf_dir)
    order = F.struct("conv_id", "turn")
    return questions.head_sample(asked, 25, order).select("id", "question")


@query
def random_sample(spark, sf_dir):
    return questions.random_sample(derived.questions(spark, sf_dir), 50, 7).select("id", "question")


@query
def with_performance(spark, sf_dir):
    rows = score.with_performance(derived.answers(spark, sf_dir))
    return r9(rows.select(*CELL, *report.PERFORMANCE))


@query
def with_normalized(spark, sf_dir):
    rows = score.with_normalized(derived.answers(spark, sf_dir))
    return rows.select(*CELL, "normalized_response", "normalized_gold")


@query
def with_response_len(spark, sf_dir):
    return score.with_response_len(derived.answers(spark, sf_dir)).select(*CELL, "response_len")


@query
def usable_rows(spark, sf_dir):
    asked = derived.questions(spark, sf_dir)
    both = [text.strip(F.col(c)) for c in ("question", "gold_answer")]
    return asked.filter(questions.usable(*both)).select("id")


# --- joins -----------------------------------------------------------------------------------------------


@query
def request_grid(spark, sf_dir):
    return grid.request_grid(
        derived.MODELS, derived.questions(spark, sf_dir), base_seed=42, shared_instruction=" Be brief. \n"
    )


@query
def pending_requests(spark, sf_dir):
    done = derived.answers(spark, sf_dir).filter("h % 3 <> 0")
    asked = grid.request_grid(derived.MODELS, derived.questions(spark, sf_dir))
    return grid.pending_requests(asked, done.unionByName(done)).select(*CELL)


@query
def attach_semantic(spark, sf_dir):
    """The semantic table lacks one model, whose rows stay with missing columns."""
    rows = derived.answers(spark, sf_dir)
    side = semantic.semantic_repro(rows.filter("model <> 'm5'"), derived.hash_encoder, PAIR_BUDGET)
    return r9(repro.attach_semantic(repro.run_stats(rows), side).select("model", "question_id", "n_runs", *SEMANTIC))


@query
def pairwise_model_similarity(spark, sf_dir):
    return r9(compare.pairwise_model_similarity(derived.answers(spark, sf_dir)))


@query
def run_pairs(spark, sf_dir):
    return semantic.run_pairs(derived.answers(spark, sf_dir), PAIR_BUDGET)


# --- aggregations ----------------------------------------------------------------------------------------


@query
def metric_stats(spark, sf_dir):
    return r9(repro.metric_stats(derived.scored(spark, sf_dir)))


@query
def run_stats(spark, sf_dir):
    return r9(_agg(spark, sf_dir))


@query
def uniqueness_rates(spark, sf_dir):
    return r9(repro.uniqueness_rates(derived.answers(spark, sf_dir)))


@query
def self_agreement(spark, sf_dir):
    return r9(repro.self_agreement(derived.answers(spark, sf_dir)))


@query
def compute_aggregates(spark, sf_dir):
    """All ten metrics and the semantic columns."""
    rows = score.score_semantic(derived.scored(spark, sf_dir), derived.hash_encoder, batch_size=64, together=True)
    similar = semantic.semantic_repro(derived.answers(spark, sf_dir), derived.hash_encoder, PAIR_BUDGET)
    return r9(repro.compute_aggregates(rows, similar))


@query
def model_means(spark, sf_dir):
    return r9(stats.model_means(_agg(spark, sf_dir), REPRO_COLUMNS))


@query
def bootstrap_ci(spark, sf_dir):
    return r9(stats.bootstrap_ci(_agg(spark, sf_dir), REPRO_COLUMNS))


@query
def model_summary(spark, sf_dir):
    return r9(stats.model_summary(_means(spark, sf_dir), QUALITY_COLUMNS))


@query
def quality_by_model(spark, sf_dir):
    return r9(placed(report.quality_by_model(derived.scored(spark, sf_dir))))


@query
def reproducibility_by_model(spark, sf_dir):
    return r9(placed(report.reproducibility_by_model(_agg(spark, sf_dir))))


@query
def reproducibility_by_model_question(spark, sf_dir):
    return r9(report.reproducibility_by_model_question(_agg(spark, sf_dir)))


@query
def global_uniqueness(spark, sf_dir):
    return r9(placed(report.global_uniqueness(derived.answers(spark, sf_dir))))


@query
def performance_by_model(spark, sf_dir):
    return r9(placed(report.performance_by_model(score.with_performance(derived.answers(spark, sf_dir)))))


@query
def semantic_repro(spark, sf_dir):
    return r9(semantic.semantic_repro(derived.answers(spark, sf_dir), derived.hash_encoder, PAIR_BUDGET))


@query
def within_response_std(spark, sf_dir):
    return r9(judge.within_response_std(derived.judge_passes(spark, sf_dir)))


@query
def icc1(spark, sf_dir):
    return r9(judge.icc1(derived.judge_passes(spark, sf_dir)))


@query
def judge_summary(spark, sf_dir):
    return r9(judge.judge_summary(derived.judge_passes(spark, sf_dir)))


@query
def judge_parse_audit(spark, sf_dir):
    return judge.judge_parse_audit(derived.judge_passes(spark, sf_dir))


@query
def run_progress(spark, sf_dir):
    asked = grid.request_grid(derived.MODELS, derived.questions(spark, sf_dir))
    return grid.run_progress(asked, derived.answers(spark, sf_dir).filter("h % 3 <> 0"))


# --- windows, ranking, reshaping -------------------------------------------------------------------------


@query
def stratified_subset(spark, sf_dir):
    return judge.stratified_subset(derived.answers(spark, sf_dir)).select(*CELL, "response_text")


@query
def group_ratio(spark, sf_dir):
    rows = repro.group_ratio(derived.answers(spark, sf_dir))
    return r9(rows.select(*CELL, "is_unique_response", "is_unique_normalized_response"))


@query
def least_reproducible(spark, sf_dir):
    return r9(placed(report.least_reproducible(_agg(spark, sf_dir))))


@query
def union_responses(spark, sf_dir):
    rows = derived.answers(spark, sf_dir)
    done, new = rows.filter("h % 3 <> 0"), rows.filter("h % 3 = 0 OR h % 2 = 0")
    return grid.union_responses(done, new).select(*CELL, "response_text")


@query
def similarity_matrix(spark, sf_dir):
    pairs = compare.pairwise_model_similarity(derived.answers(spark, sf_dir))
    return r9(compare.similarity_matrix(pairs, [m.name for m in derived.MODELS]))


@query
def token_f1_heatmap(spark, sf_dir):
    per_question = _f1(spark, sf_dir).groupBy("model", "question_id").agg(F.avg("token_f1").alias("token_f1_mean"))
    return r9(report.token_f1_heatmap(per_question))


@query
def token_f1_bar(spark, sf_dir):
    return r9(report.token_f1_bar(_f1(spark, sf_dir)))


@query
def string_similarity_box(spark, sf_dir):
    return r9(report.string_similarity_box(derived.scored(spark, sf_dir, ("string_similarity",))))


@query
def ci_bars(spark, sf_dir):
    return r9(report.ci_bars(stats.model_summary(_agg(spark, sf_dir), REPRO_COLUMNS), REPRO_COLUMNS))


# --- scalar and pair functions ---------------------------------------------------------------------------


@query
def normalize(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", text.normalize(F.col("text")).alias("normalized"), F.char_length("text").alias("chars")
    )


def _scores(*metrics: str) -> Query:
    def build(spark, sf_dir):
        return r9(score.score_lexical(derived.answers(spark, sf_dir, normalized=True), metrics).select(*CELL, *metrics))

    return build


CATALOG["exact_match"] = _scores("exact_match", "normalized_exact_match")
CATALOG["token_f1"] = _scores("token_f1")
CATALOG["bleu"] = _scores("bleu")
CATALOG["rouge_l"] = _scores("rouge_l")
CATALOG["string_similarity"] = _scores("string_similarity")


@query
def embedding_match(spark, sf_dir):
    pairs = derived.vector_pairs(spark, sf_dir)
    return r9(
        pairs.select("pair_id", vectors.match_vectors(F.col("cand"), F.col("ref")).alias("m")).select(
            "pair_id", "m.*"
        )
    )


@query
def score_semantic(spark, sf_dir):
    rows = score.score_semantic(derived.answers(spark, sf_dir), derived.hash_encoder, batch_size=64)
    return r9(rows.select(*CELL, *[f"bertscore_{p}" for p in ("precision", "recall", "f1")]))


@query
def parse_judge_score(spark, sf_dir):
    parsed = text.parse_judge_score(F.col("judge_text")).alias("judge_score")
    return derived.answers(spark, sf_dir).select(*CELL, parsed)


@query
def judge_requests(spark, sf_dir):
    rows = judge.judge_requests(derived.answers(spark, sf_dir))
    return rows.select(*CELL, "judge_prompt", "judge_fallback")


@query
def preview(spark, sf_dir):
    turns = derived.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", text.preview(F.col("text")).alias("preview"))


@query
def format_mean_ci(spark, sf_dir):
    summary = stats.model_summary(_agg(spark, sf_dir), REPRO_COLUMNS)
    cells = [
        render.format_mean_ci(*[F.col(f"{c}_{part}") for part in ("mean", "ci_low", "ci_high")]).alias(name)
        for c, name in zip(REPRO_COLUMNS, ("agreement", "uniqueness"))
    ]
    return summary.select(F.col("model").alias("Model"), *cells)


# --- caller's functions ----------------------------------------------------------------------------------


@query
def run_requests(spark, sf_dir):
    asked = grid.request_grid(derived.MODELS, derived.questions(spark, sf_dir), base_seed=42)
    replied = grid.run_requests(asked, derived.hash_generate)
    return replied.select(*[c for c in grid.RESPONSE_COLUMNS if c not in ("timestamp_utc", "prompt_eval_count")])


@query
def apply_judge(spark, sf_dir):
    judged = judge.apply_judge(derived.answers(spark, sf_dir), derived.hash_judge)
    return judged.select(*CELL, "judge_score", "judge_rationale")


@query
def rejudge(spark, sf_dir):
    return judge.rejudge(derived.answers(spark, sf_dir), derived.hash_judge).drop("judge_error")


@query
def judge_reliability(spark, sf_dir):
    rows = derived.answers(spark, sf_dir)
    return r9(staged.judge_reliability(rows, derived.hash_judge, stages.scratch_dir(spark))["judge_reliability_summary"])


@query
def encode(spark, sf_dir):
    encoded = vectors.encode(derived.table(spark, sf_dir, "conversations"), "text", derived.hash_encoder, 64)

    def total(d: int):
        return F.aggregate("vectors", F.lit(0.0), lambda s, v: s + v[d].cast("double")).alias(f"s{d + 1}")

    sums = [total(d) for d in range(8)]
    return encoded.select("text", F.size("vectors").cast("bigint").alias("vectors"), *sums)


@query
def evaluate(spark, sf_dir):
    models = [grid.ModelSpec(f"m{i}", 3) for i in (1, 2, 3)]
    tables = staged.evaluate(
        derived.questions(spark, sf_dir), models, derived.hash_generate, stages.scratch_dir(spark),
        encoder=derived.hash_encoder, base_seed=42, max_pairs=3, n_boot=200, batch_size=64,
    )
    return r9(tables["part_2_reproducibility"])


# --- report tables ---------------------------------------------------------------------------------------


@query
def table_1_quality(spark, sf_dir):
    summary = stats.model_summary(_means(spark, sf_dir), QUALITY_COLUMNS)
    return report.mean_ci_table(summary, report.QUALITY_TITLES)


@query
def table_2_reproducibility(spark, sf_dir):
    summary = stats.model_summary(_agg(spark, sf_dir), REPRO_COLUMNS)
    return report.mean_ci_table(summary, report.REPRODUCIBILITY_TITLES)


# --- streaming -------------------------------------------------------------------------------------------


def _land_twice(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    base = stages.scratch_dir(spark)
    for _ in range(2):
        stages.write_jsonl(derived.answers(spark, sf_dir).drop("h", "judge_text"), f"{base}/landing", "append")
    return f"{base}/landing", f"{base}/out", f"{base}/checkpoint"


@query
def stream_responses(spark, sf_dir):
    landing, out, checkpoint = _land_twice(spark, sf_dir)
    ingest.stream_responses(spark, landing, out, checkpoint).awaitTermination()
    return ingest.read_landed(spark, out).select(*RAW)


@query
def stream_progress(spark, sf_dir):
    landing, out, checkpoint = _land_twice(spark, sf_dir)
    ingest.stream_progress(spark, landing, out, checkpoint).awaitTermination()
    return ingest.read_progress(spark, out)
