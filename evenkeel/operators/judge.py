"""Judging answers with a caller's function, and how reliable that judge is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from evenkeel.functions.hashing import seeded_hash
from evenkeel.functions.text import parse_judge_score, strip
from evenkeel.operators.groups import IN_MEMORY_ROWS, aggregate_with_quantiles, first_k_by_hash

# Default rubric, request lead-in, reply format and the plain-text retry.
DEFAULT_RUBRIC = (
    "You are a strict clinical evaluator.\n"
    "Given QUESTION, GOLD_ANSWER and MODEL_ANSWER, score factual correctness from 0 to 1.\n"
    "Respond only as: score=<float> rationale=<brief reason>"
)
LEAD_IN = "You are a strict evaluator. Return JSON only with keys: score, rationale.\n"
OUTPUT_FORMAT = '{"score": "float_0_to_1", "rationale": "short_string"}'
RETRY_FORMAT = "Return exactly in one line: score=<float> rationale=<short reason>"

Judge = Callable[[str], str]


def _json_string(text: Column) -> Column:
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.char_length(array) - 2)


def judge_requests(df: DataFrame, rubric: str = DEFAULT_RUBRIC, missing_text: str = "nan") -> DataFrame:
    """Adds ``judge_prompt`` (JSON request) and ``judge_fallback`` (plain retry) to every answer."""
    question, gold, answer = (
        F.coalesce(F.col(c).cast("string"), F.lit(missing_text))
        for c in ("question", "gold_answer", "response_text")
    )
    fields = {"instructions": F.lit(rubric), "question": question, "gold_answer": gold, "model_answer": answer}
    body = [F.concat(F.lit(f'"{name}": '), _json_string(value)) for name, value in fields.items()]
    return df.withColumns(
        {
            "judge_prompt": F.concat(
                F.lit(LEAD_IN + "{"),
                F.concat_ws(", ", *body, F.lit(f'"output_format": {OUTPUT_FORMAT}')),
                F.lit("}"),
            ),
            "judge_fallback": F.concat(
                F.lit(f"{rubric}\n\n{RETRY_FORMAT}\n\nQUESTION: "),
                question,
                F.lit("\nGOLD_ANSWER: "),
                gold,
                F.lit("\nMODEL_ANSWER: "),
                answer,
                F.lit("\n"),
            ),
        }
    )


def _ask(factory: Callable[[], Judge], prompt: Column, fallback: Column) -> Column:
    """(text, error) of one request; a judge that fails costs its own row only."""

    def reply(judge: Judge, prompt: str, fallback: str) -> tuple[str | None, str | None]:
        try:
            return str(judge(prompt)).strip() or str(judge(fallback)).strip(), None
        except Exception as problem:  # noqa: BLE001 - any failure of the caller's function is data here
            return None, f"{type(problem).__name__}: {problem}"

    def stream(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        judge = None
        for prompts, fallbacks in batches:
            if judge is None and len(prompts):
                judge = factory()
            rows = [reply(judge, *both) for both in zip(prompts, fallbacks)]
            yield pd.DataFrame(rows, columns=["text", "error"], dtype=object)

    stream.__annotations__ = {
        "batches": Iterator[tuple[pd.Series, pd.Series]],
        "return": Iterator[pd.DataFrame],
    }
    return F.pandas_udf(stream, "text string, error string").asNondeterministic()(prompt, fallback)


def apply_judge(
    df: DataFrame,
    factory: Callable[[], Judge] | None,
    rubric: str = DEFAULT_RUBRIC,
    enabled: bool = True,
) -> DataFrame:
    """Adds ``judge_score``, ``judge_rationale`` (the whole reply) and ``judge_error``.

    An empty reply is asked once more. A call that fails leaves score and reply null and says why in
    ``judge_error``. Replies are not repeatable: write the result before using it twice.
    """
    if not enabled:
        return df.withColumns(
            {
                "judge_score": F.lit(None).cast("double"),
                "judge_rationale": F.lit(""),
                "judge_error": F.lit(None).cast("string"),
            }
        )
    if factory is None:
        raise ValueError("judge is enabled but no judge is given")
    asked = judge_requests(df, rubric).withColumn(
        "_reply", _ask(factory, F.col("judge_prompt"), F.col("judge_fallback"))
    )
    return asked.select(
        *df.columns,
        parse_judge_score(F.col("_reply.text")).alias("judge_score"),
        F.col("_reply.text").alias("judge_rationale"),
        F.col("_reply.error").alias("judge_error"),
    )


def judge_parse_audit(judged: DataFrame) -> DataFrame:
    """Rows, parsed scores and parse failures."""
    return judged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("judge_score").alias("parsed_scores"),
        F.count_if(F.col("judge_score").isNull()).alias("parse_failures"),
    )


def require_parsed(judged: DataFrame) -> DataFrame:
    """Raises when there are rows and none could be parsed; else returns the table. Runs one count."""
    counts = judge_parse_audit(judged).first()
    if counts["n_rows"] and counts["parse_failures"] == counts["n_rows"]:
        raise RuntimeError("the judge produced no parseable score for any row")
    return judged


def _ranked_subset(df: DataFrame, n: int, seed: int, order_by: str | None) -> DataFrame:
    known = df.filter(F.col("model").isNotNull())
    key = ["question_id", "run_index"]
    draw = seeded_hash(seed, F.col("model"), *[F.col(k) for k in key])
    tiebreak = [*key, *[c for c in ("response_text",) if c in df.columns]]
    candidates = first_k_by_hash(known, ["model"], n, draw, tiebreak)
    # one row per model from here on: the model list of the run
    seen = candidates if order_by is None else known
    models = seen.groupBy("model").agg(F.min(order_by or "model").alias("first_seen"))
    in_order = Window.orderBy("first_seen", "model")
    models = models.select(
        "model",
        F.row_number().over(in_order).alias("model_rank"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n_models"),
    )
    within = Window.partitionBy("model").orderBy("draw", *tiebreak)
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("n_models")))
    return (
        candidates.withColumn("draw", draw)
        .withColumn("rank_in_model", F.row_number().over(within))
        .join(models, "model")
        .filter(F.col("rank_in_model") <= quota)
        .orderBy("model_rank", "rank_in_model")
        .limit(n)
        .drop("draw", "n_models")
    )


def stratified_subset(df: DataFrame, n: int = 25, seed: int = 42, order_by: str | None = None) -> DataFrame:
    """Up to ``max(1, n // models)`` answers per model by seeded draw, models in order of ``min(order_by)``
    (by name without it), then the first ``n`` overall; what a small model leaves is not redistributed."""
    if n < 1:
        raise ValueError("subset size must be at least 1")
    return _ranked_subset(df, n, seed, order_by).drop("model_rank", "rank_in_model")


def rejudge(
    df: DataFrame,
    factory: Callable[[], Judge],
    subset: int = 25,
    passes: int = 5,
    rubric: str = DEFAULT_RUBRIC,
    seed: int = 42,
    order_by: str | None = None,
) -> DataFrame:
    """Every answer of the stratified subset judged ``passes`` times, in long form; failed calls say why."""
    if passes < 2 or subset < 1:
        raise ValueError("passes must be at least 2 and subset at least 1")
    tasks = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), subset * passes)
    position = Window.orderBy("model_rank", "rank_in_model")  # at most ``subset`` rows
    calls = (
        judge_requests(_ranked_subset(df, subset, seed, order_by), rubric)
        .withColumn("response_idx", F.row_number().over(position) - 1)
        .withColumn("pass_index", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        .repartition(tasks, "response_idx", "pass_index")
    )
    replied = calls.withColumn("_reply", _ask(factory, F.col("judge_prompt"), F.col("judge_fallback")))
    return replied.select(
        "response_idx",
        "model",
        "question_id",
        "run_index",
        "pass_index",
        parse_judge_score(F.col("_reply.text")).alias("judge_score"),
        F.col("_reply.text").alias("judge_text"),
        F.col("_reply.error").alias("judge_error"),
    )


def _per_response(long: DataFrame) -> DataFrame:
    score = F.col("judge_score")
    return long.groupBy("response_idx").agg(
        F.count(score).alias("parsed"),
        F.sum(score).alias("total"),
        (F.var_pop(score) * F.count(score)).alias("ss_within"),
        F.stddev_samp(score).alias("within_std"),
        F.min(score).alias("lowest"),
        F.max(score).alias("highest"),
        F.max("pass_index").alias("last_pass"),
    )


def within_response_std(long: DataFrame) -> DataFrame:
    """Sample std over the parsed passes of each response that has at least two."""
    return _per_response(long).filter(F.col("parsed") >= 2).select("response_idx", "parsed", "within_std")


def _by_score(responses: DataFrame) -> DataFrame:
    """Each response as often as it has parsed scores (once at least), with its mean; the rest on the first row only.

    A variance over these rows weighs the means by their scores, and Spark's merges centred moments, so scores that lie
    close together lose nothing.
    """
    first = F.col("copy") == 1
    alone = [c for c in responses.columns if c not in ("parsed", "total")]
    return responses.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("parsed", F.lit(1)).cast("int")))).select(
        *[F.when(first, F.col(c)).alias(c) for c in alone],
        F.when(F.col("parsed") >= 2, F.col("total") / F.col("parsed")).alias("mean"),
        (first & (F.col("parsed") >= 2)).alias("counted"),
    )


def _icc_parts() -> list[Column]:
    def over(value: Column, how=F.sum) -> Column:
        return how(F.when(F.col("counted"), value))

    return [
        F.count_if("counted").alias("_targets"),
        F.count("mean").alias("_scores"),
        (F.var_pop("mean") * F.count("mean")).alias("_between"),
        over(F.col("ss_within")).alias("_within"),
        (over(F.col("lowest"), F.min) == over(F.col("highest"), F.max)).alias("_constant"),
    ]


def _icc() -> Column:
    targets, scores = F.col("_targets"), F.col("_scores")
    k = scores / targets
    between = F.col("_between") / (targets - 1)
    within = F.col("_within") / (scores - targets)
    defined = (targets >= 2) & (scores > targets) & ~F.col("_constant")
    return F.when(defined, F.try_divide(between - within, between + (k - 1) * within))


def icc1(long: DataFrame) -> DataFrame:
    """One-way random-effects ICC(1) over responses with at least two parsed passes; one row."""
    return _by_score(_per_response(long)).agg(*_icc_parts()).select(_icc().alias("icc1"))


def judge_summary(long: DataFrame, in_memory_rows: int = IN_MEMORY_ROWS) -> DataFrame:
    """passes, n_responses, mean and median within-response std, ICC(1); one row."""
    counted = _by_score(_per_response(long)).withColumn("std", F.when(F.col("counted"), F.col("within_std")))
    row = aggregate_with_quantiles(
        counted,
        [],
        [
            (F.max("last_pass") + 1).cast("double").alias("passes"),
            F.avg("std").alias("mean_within_response_std"),
            *_icc_parts(),
        ],
        {"median_within_response_std": ("std", 0.5)},
        in_memory_rows,
    )
    return row.select(
        "passes",
        F.col("_targets").cast("double").alias("n_responses"),
        "mean_within_response_std",
        "median_within_response_std",
        _icc().alias("icc1"),
    )
