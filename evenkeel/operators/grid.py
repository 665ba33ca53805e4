"""The request grid, what is left to do of it, and the calls themselves."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

KEY = ("model", "question_id", "run_index")
REPLY_SCHEMA = (
    "timestamp_utc string, response_text string, done boolean, total_duration bigint, "
    "eval_count bigint, prompt_eval_count bigint, error string"
)
RESPONSE_COLUMNS = (
    "timestamp_utc",
    "model",
    "provider",
    "question_id",
    "question",
    "gold_answer",
    "category",
    "run_index",
    "seed",
    "response_text",
    "done",
    "total_duration",
    "eval_count",
    "prompt_eval_count",
    "shared_instruction",
)

TASKS = 8  # tasks a core that keys are joined in

Generate = Callable[..., dict]


@dataclass(frozen=True)
class ModelSpec:
    name: str
    runs_per_prompt: int | None = None
    provider: str = "ollama"

    def __post_init__(self):
        if self.runs_per_prompt is not None and self.runs_per_prompt < 1:
            raise ValueError("runs_per_prompt must be at least 1")


def request_grid(
    models: Sequence[ModelSpec],
    questions: DataFrame,
    runs_per_prompt: int = 100,
    base_seed: int | None = None,
    deterministic: bool = True,
    shared_instruction: str | None = None,
    tasks: int | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """models × questions × runs, one row per request, expanded in place on every question row.

    ``extra`` names further columns of the questions that every request keeps.

    A question becomes models × runs rows, so the questions are first spread over ``tasks`` partitions (the
    shuffle partitions by default): moving one question is cheaper than letting one input split grow
    a thousandfold in its task. Later groupings by question find the grid already partitioned for them.
    """
    if runs_per_prompt < 1:
        raise ValueError("runs_per_prompt must be at least 1")
    tasks = tasks or int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("model"),
                F.lit(m.provider).alias("provider"),
                F.lit(m.runs_per_prompt or runs_per_prompt).alias("runs"),
            )
            for m in models
        ]
    )
    seed = F.lit(None).cast("bigint")
    if deterministic and base_seed is not None:
        seed = F.lit(base_seed).cast("bigint") + F.col("run_index")
    category = F.col("category") if "category" in questions.columns else F.lit("")
    return (
        questions.repartition(tasks, "id").select(
            F.col("id").alias("question_id"), "question", "gold_answer", category.alias("category"),
            *extra, F.explode(plan).alias("m"),
        )
        .select(
            "m.model",
            "m.provider",
            "question_id",
            "question",
            "gold_answer",
            "category",
            *extra,
            F.explode(F.sequence(F.lit(0), F.col("m.runs") - 1)).alias("run_index"),
        )
        .withColumn("seed", seed)
        .withColumn("system", F.lit((shared_instruction or "").strip() or None).cast("string"))
    )


def _spread(df: DataFrame) -> DataFrame:
    """Dealt by key over a fixed number of tasks.

    Keys of a grid are small as shuffled bytes and large in a sort, so adaptive execution would join very many in a task.
    """
    session = df.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), TASKS * session.sparkContext.defaultParallelism)
    return df.repartition(tasks, *KEY)


def pending_requests(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Grid rows without an answer yet."""
    return _spread(grid).join(_spread(done.select(*KEY)).distinct(), list(KEY), "left_anti")


def union_responses(done: DataFrame, new: DataFrame) -> DataFrame:
    """Checkpoint rows plus new rows, one per key, the checkpoint's first; replays are pruned before the shuffle."""
    both = done.withColumn("_new", F.lit(0)).unionByName(
        new.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    tiebreak = [c for c in ("timestamp_utc", "response_text") if c in both.columns]
    order = Window.partitionBy(*KEY).orderBy("_new", *[F.col(c).asc_nulls_last() for c in tiebreak])
    return both.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") == 1).drop("_rn", "_new")


def within_grid(done: DataFrame, grid: DataFrame) -> DataFrame:
    """Answers whose key is still asked for; drops what a changed question file left behind."""
    return done.join(grid.select(*KEY), list(KEY), "left_semi")


def run_progress(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Per model: requests in the grid, answered, still open."""
    answered = _spread(done.select(*KEY)).distinct().withColumn("answered", F.lit(1))
    counts = _spread(grid.select(*KEY)).join(answered, list(KEY), "left").groupBy("model").agg(
        F.count(F.lit(1)).alias("total_calls"), F.count("answered").alias("completed_calls")
    )
    return counts.withColumn("pending_calls", F.col("total_calls") - F.col("completed_calls"))


def run_requests(pending: DataFrame, factory: Callable[[], Generate], tasks: int | None = None) -> DataFrame:
    """One call per pending row.

    ``factory()`` is called in a task only once it has a row and returns
    ``generate(model=, prompt=, seed=, system=) -> dict``; a function that has a parameter ``provider`` gets that
    too, so one run can ask models of several providers. A failed call becomes a row with ``error`` set, to be
    kept out of the checkpoint so that :func:`pending_requests` offers it again. Calls are not repeatable:
    write the result before using it twice. ``tasks`` spreads the calls when the question source has few
    partitions.
    """

    def takes_provider(generate: Generate) -> bool:
        try:
            return "provider" in inspect.signature(generate).parameters
        except (TypeError, ValueError):  # a callable without a readable signature
            return False

    def call(
        generate: Generate, more: bool, model: str, prompt: str, seed: str | None, system: str | None, provider: str
    ) -> tuple:
        now = datetime.now(UTC).isoformat()
        extra = {"provider": provider} if more else {}
        try:
            reply = generate(
                model=model, prompt=prompt, seed=None if seed is None else int(seed), system=system, **extra
            )
        except Exception as problem:  # noqa: BLE001 - any failure of the caller's function is data here
            return now, None, False, None, None, None, f"{type(problem).__name__}: {problem}"
        counts = (reply.get(k) for k in ("total_duration", "eval_count", "prompt_eval_count"))
        return now, str(reply.get("response", "")), bool(reply.get("done", False)), *counts, None

    def stream(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        generate, more = None, False
        names = [part.split()[0] for part in REPLY_SCHEMA.split(", ")]
        for columns in batches:
            if generate is None and len(columns[0]):
                generate = factory()
                more = takes_provider(generate)
            rows = [call(generate, more, *values) for values in zip(*columns)]
            frame = pd.DataFrame(rows, columns=names, dtype=object)
            yield frame.astype({c: "Int64" for c in ("total_duration", "eval_count", "prompt_eval_count")})

    stream.__annotations__ = {
        "batches": Iterator[tuple[pd.Series, ...]],
        "return": Iterator[pd.DataFrame],
    }
    ask = F.pandas_udf(stream, REPLY_SCHEMA).asNondeterministic()
    provider = F.col("provider") if "provider" in pending.columns else F.lit(None).cast("string")
    spread = pending if tasks is None else pending.repartition(tasks, *KEY)
    return spread.withColumn(
        "reply", ask("model", "question", F.col("seed").cast("string"), "system", provider)
    ).select(
        "reply.*",
        *[c for c in RESPONSE_COLUMNS if c in pending.columns],
        F.coalesce("system", F.lit("")).alias("shared_instruction"),
    ).select(*RESPONSE_COLUMNS, "error")
