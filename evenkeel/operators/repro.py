"""Per-(model, question) statistics over repeated runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.functions.hashing import fingerprint, number
from evenkeel.operators.groups import IN_MEMORY_ROWS, aggregate_with_quantiles
from evenkeel.operators.score import METRICS, present, with_normalized, with_response_len

GROUP = ("model", "question_id")
RAW, NORMALIZED = 0, 1
STATS = ("mean", "median", "std", "min", "max")
RUN_STATS = (
    "n_runs",
    "unique_responses",
    "unique_normalized_responses",
    "avg_response_length",
    "response_uniqueness_rate",
    "normalized_response_uniqueness_rate",
    "modal_normalized_response_count",
    "normalized_self_agreement_rate",
)


def _moments(metrics: Sequence[str]) -> tuple[list[Column], dict[str, tuple[str, float]]]:
    by_stat = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    plain = [f(m).alias(f"{m}_{s}") for m in metrics for s, f in by_stat.items()]
    return plain, {f"{m}_median": (m, 0.5) for m in metrics}


def _stat_names(metrics: Sequence[str]) -> list[str]:
    return [f"{m}_{s}" for m in metrics for s in STATS]


def _metric_rows(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return df.select(*GROUP, *[number(F.col(m)).alias(m) for m in metrics])


def _text_counts(df: DataFrame, missing_text: str | None) -> DataFrame:
    """One row per (model, question, raw or normalised, distinct text): how often it occurs.

    First of two aggregation levels: keyed by text as well, so a huge group is spread over tasks, combined
    map-side, and only fingerprints travel.
    """
    rows = with_response_len(with_normalized(df, missing_text), missing_text)
    raw, norm = F.col("response_text"), F.col("normalized_response")  # raw counts skip missing text under any policy
    return (
        rows.select(
            *GROUP,
            "run_index",
            "response_len",
            F.explode(
                F.array(
                    F.struct(F.lit(RAW).alias("kind"), fingerprint(raw).alias("print")),
                    F.struct(F.lit(NORMALIZED).alias("kind"), fingerprint(norm).alias("print")),
                )
            ).alias("text"),
        )
        .groupBy(*GROUP, "text.kind", "text.print")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.count("run_index").alias("runs"),
            F.sum("response_len").alias("chars"),
            F.count("response_len").alias("measured"),
        )
    )


def _run_aggregates() -> list[Column]:
    raw, norm = F.col("kind") == RAW, F.col("kind") == NORMALIZED
    known = F.col("print").isNotNull()
    return [
        F.coalesce(F.sum(F.when(raw, F.col("runs"))), F.lit(0)).alias("n_runs"),
        F.count_if(raw & known).alias("unique_responses"),
        F.count_if(norm & known).alias("unique_normalized_responses"),
        F.sum(F.when(raw, F.col("chars"))).alias("_chars"),
        F.sum(F.when(raw, F.col("measured"))).alias("_measured"),
        F.max(F.when(norm, F.col("copies"))).alias("modal_normalized_response_count"),
    ]


def _rates(df: DataFrame) -> DataFrame:
    def per_run(column: str) -> Column:
        return F.try_divide(F.col(column).cast("double"), F.col("n_runs"))

    return df.withColumns(
        {
            "avg_response_length": F.try_divide(F.col("_chars").cast("double"), F.col("_measured")),
            "response_uniqueness_rate": per_run("unique_responses"),
            "normalized_response_uniqueness_rate": per_run("unique_normalized_responses"),
            "normalized_self_agreement_rate": per_run("modal_normalized_response_count"),
        }
    ).drop("_chars", "_measured")


def metric_stats(df: DataFrame, in_memory_rows: int = IN_MEMORY_ROWS) -> DataFrame:
    """Mean, median, sample std, min and max of every metric present, per (model, question)."""
    metrics = present(df, METRICS)
    plain, medians = _moments(metrics)
    out = aggregate_with_quantiles(_metric_rows(df, metrics), GROUP, plain, medians, in_memory_rows)
    return out.select(*GROUP, *_stat_names(metrics))


def run_stats(df: DataFrame, missing_text: str | None = None) -> DataFrame:
    """Run, uniqueness and self-agreement statistics per (model, question)."""
    counted = _text_counts(df, missing_text).groupBy(*GROUP).agg(*_run_aggregates())
    return _rates(counted).select(*GROUP, *RUN_STATS)


def uniqueness_rates(df: DataFrame, missing_text: str | None = None) -> DataFrame:
    return run_stats(df, missing_text).select(
        *GROUP, "response_uniqueness_rate", "normalized_response_uniqueness_rate"
    )


def self_agreement(df: DataFrame, missing_text: str | None = None) -> DataFrame:
    """Share of runs that give the most frequent normalised answer; a missing text counts as an answer."""
    return run_stats(df, missing_text).select(
        *GROUP, "n_runs", "modal_normalized_response_count", "normalized_self_agreement_rate"
    )


def compute_aggregates(
    df: DataFrame,
    semantic: DataFrame | None = None,
    missing_text: str | None = None,
    in_memory_rows: int = IN_MEMORY_ROWS,
) -> DataFrame:
    """The per-(model, question) table: metric statistics, run statistics, optional semantic columns.

    Metric rows and text counts are stacked and grouped once instead of grouped twice and joined, so the
    wide part needs a single exchange and null keys need no null-safe join.
    """
    metrics = present(df, METRICS)
    plain, medians = _moments(metrics)
    values = _metric_rows(df, metrics)
    stacked = values.unionByName(_text_counts(df, missing_text), allowMissingColumns=True)
    grouped = aggregate_with_quantiles(
        stacked, GROUP, [*plain, *_run_aggregates()], medians, in_memory_rows, values
    )
    out = _rates(grouped).select(*GROUP, *_stat_names(metrics), *RUN_STATS)
    return out if semantic is None else attach_semantic(out, semantic)


def attach_semantic(aggregates: DataFrame, semantic: DataFrame) -> DataFrame:
    """Left join of the semantic columns; a group without a key never matches (that side has none)."""
    return aggregates.join(semantic.dropna(subset=list(GROUP)), list(GROUP), "left")


def group_ratio(df: DataFrame, missing_text: str | None = None) -> DataFrame:
    """Distinct ÷ size of its (model, question) on every row, for raw and normalised answers.

    Aggregated first and joined back; a window would gather each group, and its set, in one task.
    """
    kind = F.col("kind")
    ratios = (
        _text_counts(df, missing_text)
        .groupBy(*GROUP)
        .agg(
            *[
                F.try_divide(
                    F.count_if((kind == k) & F.col("print").isNotNull()).cast("double"),
                    F.sum(F.when(kind == k, F.col("copies"))),
                ).alias(name)
                for k, name in ((RAW, "is_unique_response"), (NORMALIZED, "is_unique_normalized_response"))
            ]
        )
        .dropna(subset=list(GROUP))
    )
    return df.join(ratios, list(GROUP), "left")
