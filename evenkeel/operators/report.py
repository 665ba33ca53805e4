"""Report and figure tables, one small DataFrame each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.functions.hashing import fingerprint, number
from evenkeel.functions.render import format_mean_ci
from evenkeel.operators.groups import IN_MEMORY_ROWS, aggregate_with_quantiles, all_equal, pin_small
from evenkeel.operators.score import present, with_normalized

QUALITY = ("token_f1", "string_similarity", "exact_match", "bleu", "rouge_l", "bertscore_f1", "judge_score")
PERFORMANCE = ("latency_ms", "output_tokens", "tokens_per_second")
REPRODUCIBILITY = ("normalized_self_agreement_rate", "normalized_response_uniqueness_rate")

# The columns of the two interval tables and their printed titles.
QUALITY_TITLES = {
    "bertscore_f1_mean": "BERTScore F1",
    "token_f1_mean": "Token F1",
    "rouge_l_mean": "ROUGE-L",
    "judge_score_mean": "Judge",
}
REPRODUCIBILITY_TITLES = {
    "normalized_self_agreement_rate": "Self-agreement (lexical) ↑",
    "normalized_response_uniqueness_rate": "Uniqueness (lexical) ↓",
    "semantic_self_similarity_mean": "Semantic self-similarity ↑",
}


def _mean_and_median(df: DataFrame, columns: Sequence[str], in_memory_rows: int) -> DataFrame:
    cols = present(df, columns)
    out = aggregate_with_quantiles(
        df.select("model", *[number(F.col(c)).alias(c) for c in cols]),
        ["model"],
        [F.avg(c).alias(f"{c}_avg") for c in cols],
        {f"{c}_median": (c, 0.5) for c in cols},
        in_memory_rows,
    )
    return out.select("model", *[f"{c}_{s}" for s in ("avg", "median") for c in cols])


def quality_by_model(df: DataFrame, in_memory_rows: int = IN_MEMORY_ROWS) -> DataFrame:
    """Mean and median per model over all answers, best mean token F1 first."""
    out = _mean_and_median(df, QUALITY, in_memory_rows)
    return out.orderBy(F.desc_nulls_last("token_f1_avg"), "model") if "token_f1" in df.columns else out


def performance_by_model(df: DataFrame, in_memory_rows: int = IN_MEMORY_ROWS) -> DataFrame:
    """Mean and median latency, tokens and throughput per model, fastest first; a note without the columns."""
    if not present(df, PERFORMANCE):
        return df.sparkSession.createDataFrame([("Latency/token columns are unavailable.",)], "note string")
    out = _mean_and_median(df, PERFORMANCE, in_memory_rows)
    return out.orderBy(F.asc_nulls_last("latency_ms_avg"), "model") if "latency_ms" in df.columns else out


def reproducibility_by_model(aggregates: DataFrame) -> DataFrame:
    """Question-weighted mean of the two rates, most stable model first."""
    cols = present(aggregates, REPRODUCIBILITY)
    out = aggregates.groupBy("model").agg(*[F.avg(c).alias(c) for c in cols])
    return out.orderBy(F.desc_nulls_last(REPRODUCIBILITY[0]), "model") if REPRODUCIBILITY[0] in cols else out


def reproducibility_by_model_question(aggregates: DataFrame) -> DataFrame:
    return aggregates.select(*present(aggregates, ("model", "question_id", "n_runs", *REPRODUCIBILITY)))


def least_reproducible(aggregates: DataFrame, k: int = 20) -> DataFrame:
    """The k least stable (model, question) groups."""
    return (
        reproducibility_by_model_question(aggregates)
        .orderBy(
            F.asc_nulls_last(REPRODUCIBILITY[0]), F.desc_nulls_last(REPRODUCIBILITY[1]), "model", "question_id"
        )
        .limit(k)
    )


def global_uniqueness(df: DataFrame, missing_text: str | None = None, approximate: bool = False) -> DataFrame:
    """Per model: answers, distinct raw and normalised answers over all questions, and the two rates.

    Counted in two levels keyed by text fingerprint, so a model with most of the rows is spread over tasks;
    ``approximate`` replaces the first level by sketches.
    """
    rows = with_normalized(df, missing_text)
    raw, norm = F.col("response_text"), F.col("normalized_response")  # raw counts skip missing text under any policy
    if approximate:
        counts = rows.groupBy("model").agg(
            F.count(raw).alias("total_outputs"),
            F.approx_count_distinct(raw).alias("unique_outputs"),
            F.approx_count_distinct(norm).alias("unique_normalized_outputs"),
        )
    else:
        texts = rows.select(
            "model",
            F.explode(
                F.array(
                    F.struct(F.lit(True).alias("raw"), fingerprint(raw).alias("print")),
                    F.struct(F.lit(False).alias("raw"), fingerprint(norm).alias("print")),
                )
            ).alias("t"),
        )
        counts = (
            texts.groupBy("model", "t.raw", "t.print")
            .agg(F.count("t.print").alias("copies"))
            .groupBy("model")
            .agg(
                F.coalesce(F.sum(F.when(F.col("raw"), F.col("copies"))), F.lit(0)).alias("total_outputs"),
                F.count(F.when(F.col("raw"), F.col("print"))).alias("unique_outputs"),
                F.count(F.when(~F.col("raw"), F.col("print"))).alias("unique_normalized_outputs"),
            )
        )

    def rate(column: str) -> Column:
        return F.try_divide(F.col(column).cast("double"), F.col("total_outputs"))

    return counts.withColumns(
        {
            "global_response_uniqueness_rate": rate("unique_outputs"),
            "global_normalized_uniqueness_rate": rate("unique_normalized_outputs"),
        }
    ).orderBy(F.asc_nulls_last("global_normalized_uniqueness_rate"), "model")


def token_f1_heatmap(
    aggregates: DataFrame, question_ids: Sequence[str] | None = None
) -> DataFrame:
    """Mean of ``token_f1_mean`` per (model, question): long form, or wide for the given questions."""
    cells = aggregates.dropna(subset=["model", "question_id"])
    value = F.avg("token_f1_mean").alias("token_f1_mean")
    if question_ids is None:
        return cells.groupBy("model", "question_id").agg(value)
    return cells.groupBy("model").pivot("question_id", list(question_ids)).agg(value)


def token_f1_bar(df: DataFrame) -> DataFrame:
    """Mean per model with the ends of a one-standard-deviation bar."""
    mean, sd = F.avg("token_f1"), F.stddev_samp("token_f1")
    return df.groupBy("model").agg(
        mean.alias("mean"), sd.alias("sd"), (mean - sd).alias("low"), (mean + sd).alias("high")
    )


def string_similarity_box(
    df: DataFrame, column: str = "string_similarity", in_memory_rows: int = IN_MEMORY_ROWS
) -> DataFrame:
    """Per model: quartiles, whiskers (outermost values within 1.5 IQR) and how many values lie outside.

    The boxes, one row per model, are pinned before the join, so the answers are not shuffled by model for it.
    """
    rows = df.select("model", number(F.col(column)).alias("value"))
    marks = {"q1": ("value", 0.25), "median": ("value", 0.5), "q3": ("value", 0.75)}
    boxes = pin_small(aggregate_with_quantiles(rows, ["model"], [], marks, in_memory_rows))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    joined = rows.join(boxes, all_equal(rows, boxes, ["model"])).select(rows["*"], *marks)
    return joined.groupBy("model", *marks).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def ci_bars(summary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``model, metric, mean, whisker_low, whisker_high``; whisker lengths are never negative."""
    cols = [c for c in columns if f"{c}_mean" in summary.columns]

    def length(value: Column) -> Column:
        return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))

    bars = [
        F.struct(
            F.lit(c).alias("metric"),
            F.col(f"{c}_mean").alias("mean"),
            length(F.col(f"{c}_mean") - F.col(f"{c}_ci_low")).alias("whisker_low"),
            length(F.col(f"{c}_ci_high") - F.col(f"{c}_mean")).alias("whisker_high"),
        )
        for c in cols
    ]
    return summary.select("model", F.explode(F.array(*bars)).alias("bar")).select("model", "bar.*")


def mean_ci_table(summary: DataFrame, titles: dict[str, str]) -> DataFrame:
    """``Model`` and one ``"m [lo, hi]"`` column per metric present."""
    return summary.select(
        F.col("model").alias("Model"),
        *[
            format_mean_ci(F.col(f"{c}_mean"), F.col(f"{c}_ci_low"), F.col(f"{c}_ci_high")).alias(title)
            for c, title in titles.items()
            if f"{c}_mean" in summary.columns
        ],
    )
