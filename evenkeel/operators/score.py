"""Per-answer columns: performance, normal forms and scores against the gold answer. No shuffle anywhere."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from evenkeel.functions import pairs, text, vectors
from evenkeel.functions.hashing import fingerprint, number

METRICS = (
    "exact_match",
    "normalized_exact_match",
    "token_f1",
    "string_similarity",
    "bleu",
    "rouge_l",
    "bertscore_precision",
    "bertscore_recall",
    "bertscore_f1",
    "judge_score",
)
LEXICAL = METRICS[:6]


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    return [c for c in columns if c in df.columns]


def with_performance(df: DataFrame) -> DataFrame:
    """Tokens, latency and throughput; a missing source column gives nulls."""
    tokens, ns = (
        number(F.col(c) if c in df.columns else F.lit(None)) for c in ("eval_count", "total_duration")
    )
    return df.withColumns(
        {
            "output_tokens": tokens,
            "latency_ms": ns / 1e6,
            "tokens_per_second": F.when(ns > 0, tokens / (ns / 1e9)),
        }
    )


def with_normalized(df: DataFrame, missing_text: str | None = None) -> DataFrame:
    """Adds ``normalized_response`` / ``normalized_gold`` where they are absent."""
    source = {"normalized_response": "response_text", "normalized_gold": "gold_answer"}
    return df.withColumns(
        {
            new: text.normalize(text.with_policy(F.col(old), missing_text))
            for new, old in source.items()
            if new not in df.columns and old in df.columns
        }
    )


def with_response_len(df: DataFrame, missing_text: str | None = None) -> DataFrame:
    return df.withColumn(
        "response_len", F.char_length(text.with_policy(F.col("response_text"), missing_text))
    )


def score_lexical(
    df: DataFrame, metrics: Sequence[str] = LEXICAL, missing_text: str | None = None
) -> DataFrame:
    """The asked lexical metrics, each null where a text is missing (except the two equality flags).

    ``normalized_gold`` and its number of tokens, ``normalized_gold_tokens``, are taken as they are where ``df`` has
    them: whoever repeats a gold answer for many responses makes them once.
    """
    out = with_normalized(df, missing_text)
    pred, gold = F.col("normalized_response"), F.col("normalized_gold")
    counts = {}
    if "bleu" in metrics:
        counts["_grams"] = pairs.ngram_matches(pred, gold)
    elif "token_f1" in metrics:
        counts["_grams"] = pairs.ngram_matches(pred, gold, order=1)
    if "rouge_l" in metrics:
        counts["_lcs"] = pairs.lcs_length(pred, gold)
    if "string_similarity" in metrics:
        counts["_chars"] = pairs.matched_chars(pred, gold)
    if {"token_f1", "bleu", "rouge_l"} & set(metrics):
        told = {"normalized_gold", "normalized_gold_tokens"} <= set(df.columns)
        n_gold = F.col("normalized_gold_tokens") if told else text.token_count(gold)
        counts |= {"_n_pred": text.token_count(pred), "_n_gold": n_gold}
    if counts:
        out = out.withColumns(counts)
    sizes = F.col("_n_pred"), F.col("_n_gold")
    raw = [text.with_policy(F.col(c), missing_text) for c in ("response_text", "gold_answer")]
    formulas = {
        "exact_match": lambda: text.same(*raw),
        "normalized_exact_match": lambda: text.same(pred, gold),
        "token_f1": lambda: pairs.token_f1(F.get("_grams", 0), *sizes),
        "string_similarity": lambda: pairs.string_similarity(F.col("_chars"), pred, gold),
        "bleu": lambda: pairs.bleu(F.col("_grams"), *sizes),
        "rouge_l": lambda: pairs.rouge_l(F.col("_lcs"), *sizes),
    }
    return out.withColumns({m: formulas[m]() for m in metrics}).drop(*counts)


def score_semantic(
    df: DataFrame,
    factory: Callable[[], vectors.Encoder],
    batch_size: int = 8,
    missing_text: str | None = None,
    store: DataFrame | None = None,
    together: bool = False,
) -> DataFrame:
    """Embedding-match precision, recall and F1 of the RAW response against the RAW gold answer.

    Rows are sorted by question inside each partition (no shuffle) so that a gold answer is encoded once; not if the
    rows of a question stand ``together`` already, as in a request grid. With a ``store`` of vectors nothing is
    encoded: distinct pairs are matched from it and joined back by fingerprint.
    """
    if store is not None:
        texts = {"_cand": "response_text", "_ref": "gold_answer"}
        marked = df.withColumns({k: fingerprint(text.with_policy(F.col(c), missing_text)) for k, c in texts.items()})
        found = vectors.match_stored(marked.select(F.col("_cand").alias("cand"), F.col("_ref").alias("ref")), store)
        parts = [F.col(part).alias(f"bertscore_{part}") for part in ("precision", "recall", "f1")]
        known = found.select(F.col("cand").alias("_cand"), F.col("ref").alias("_ref"), *parts)
        return marked.join(known, ["_cand", "_ref"], "left").drop("_cand", "_ref")
    raw = [text.with_policy(F.col(c), missing_text) for c in ("response_text", "gold_answer")]
    rows = df if together else df.sortWithinPartitions("question_id")
    matched = rows.withColumn("_match", vectors.match_texts(*raw, factory, batch_size))
    return matched.withColumns(
        {f"bertscore_{part}": F.col(f"_match.{part}") for part in ("precision", "recall", "f1")}
    ).drop("_match")


def score_responses(
    df: DataFrame,
    factory: Callable[[], vectors.Encoder] | None = None,
    batch_size: int = 8,
    missing_text: str | None = None,
    store: DataFrame | None = None,
) -> DataFrame:
    """Every deterministic column of the scored table; the embedding match only with an encoder."""
    out = score_lexical(with_performance(df), missing_text=missing_text)
    return out if factory is None else score_semantic(out, factory, batch_size, missing_text, store)
