"""Evaluation tables derived from the given chat, document and vector tables.

Every user turn is a question; the assistant's next turn is its gold answer, which is missing where there is none. Five
models answer each question ten times with words of the gold answer (of the question, where that is missing) that depend
on a hash, so answers repeat, differ, miss and fail to parse in known proportions. Most are a short run of words; one in
nine is long: the whole text with every seventh word dropped, or with its halves swapped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from evenkeel.functions.hashing import seeded_hash
from evenkeel.functions.text import normalize, parse_judge_score, token_count
from evenkeel.operators.grid import ModelSpec, request_grid
from evenkeel.operators.score import LEXICAL, score_lexical, with_performance

MODELS = tuple(ModelSpec(f"m{i}", 10) for i in range(1, 6))
HASH_SEED = 7
VECTORS_PER_TEXT = 8
TOKENS = 50_000  # token vectors that the stand-in encoder remembers
TESTED = LEXICAL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold_answer")
    )
    return asked.join(replies, ["conv_id", "turn"], "left").select(
        F.concat(F.lit("c"), "conv_id", F.lit("t"), "turn").alias("id"),
        "question",
        "gold_answer",
        F.lit("").alias("category"),
        "conv_id",
        "turn",
    )


def answers(spark: SparkSession, sf_dir: str, normalized: bool = False) -> DataFrame:
    """All answers; ``normalized`` adds the normal form of the gold answer, made once a question."""
    asked = questions(spark, sf_dir)
    if normalized:
        asked = asked.withColumn("normalized_gold", normalize(F.col("gold_answer")))
        asked = asked.withColumn("normalized_gold_tokens", token_count(F.col("normalized_gold")))
    extra = ("normalized_gold", "normalized_gold_tokens") if normalized else ()
    grid = request_grid(MODELS, asked, base_seed=42, extra=extra).drop("system")
    h, k = F.col("h"), F.col("k")
    words = F.split(F.coalesce("gold_answer", "question"), " ")
    half = (F.size(words) / 2).cast("int")
    body = F.when(h % 18 == 4, F.filter(words, lambda w, i: i % 7 != 6)).when(
        h % 18 == 13, F.concat(F.slice(words, half + 1, F.size(words)), F.slice(words, F.lit(1), half))
    ).otherwise(F.concat(
        F.slice(words, F.when(h % 4 == 0, 2).otherwise(1), k.cast("int")),
        F.when(h % 6 == 1, F.slice(words, 1, 2)).otherwise(F.array().cast("array<string>")),
    ))
    text = F.concat(F.array_join(body, " "), F.when(h % 5 == 0, ".").otherwise(""))
    digit = (h % 10).cast("string")
    reply = (
        F.when(h % 5 == 0, "")
        .when(h % 5 == 1, "no score given")
        .when(h % 5 == 2, F.concat(F.lit('{"score": 0.'), digit, F.lit(', "rationale": "x"}')))
        .when(h % 5 == 3, F.concat(F.lit("Score = 1."), digit, F.lit(" rationale=x")))
        .otherwise(F.concat(F.lit("score=0."), digit, F.lit(" rationale=x")))
    )
    return (
        grid.withColumn("h", seeded_hash(HASH_SEED, F.col("model"), F.col("question_id"), F.col("run_index")))
        .withColumn("k", 4 + h % (3 * F.substring("model", 2, 1).cast("int")))
        .withColumns(
            {
                "response_text": F.when(h % 101 == 0, None).when(h % 103 == 0, "").otherwise(text),
                "done": F.lit(True),
                "eval_count": F.when(h % 83 != 0, k),
                "total_duration": F.when(h % 97 == 0, 0)
                .when(h % 89 == 0, None)
                .otherwise((200 + h % 4000) * 1_000_000),
                "judge_text": reply,
            }
        )
        .drop("k")
    )


def scored(spark: SparkSession, sf_dir: str, metrics: Sequence[str] = TESTED) -> DataFrame:
    rows = score_lexical(with_performance(answers(spark, sf_dir, normalized=True)), metrics)
    return rows.drop("normalized_gold_tokens").withColumn("judge_score", parse_judge_score(F.col("judge_text")))


def judge_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (model, question) read as one answer judged ten times."""
    return answers(spark, sf_dir).select(
        F.concat_ws("|", "model", "question_id").alias("response_idx"),
        "model",
        "question_id",
        F.col("run_index").alias("pass_index"),
        parse_judge_score(F.col("judge_text")).alias("judge_score"),
        "judge_text",
    )


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of eight stored vectors read as texts; consecutive texts form a pair. Groups stay at eight rows.

    The last text of an odd number has no partner and is matched with itself, so every vector is used.
    """
    vectors = table(spark, sf_dir, "embeddings").withColumn(
        "text_id", F.floor(F.col("vec_id") / VECTORS_PER_TEXT)
    )
    texts = vectors.groupBy("text_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]
        ).alias("vectors")
    )
    pair = F.floor(F.col("text_id") / 2).alias("pair_id")
    left = texts.filter(F.col("text_id") % 2 == 0).select(pair, F.col("vectors").alias("cand"))
    right = texts.filter(F.col("text_id") % 2 == 1).select(pair, F.col("vectors").alias("ref"))
    return left.join(right, "pair_id", "left").withColumn("ref", F.coalesce("ref", "cand"))


def digits(text: str) -> str:
    return hashlib.md5(text.encode("utf-8")).hexdigest()


def hash_encoder() -> Callable[[Sequence[str]], list[np.ndarray]]:
    """A stand-in for a pretrained encoder: eight md5 digits per space-separated token."""

    @lru_cache(TOKENS)
    def vector(token: str) -> bytes:
        return np.array([int(d, 16) - 7.5 for d in digits(token)[:8]]).tobytes()

    def encode(texts: Sequence[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join([vector(t) for t in text.split(" ") if t])).reshape(-1, 8) for text in texts]

    return encode


def hash_generate() -> Callable[..., dict]:
    """A repeatable model function: some leading words of the prompt."""

    def generate(model: str, prompt: str, seed: int | None, system: str | None) -> dict:
        h = int(digits(f"{model}|{seed}|{prompt}")[:8], 16)
        return {
            "response": " ".join(prompt.split(" ")[: 2 + h % 4]),
            "done": True,
            "total_duration": (200 + h % 4000) * 1_000_000,
            "eval_count": 2 + h % 4,
        }

    return generate


def hash_judge() -> Callable[[str], str]:
    """A repeatable judge: silent on some requests, a digit of the request's hash otherwise."""

    def judge(prompt: str) -> str:
        h = int(digits(prompt)[:8], 16)
        if h % 7 == 0:
            return " "
        return f"score=0.{h % 10} rationale=x" if h % 7 > 1 else "undecided"

    return judge
