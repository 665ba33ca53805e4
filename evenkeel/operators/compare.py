"""How often two models give the same normalised answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from evenkeel.functions.hashing import fingerprint
from evenkeel.functions.text import with_policy
from evenkeel.operators.score import with_normalized

CELL = ("question_id", "run_index")


def pairwise_model_similarity(
    df: DataFrame, order_by: Sequence[str] = (), missing_text: str | None = None
) -> DataFrame:
    """``model_a, model_b, similarity`` for every ordered pair; 0.0 without overlap, 1.0 on the diagonal.

    A repeated cell counts once, by its first answer in ``order_by`` order. A cell is reduced to the set of
    models it has and the sets of models that agree; equal sets are counted before any pair is formed, so the
    number of pairs depends on how many different sets exist, not on the number of answers.
    """
    given = "normalized_response" in df.columns
    text = F.col("normalized_response") if given else with_policy(F.col("response_text"), missing_text)
    rows = with_normalized(df.dropna(subset=["model", *CELL]).filter(text.isNotNull()), missing_text).select(
        "model", *CELL, *order_by, fingerprint(F.col("normalized_response")).alias("print")
    )
    first = Window.partitionBy(*CELL, "model").orderBy(*order_by, "print")
    answers = rows.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") == 1)
    cells = answers.groupBy(*CELL).agg(
        F.sort_array(F.collect_list(F.struct("model", "print"))).alias("cell")
    )
    agreeing = F.transform(
        F.array_distinct("cell.print"),
        lambda p: F.struct(
            F.lit(True).alias("equal"),
            F.transform(F.filter("cell", lambda x: x["print"] == p), lambda x: x["model"]).alias("models"),
        ),
    )
    everyone = F.array(F.struct(F.lit(False).alias("equal"), F.col("cell.model").alias("models")))
    sets = (
        cells.select(F.explode_outer(F.concat(everyone, agreeing)).alias("s"))
        .filter(~F.col("s.equal") | (F.size("s.models") > 1))
        .groupBy("s.equal", "s.models")
        .agg(F.count(F.lit(1)).alias("cells"))
    )
    one_way = F.flatten(
        F.transform(
            "models",
            lambda a: F.transform(
                F.filter("models", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    counted = (
        sets.withColumn("pair", F.explode(one_way))
        .groupBy("pair.a", "pair.b")
        .agg(
            F.sum(F.when(F.col("equal"), F.col("cells")).otherwise(0)).alias("same"),
            F.sum(F.when(~F.col("equal"), F.col("cells")).otherwise(0)).alias("both"),
        )
        .withColumn("rate", F.try_divide(F.col("same").cast("double"), F.col("both")))
    )
    both_ways = counted.select(
        F.explode(
            F.array(
                F.struct("a", "b", "rate"),
                F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "rate"),
            )
        ).alias("p")
    ).select("p.*")
    # the model list is read off the same counted sets, kept identical so that Spark reuses their exchange
    models = (
        sets.select(F.explode_outer("models").alias("model"), "cells")
        .groupBy()
        .agg(F.sort_array(F.collect_set("model")).alias("models"), F.sum("cells").alias("cells"))
        .filter(F.col("cells") > 0)
    )
    every_pair = models.select(F.explode("models").alias("a"), "models").select(
        "a", F.explode("models").alias("b")
    )
    return every_pair.join(both_ways, ["a", "b"], "left").select(
        F.col("a").alias("model_a"),
        F.col("b").alias("model_b"),
        F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("rate", F.lit(0.0))).alias("similarity"),
    )


def similarity_matrix(pairs: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """The pair table as a model × model matrix; give ``models`` to fix the columns without a look-up job."""
    grouped = pairs.groupBy(F.col("model_a").alias("model"))
    return grouped.pivot("model_b", list(models) if models else None).agg(F.first("similarity"))
