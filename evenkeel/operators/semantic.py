"""Similarity between the repeated runs of a (model, question)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.functions.hashing import fingerprint, seeded_hash
from evenkeel.functions.text import with_policy
from evenkeel.functions.vectors import Encoder, match_run_pairs, match_stored
from evenkeel.operators.groups import first_k_by_hash, null_safe_join
from evenkeel.operators.repro import GROUP

MAX_PAIRS = 45
TASKS = 4  # tasks a core that groups are encoded in


def _pair_ranks(n: Column, budget: int, seed: int, *group: Column) -> Column:
    """``budget`` different pair ranks out of n(n-1)/2, or all of them if there are no more.

    Floyd's sampling: uniform over all subsets, no pair is listed that is not used.
    """
    total = F.try_divide(n * (n - 1), F.lit(2)).cast("bigint")

    def step(chosen: Column, t: Column) -> Column:
        last = total - budget + t
        draw = seeded_hash(seed, *group, t) % (last + 1)
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, draw), last).otherwise(draw)))

    sampled = F.aggregate(F.sequence(F.lit(0), F.lit(budget - 1)), F.array().cast("array<bigint>"), step)
    every = F.when(total > 0, F.sequence(F.lit(0).cast("bigint"), total - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.when(total > budget, sampled).otherwise(every)


def _unrank(rank: Column) -> Column:
    """Rank to index pair i < j, counting pairs by j; corrected for square-root rounding."""
    guess = F.floor((1 + F.sqrt(1 + 8 * rank.cast("double"))) / 2).cast("bigint")

    def below(j: Column) -> Column:
        return F.shiftright(j * (j - 1), 1)

    j = F.when(below(guess) > rank, guess - 1).when(below(guess + 1) <= rank, guess + 1).otherwise(guess)
    return F.struct((rank - below(j)).alias("i"), j.alias("j"))


def _grouped_runs(df: DataFrame, max_pairs: int, seed: int, missing_text: str | None) -> DataFrame:
    """One row per group: its run count, at most 2·max_pairs runs in run order, and the chosen index pairs.

    A budget of p pairs touches at most 2p runs, and which runs those are is exchangeable. So the runs are
    picked by seeded hash, which is pruned inside every map task: a group of any size sends at most 2p rows
    per task and ends as one bounded row. The pairs are drawn among all n(n-1)/2 index pairs and the touched
    indices are renumbered onto the picked runs, which keeps the sample uniform over all pairs.
    """
    if max_pairs < 1:
        raise ValueError("max_pairs must be at least 1")
    rows = df.dropna(subset=list(GROUP)).select(
        *GROUP, "run_index", with_policy(F.col("response_text"), missing_text).alias("text")
    )
    draw = seeded_hash(seed, *[F.col(k) for k in GROUP], F.col("run_index"))
    picked = first_k_by_hash(rows, GROUP, 2 * max_pairs, draw, ["run_index", "text"])
    runs = picked.groupBy(*GROUP).agg(
        F.sort_array(F.collect_list(F.struct(draw.alias("draw"), "run_index", "text"))).alias("runs")
    )
    sizes = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    index_pairs = F.transform("ranks", _unrank)
    touched = F.array_sort(F.array_distinct(F.flatten(F.transform("index_pairs", lambda p: F.array(p["i"], p["j"])))))

    def oriented(p: Column) -> Column:
        a, b = (F.array_position(F.col("touched"), p[s]) - 1 for s in ("i", "j"))
        first = F.get(F.col("runs"), a.cast("int"))
        second = F.get(F.col("runs"), b.cast("int"))
        swap = first["run_index"] > second["run_index"]
        return F.struct(
            F.when(swap, b).otherwise(a).cast("int").alias("i"),
            F.when(swap, a).otherwise(b).cast("int").alias("j"),
        )

    return (
        runs.join(sizes, list(GROUP))
        .withColumn("ranks", _pair_ranks(F.col("n"), max_pairs, seed, *[F.col(k) for k in GROUP]))
        .withColumn("index_pairs", index_pairs)
        .withColumn("touched", touched)
        .withColumn("pairs", F.transform("index_pairs", oriented))
        .select(*GROUP, "n", "runs", "pairs")
    )


def run_pairs(
    df: DataFrame, max_pairs: int = MAX_PAIRS, seed: int = 42, missing_text: str | None = None
) -> DataFrame:
    """Run pairs of each (model, question): all of them, or a seeded sample of ``max_pairs``.

    The outer explode keeps Spark from evaluating the pair list a second time in an inferred size filter.
    """
    pair = _grouped_runs(df, max_pairs, seed, missing_text).select(
        *GROUP, "runs", F.explode_outer("pairs").alias("p")
    ).filter(F.col("p").isNotNull())
    left, right = F.get("runs", F.col("p.i")), F.get("runs", F.col("p.j"))
    return pair.select(
        *GROUP,
        left["run_index"].alias("run_i"),
        right["run_index"].alias("run_j"),
        left["text"].alias("text_i"),
        right["text"].alias("text_j"),
    )


def semantic_repro(
    df: DataFrame,
    factory: Callable[[], Encoder],
    max_pairs: int = MAX_PAIRS,
    seed: int = 42,
    batch_size: int = 8,
    missing_text: str | None = None,
    store: DataFrame | None = None,
) -> DataFrame:
    """Mean, population std and count of pair F1 per (model, question).

    A group of one run stays, with nulls and 0; the std needs at least two pairs. With a ``store`` of vectors nothing is
    encoded: the distinct pairs of texts are matched from it.
    """
    if store is not None:
        pairs = run_pairs(df, max_pairs, seed, missing_text).select(
            *GROUP, fingerprint(F.col("text_i")).alias("cand"), fingerprint(F.col("text_j")).alias("ref")
        )
        matched = pairs.join(match_stored(pairs, store), ["cand", "ref"], "left")
        found = matched.groupBy(*GROUP).agg(
            F.avg("f1").alias("semantic_self_similarity_mean"),
            F.when(F.count("f1") > 1, F.stddev_pop("f1")).alias("semantic_self_similarity_std"),
            F.count("f1").alias("n_semantic_pairs"),
        )
        every = df.dropna(subset=list(GROUP)).select(*GROUP).distinct()
        return null_safe_join(every, found, GROUP, "left").na.fill(0, ["n_semantic_pairs"])
    # groups are small as bytes and dear to encode: adaptive execution would put very many of them into one task
    session = df.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), TASKS * session.sparkContext.defaultParallelism)
    scored = _grouped_runs(df, max_pairs, seed, missing_text).repartition(tasks, *GROUP).withColumn(
        "f1", F.filter(match_run_pairs(F.col("runs.text"), F.col("pairs"), factory, batch_size), lambda x: x.isNotNull())
    )
    count = F.size("f1")
    mean = F.try_divide(F.aggregate("f1", F.lit(0.0), lambda s, x: s + x), count)
    squares = F.aggregate("f1", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))
    return scored.withColumn("mean", mean).select(
        *GROUP,
        F.col("mean").alias("semantic_self_similarity_mean"),
        F.when(count > 1, F.sqrt(squares / count)).alias("semantic_self_similarity_std"),
        count.cast("bigint").alias("n_semantic_pairs"),
    )
