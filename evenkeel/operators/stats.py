"""Model-level means and bootstrap intervals over questions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenkeel.functions.hashing import number, numbered_hashes
from evenkeel.operators.groups import first_ranks, null_safe_join
from evenkeel.operators.score import present
from evenkeel.sources.stages import kept

DRAWS = 1 << 14  # draws that are made together
PART_RANKS = 1 << 22  # ranks of a model that a task holds, as one number a column


def model_means(aggregates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Questions per model and the mean of each per-question column, missing values skipped."""
    cols = present(aggregates, columns)
    return (
        aggregates.filter(F.col("model").isNotNull())
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("n_questions"),
            *[F.avg(number(F.col(c))).alias(f"{c}_mean") for c in cols],
        )
    )


def _values(aggregates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``model`` and the numeric columns, stored: what they are made of is computed once."""
    cols = present(aggregates, columns)
    rows = aggregates.filter(F.col("model").isNotNull())
    return kept(rows.select("model", *[number(F.col(c)).alias(c) for c in cols]))


def _rank_runs(values: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``model, metric, n, value, first, copies``: a value of a column holds the ranks first to first + copies - 1."""
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in cols])).alias("cell")
    long = values.select("model", cell).select("model", "cell.*").filter(F.col("value").isNotNull())
    counted = long.groupBy("model", "metric", "value").agg(F.count(F.lit(1)).alias("copies"))
    sizes = counted.groupBy("model", "metric").agg(F.sum("copies").alias("n"))
    ranked = first_ranks(counted, ["model", "metric"]).select("model", "metric", "value", "first", "copies")
    joined = null_safe_join(ranked, sizes, ["model", "metric"])
    return kept(joined.select("model", "metric", "n", "value", "first", "copies"))


def _drawn(n_boot: int, seed: int, groups: int, part_ranks: int):
    """Sums of draws for every (model, part, group) of rows that come in that order."""

    def sums(model: str, part: int, group: int, rows: dict[str, tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
        low, held = part * part_ranks, []
        for metric, (n, pieces) in rows.items():
            value, first, copies = np.concatenate(pieces, axis=1)
            inside = np.minimum(first + copies, low + part_ranks) - np.maximum(first, low)
            held.append((metric, n, np.repeat(value, inside.astype(np.int64))))
        most = max(n for _, n, _ in held)
        made = []
        for replicate in range(group, n_boot, groups):
            totals = [0.0] * len(held)
            for start in range(0, most, DRAWS):
                picks = numbered_hashes(f"{seed}|{model}|{replicate}", start, min(most, start + DRAWS))
                last = None
                for i, (_, n, dense) in enumerate(held):
                    if n <= start:
                        continue
                    if n != last:
                        rank, last = picks[: n - start] % n - low, n
                        rank = rank if len(dense) == n else rank[(rank >= 0) & (rank < part_ranks)]
                    if len(rank):
                        totals[i] += float(np.cumsum(dense[rank])[-1])  # draw by draw, as an average in SQL adds them up
            made += [(model, replicate, metric, n, total) for (metric, n, _), total in zip(held, totals)]
        columns = zip(*made)
        kinds = pa.string(), pa.int32(), pa.string(), pa.int64(), pa.float64()
        names = ["model", "replicate", "metric", "n", "total"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        for batch in batches:
            own = [batch.column(k).to_pylist() for k in ("model", "part", "group", "metric", "n")]
            numbers = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("value", "first", "copies")])
            ends = [i for i in range(1, batch.num_rows + 1) if i == batch.num_rows or any(c[i] != c[i - 1] for c in own)]
            at = 0
            for end in ends:
                *now, metric, n = (c[at] for c in own)
                if now != key:
                    if rows:
                        yield sums(*key, rows)
                    key, rows = now, {}
                rows.setdefault(metric, (n, []))[1].append(numbers[:, at:end])
                at = end
        if rows:
            yield sums(*key, rows)

    return run


def _replicates_by_draw(
    values: DataFrame, cols: Sequence[str], n_boot: int, seed: int, part_ranks: int = PART_RANKS
) -> DataFrame:
    """Mean of n draws with replacement per (model, replicate); draw i picks a rank by md5 of its coordinates.

    A task takes some replicates of a model and its values by rank, a run of equal values as one row, and makes the
    draws where the values are: neither draws nor ranks are shuffled. A model of more than ``part_ranks`` values is cut
    into parts; the task of a part adds up those draws that fall into it, so memory is bounded at any size.
    """
    runs = _rank_runs(values, cols)
    last = F.col("first") + F.col("copies") - 1
    part = F.explode(F.sequence(*[F.floor(end / part_ranks).cast("int") for end in (F.col("first"), last)])).alias("part")
    parts = runs.select("model", part, "metric", "n", "value", "first", "copies")
    places = parts.select("model", "part").distinct().count()
    groups = min(n_boot, -(-4 * values.sparkSession.sparkContext.defaultParallelism // max(1, places)))
    group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    keys = ["model", "part", "group"]
    dealt = parts.select("*", group).repartition(max(1, places * groups), *keys).sortWithinPartitions(*keys, "metric", "first")
    shape = "model string, replicate int, metric string, n long, total double"
    drawn = dealt.mapInArrow(_drawn(n_boot, seed, groups, part_ranks), shape)
    sums = [(F.when(F.col("metric") == c, F.col("total")), F.when(F.col("metric") == c, F.col("n"))) for c in cols]
    return drawn.groupBy("model", "replicate").agg(*[(F.sum(t) / F.max(n)).alias(c) for c, (t, n) in zip(cols, sums)])


def bootstrap_ci(
    aggregates: DataFrame,
    columns: Sequence[str],
    n_boot: int = 1000,
    ci: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Percentile bootstrap interval of the mean per model, resampling questions.

    No value gives null, one value gives (v, v). The same draws are made at every size; a task holds at
    most a bounded number of a model's values.
    """
    return _intervals(_values(aggregates, columns), present(aggregates, columns), n_boot, ci, seed)


def _intervals(values: DataFrame, cols: Sequence[str], n_boot: int, ci: float, seed: int) -> DataFrame:
    if n_boot < 1 or not 0 < ci < 1:
        raise ValueError("n_boot must be at least 1 and ci inside (0, 1)")
    replicates = _replicates_by_draw(values, cols, n_boot, seed)
    bounds = [(1 - ci) / 2, (1 + ci) / 2]
    known = values.select("model").distinct()
    intervals = known.join(replicates, "model", "left").groupBy("model").agg(*[F.percentile(c, bounds).alias(c) for c in cols])
    return intervals.select(
        "model",
        *[
            F.get(c, i).alias(f"{c}_ci_{side}")
            for c in cols
            for i, side in enumerate(("low", "high"))
        ],
    )


def model_summary(
    aggregates: DataFrame,
    columns: Sequence[str],
    n_boot: int = 1000,
    ci: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """One row per model: ``n_questions`` and mean, low, high of every column present."""
    cols = present(aggregates, columns)
    values = _values(aggregates, cols)
    joined = model_means(values, cols).join(_intervals(values, cols, n_boot, ci, seed), "model", "left")
    return joined.select(
        "model", "n_questions", *[f"{c}_{part}" for c in cols for part in ("mean", "ci_low", "ci_high")]
    )
