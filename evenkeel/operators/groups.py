"""Skew-safe helpers shared by the operators: hot groups, exact quantiles, first-k-by-hash."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenkeel.sources.stages import kept

IN_MEMORY_ROWS = 1_000_000  # rows of one group that one task may hold for an exact quantile
SMALL_TABLE_ROWS = 10_000  # rows of a key table that may become a local (hence broadcastable) relation
GROUP_LIMIT = 1_000  # largest k for which Spark prunes row_number() <= k before the shuffle
SKETCH_ACCURACY = 50_000
SKETCH_MARGIN = 10 / SKETCH_ACCURACY  # ten times the sketch's guaranteed rank error
WIDER = 16  # factor by which a bracket that missed its rank is widened
RANGES = 64  # value ranges that share out the ranking of one group


def all_equal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on every key; still an equi-join for Spark."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def pin_small(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> DataFrame:
    """A local relation when ``df`` has at most ``limit`` rows, else ``df`` unchanged.

    A local relation has a known size, so Spark broadcasts it under its own threshold; a larger table
    stays distributed and is joined by shuffle.
    """
    rows = df.limit(limit + 1).toArrow()
    return df if rows.num_rows > limit else df.sparkSession.createDataFrame(rows, df.schema)


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int = IN_MEMORY_ROWS) -> DataFrame | None:
    """Keys of the groups with more than ``limit`` rows, or None if there is none.

    One map-side combined count over the key columns; at most rows/limit groups can qualify.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    hot = pin_small(sizes.filter(F.col("group_rows") > limit).select(*keys, "group_rows"))
    return None if hot.isEmpty() else hot.drop("group_rows")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null equal to null; the keys are those of ``left``, from which ``right`` may be made."""
    names = {k: f"_right_{k}" for k in keys}
    other = right.select(*[F.col(k).alias(names[k]) for k in keys], *[c for c in right.columns if c not in names])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[names[k]]) for k in keys], F.lit(True))
    return left.join(other, on, how).drop(*names.values())


def first_ranks(counted: DataFrame, keys: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """``counted(keys, value, copies)``, a row per value, with ``first``: how many copies of the group lie below it.

    A sketch cuts the values of a group into ``ranges`` of about equally many. Copies are summed inside a range, and
    the ranges' totals are carried from range to range, so one group is ranked by many tasks.
    """
    probs = [i / ranges for i in range(1, ranges)]
    cuts = counted.groupBy(*keys).agg(F.percentile_approx("value", probs, 100 * ranges).alias("cuts"))
    placed = null_safe_join(counted, cuts, keys).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    own = [*keys, "range"]
    inside = placed.withColumn("upto", F.sum("copies").over(Window.partitionBy(*own).orderBy("value")))
    totals = placed.groupBy(*own).agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*own, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("below"))
    return null_safe_join(inside, carried, own).select(
        *keys, "value", "copies", (F.col("below") + F.col("upto") - F.col("copies")).alias("first")
    )


def _bracketed(
    long: DataFrame, wanted: Sequence[str], probs: Sequence[float], margin: float, asked: DataFrame | None
) -> DataFrame:
    """``wanted, quantile, rank, lower, upper``: the values around each rank, null where the bracket missed it."""
    sides = [min(1.0, max(0.0, p + side * margin)) for p in probs for side in (-1, 1)]
    sketch = long.groupBy(*wanted).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("value", sides, SKETCH_ACCURACY).alias("bounds")
    )
    exhaustive = F.col("n") * margin < 2

    def bracket(i: int, p: float) -> Column:
        low, high = F.get("bounds", F.lit(2 * i)), F.get("bounds", F.lit(2 * i + 1))
        return F.struct(
            F.lit(float(p)).alias("quantile"),
            F.when(exhaustive | F.lit(p <= margin), float("-inf")).otherwise(low).alias("low"),
            F.when(exhaustive | F.lit(p >= 1 - margin), float("nan")).otherwise(high).alias("high"),  # above all numbers
        )

    cells = [*wanted, "quantile"]
    made = F.explode(F.array(*[bracket(i, p) for i, p in enumerate(probs)])).alias("b")
    brackets = sketch.select(*wanted, "n", made).select(*wanted, "n", "b.*")
    if asked is not None:
        brackets = null_safe_join(brackets, asked, cells, "left_semi")
    brackets = pin_small(brackets.withColumn("rank", (F.col("n") - 1) * F.col("quantile")))
    # value is null for "below the bracket": one row per map task and group after partial aggregation
    hit = null_safe_join(long, brackets, wanted).filter(F.col("value") <= F.col("high"))
    counted = (
        hit.select(*cells, "rank", F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value"))
        .groupBy(*cells, "rank", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    below = counted.filter("value IS NULL").select(*cells, F.col("copies").alias("under"))
    ranked = first_ranks(counted.filter("value IS NOT NULL"), [*cells, "rank"])
    ranked = null_safe_join(ranked, below, cells, "left").withColumn("first", F.col("first") + F.coalesce("under", F.lit(0)))

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("first") <= position) & (F.col("first") + F.col("copies") > position), F.col("value")))

    picked = ranked.groupBy(*cells).agg(
        at(F.floor("rank")).alias("lower"), at(F.ceil("rank")).alias("upper")
    )
    return null_safe_join(brackets.select(*cells, "rank"), picked, cells, "left")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], margin: float | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles of groups of any size, in long form.

    Returns ``keys, metric, quantile, value``. A mergeable sketch gives a bracket that should hold the wanted
    ranks; a second pass counts what lies below it and keeps, pre-aggregated by value, only what lies inside
    (about 0.04% of a group), ranked range by range. A bracket that missed is made wider, for its group alone, until
    it holds the rank; at the widest it holds the whole group. A group so small that the bracket would be narrower
    than two ranks is ranked as it is. Missing values are left out; NaN counts as the largest number.
    """
    long = kept(
        df.select(
            *keys,
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
            ).alias("cell"),
        ).select(*keys, "cell.metric", "cell.value").filter(F.col("value").isNotNull())
    )
    wanted = [*keys, "metric"]
    margin, asked, found = margin or SKETCH_MARGIN, None, []
    while True:
        rows = long if asked is None else null_safe_join(long, pin_small(asked.select(*wanted).distinct()), wanted, "left_semi")
        picked = kept(_bracketed(rows, wanted, probs, margin, asked))
        inside = F.col("lower").isNotNull() & F.col("upper").isNotNull()
        found.append(picked.filter(inside))
        asked = picked.filter(~inside).select(*wanted, "quantile")
        if asked.isEmpty():
            break
        margin *= WIDER
    whole = reduce(DataFrame.union, found)
    between = F.col("lower") + (F.col("rank") - F.floor("rank")) * (F.col("upper") - F.col("lower"))
    value = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(between)
    return whole.select(*wanted, "quantile", value.alias("value"))


def quantiles_wide(
    df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]
) -> DataFrame:
    """Exact quantiles as columns: ``wanted`` maps an output name to (column, probability)."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    probs = list(dict.fromkeys(float(p) for _, p in wanted.values()))
    cells = exact_quantiles(df, keys, columns, probs)
    return cells.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("metric") == c) & (F.col("quantile") == float(p)), F.col("value"))).alias(name)
            for name, (c, p) in wanted.items()
        ]
    )


def aggregate_with_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    wanted: dict[str, tuple[str, float]],
    in_memory_rows: int = IN_MEMORY_ROWS,
    values: DataFrame | None = None,
) -> DataFrame:
    """``groupBy(keys).agg(aggregates)`` plus exact quantiles, whatever the group sizes.

    Groups of at most ``in_memory_rows`` use the built-in ``percentile`` in the same aggregation. Only if
    larger ones exist are they told apart and ranked by :func:`exact_quantiles`. ``values`` holds the rows that
    carry the quantile columns when ``df`` has others stacked on them.
    """
    values = df if values is None else values
    hot = hot_groups(values, keys, in_memory_rows)
    if hot is None:
        return df.groupBy(*keys).agg(*aggregates, *[F.percentile(c, p).alias(o) for o, (c, p) in wanted.items()])
    if not keys:  # one row on either side
        return df.groupBy().agg(*aggregates).join(quantiles_wide(values, keys, wanted))
    marked = hot.withColumn("is_hot", F.lit(True))
    flagged = df.join(marked, all_equal(df, marked, keys), "left").select(df["*"], "is_hot")
    base = flagged.groupBy(*keys).agg(
        *aggregates,
        *[
            F.percentile(F.when(F.col("is_hot").isNull(), F.col(c)), p).alias(o)
            for o, (c, p) in wanted.items()
        ],
    )
    hot_values = values.join(hot, all_equal(values, hot, keys), "left_semi")
    large = quantiles_wide(hot_values, keys, wanted)
    return base.join(large, all_equal(base, large, keys), "left").select(
        *[base[c] for c in base.columns if c not in wanted],
        *[F.coalesce(base[o], large[o]).alias(o) for o in wanted],
    )


def first_k_by_hash(
    df: DataFrame, keys: Sequence[str], k: int, draw: Column, tiebreak: Sequence[str]
) -> DataFrame:
    """The ``k`` rows with the smallest (draw, tiebreak) in every group of ``keys`` (or overall).

    Small k: ``row_number() <= k``, which Spark prunes in every map task before the shuffle. Large k: 4,096
    buckets of the 32-bit draw are counted, whole buckets below the cut are kept without ordering, and only
    the one bucket on the cut is ranked. Either way a hot group is never gathered in one task.
    """
    drawn = df.withColumn("draw", draw)
    if k <= GROUP_LIMIT:
        if not keys:
            return drawn.orderBy("draw", *tiebreak).limit(k).drop("draw")
        order = Window.partitionBy(*keys).orderBy("draw", *tiebreak)
        return drawn.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).drop("rn", "draw")
    bucketed = drawn.withColumn("bucket", F.shiftright("draw", 20))
    sizes = bucketed.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy(*keys).orderBy("bucket")
    cut = pin_small(
        sizes.withColumn("before", F.sum("rows").over(upto) - F.col("rows")).filter(F.col("before") < k)
    )
    kept = bucketed.join(cut, all_equal(bucketed, cut, [*keys, "bucket"])).select(
        bucketed["*"], cut["rows"], cut["before"]
    )
    whole = kept.filter(F.col("before") + F.col("rows") <= k)
    in_bucket = Window.partitionBy(*keys, "bucket").orderBy("draw", *tiebreak)
    partial = (
        kept.filter(F.col("before") + F.col("rows") > k)
        .withColumn("rn", F.row_number().over(in_bucket))
        .filter(F.col("rn") <= k - F.col("before"))
        .drop("rn")
    )
    return whole.unionByName(partial).drop("bucket", "rows", "before", "draw")
