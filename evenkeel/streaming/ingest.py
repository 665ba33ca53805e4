"""Answer files as they land: one row per key, replays ignored, progress per model.

No stream keeps the keys it has seen in memory. They are a table, one directory per batch below it, and a batch is
anti-joined with the directories of earlier batches. A batch that is run again overwrites its own directory, so a crash
at any point changes nothing; readers take committed directories only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from evenkeel.operators.grid import KEY
from evenkeel.sources.stages import RESPONSE_SCHEMA, committed

BUCKETS = 16  # hash buckets of the keys in a batch's directory
RUN_BLOCK = 64  # runs of a question that are moved together, so that its repeated texts lie side by side
SNAPSHOTS = 8  # progress tables kept for readers that still use them


def landed_responses(spark: SparkSession, landing: str, files_per_trigger: int | None = None) -> DataFrame:
    """The stream of landed answers with a whole key, replays included."""
    reader = spark.readStream.schema(RESPONSE_SCHEMA)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(landing).dropna(subset=list(KEY))


def _directories(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Committed directories ``<prefix><number>`` below ``path``, by number."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    names = [status.getPath().getName() for status in files.listStatus(root)]
    numbers = sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))
    return {n: f"{path}/{prefix}{n}" for n in numbers if committed(spark, f"{path}/{prefix}{n}")}


def _one_per_key(batch: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the earliest answer of every key.

    Where nothing but keys is wanted, nothing but keys is moved. Whole answers are moved once, with the runs of a
    question together, so that its repeated texts take about one copy of the shuffle's files.
    """
    if set(columns) <= set(KEY):
        return batch.select(*KEY).distinct().select(*columns)
    near = ["question_id", "run_block"]
    tiebreak = [F.col(c).asc_nulls_last() for c in ("timestamp_utc", "response_text")]
    order = Window.partitionBy(*near, "model", "run_index").orderBy(*tiebreak)
    spread = batch.withColumn("run_block", F.floor(F.col("run_index") / RUN_BLOCK)).repartition(*near)
    return spread.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select(*columns)


def _new_keys(batch: DataFrame, number: int, path: str, columns: list[str], buckets: int) -> DataFrame:
    """Commits the rows of ``batch`` whose key no earlier batch had, one per key, and returns them.

    The earliest answer of a key stands. Only the hash buckets that the batch touches are read of earlier batches, and
    of those only the keys.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("key_bucket")
    rows = _one_per_key(batch, columns).select(*columns, bucket)
    earlier = [p for n, p in _directories(spark, path, "batch_id=").items() if n < number]
    if earlier:
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        seen = spark.read.option("basePath", path).parquet(*earlier).filter(F.col("key_bucket").isin(touched))
        rows = rows.join(seen.select(*KEY), list(KEY), "left_anti")
    own = f"{path}/batch_id={number}"
    rows.write.mode("overwrite").partitionBy("key_bucket").parquet(own)
    return spark.read.schema(rows.schema).parquet(own).select(*columns)


def _started(
    rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool, interval: str
) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def stream_responses(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    once: bool = True,
    interval: str = "1 minute",
    files_per_trigger: int | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Appends landed answers, one per key, to the table that :func:`read_landed` reads; ``once`` drains and stops."""
    rows = landed_responses(spark, landing, files_per_trigger)

    def append(batch: DataFrame, number: int) -> None:
        _new_keys(batch, number, out, rows.columns, buckets)

    return _started(rows, append, checkpoint, once, interval)


def read_landed(spark: SparkSession, out: str) -> DataFrame:
    """The answers of all committed batches; empty before the first."""
    paths = list(_directories(spark, out, "batch_id=").values())
    if not paths:
        return spark.createDataFrame([], RESPONSE_SCHEMA)
    names = [part.split()[0] for part in RESPONSE_SCHEMA.split(", ")]
    shape = f"{RESPONSE_SCHEMA}, batch_id long, key_bucket int"
    return spark.read.option("basePath", out).schema(shape).parquet(*paths).select(*names)


def stream_unreadable(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    once: bool = True,
    interval: str = "1 minute",
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Appends every landed line that is no answer to a table ``path, line``: unparsed text, or a key that is missing.

    Runs beside :func:`stream_responses` with a checkpoint of its own. Blank lines are skipped.
    """
    broken = "_unreadable"
    reader = spark.readStream.schema(f"{RESPONSE_SCHEMA}, {broken} string").option("columnNameOfCorruptRecord", broken)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in KEY])
    rows = reader.json(landing)
    whole = F.to_json(F.struct(*[c for c in rows.columns if c != broken]))
    lost = rows.filter(F.col(broken).isNotNull() | no_key).select(
        F.col("_metadata.file_path").alias("path"), F.coalesce(broken, whole).alias("line")
    )
    writer = lost.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def stream_progress(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    once: bool = True,
    interval: str = "1 minute",
    files_per_trigger: int | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Answers per model so far: a new small table after every batch, read by :func:`read_progress`.

    A batch's table is the last one before it plus the keys that the batch brought. It is a directory of its own, and
    its commit mark points readers to it, so they find a whole table at any time; the last few are kept.
    """
    rows = landed_responses(spark, landing, files_per_trigger)

    def publish(batch: DataFrame, number: int) -> None:
        known = _directories(spark, out, "snapshot-")
        if number in known:  # run again after its commit
            return
        new = _new_keys(batch, number, f"{out}/keys", list(KEY), buckets)
        counts = new.groupBy("model").agg(F.count(F.lit(1)).alias("completed_calls"))
        if known:
            counts = counts.union(spark.read.parquet(known[max(known)]))
        total = counts.groupBy("model").agg(F.sum("completed_calls").alias("completed_calls"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{out}/snapshot-{number}")
        for old in sorted(known)[: -SNAPSHOTS + 1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(known[old])
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return _started(rows, publish, checkpoint, once, interval)


def read_progress(spark: SparkSession, out: str) -> DataFrame:
    """``model, completed_calls`` of the last committed batch; empty before the first."""
    known = _directories(spark, out, "snapshot-")
    return spark.read.parquet(known[max(known)]) if known else spark.createDataFrame([], "model string, completed_calls long")
