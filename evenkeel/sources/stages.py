"""Answer and stage tables on a shared file system.

A stage is a directory that counts as present only once Spark has committed it (``_SUCCESS``), so a job that
died half-way is written again instead of being taken for finished.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

RESPONSE_SCHEMA = (
    "timestamp_utc string, model string, provider string, question_id string, question string, "
    "gold_answer string, category string, run_index int, seed bigint, response_text string, done boolean, "
    "total_duration bigint, eval_count bigint, prompt_eval_count bigint, shared_instruction string"
)
SCORED_SCHEMA = RESPONSE_SCHEMA + (
    ", output_tokens double, latency_ms double, tokens_per_second double, normalized_response string, "
    "normalized_gold string, exact_match double, normalized_exact_match double, token_f1 double, "
    "string_similarity double, bleu double, rouge_l double, bertscore_precision double, "
    "bertscore_recall double, bertscore_f1 double, judge_score double, judge_rationale string, "
    "judge_error string"
)
RAW, SCORED, AGGREGATES = "raw_responses", "scored_responses", "aggregates"
SCHEMAS = {RAW: RESPONSE_SCHEMA, SCORED: SCORED_SCHEMA}
CSV_TEXT = {"quote": '"', "escape": '"', "header": True}
COMPRESSION = "gzip"  # of JSON lines and CSV: the answers to a question repeat its texts, side by side
FILE_ROWS = 50_000  # rows of one such file, which one task reads whole


def scratch_dir(spark: SparkSession) -> str:
    """A new directory under the cluster's shared ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local master only: the executors of a cluster would each
    write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return os.path.join(root, f"run-{os.urandom(6).hex()}")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch directory and read again: computed once, whatever is made from it."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job finished writing ``path``, on whatever file system it is."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV that keeps empty text apart from missing text, outer white space, quotes and line breaks.

    Files are compressed and bounded in rows, so what one task reads back does not follow the size of the table.
    """
    as_is = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "maxRecordsPerFile": FILE_ROWS}
    df.write.mode(mode).options(**CSV_TEXT, **as_is, emptyValue='""', compression=COMPRESSION).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with all fields, in files as those of :func:`write_csv`."""
    bounded = {"compression": COMPRESSION, "maxRecordsPerFile": FILE_ROWS}
    df.write.mode(mode).options(ignoreNullFields=False, **bounded).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    # a bare empty field is missing, a quoted one is empty text: told apart by a null mark no field can hold
    reader = spark.read.options(**CSV_TEXT, multiLine=True, emptyValue="", nullValue="\u0000")
    if schema is None:
        return reader.csv(path)
    titles = reader.csv(path).columns
    known = {part.split()[0]: part.split()[1] for part in schema.split(", ")}
    # optional columns: whatever the file has, in its order, with the fixed type where one is known
    return reader.schema(", ".join(f"`{t}` {known.get(t, 'double')}" for t in titles)).csv(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines checkpoint with the fixed schema; blank lines are skipped, an unreadable line is an error.

    The error names the file and the line when the rows are read, so a cut answer is never taken for a missing one.
    """
    broken = "_unreadable"
    schema = f"{RESPONSE_SCHEMA}, {broken} string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", broken).json(path)
    told = F.concat(F.lit("unreadable answer in "), F.col("_metadata.file_path"), F.lit(": "), F.left(broken, F.lit(200)))
    checked = rows.withColumn("model", F.when(F.col(broken).isNotNull(), F.raise_error(told).cast("string")).otherwise(F.col("model")))
    return checked.filter(F.col("model").isNotNull() | F.col("question_id").isNotNull()).drop(broken)


def write_responses(
    df: DataFrame, path: str, jsonl: bool = True, parquet: bool = True, csv: bool = True, mode: str = "overwrite"
) -> None:
    """The raw table in up to three formats below ``path``."""
    if jsonl:
        write_jsonl(df, f"{path}/{RAW}.jsonl", mode)
    if parquet:
        df.write.mode(mode).parquet(f"{path}/{RAW}.parquet")
    if csv:
        write_csv(df, f"{path}/{RAW}.csv", mode)


def stage_exists(spark: SparkSession, path: str, stage: str) -> bool:
    return any(committed(spark, f"{path}/{stage}.{kind}") for kind in ("parquet", "csv"))


def read_stage(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """A stage's parquet table, else its CSV, else an error that names the stage."""
    if committed(spark, f"{path}/{stage}.parquet"):
        return spark.read.parquet(f"{path}/{stage}.parquet")
    if committed(spark, f"{path}/{stage}.csv"):
        keys = "model string, question_id string"
        return read_csv(spark, f"{path}/{stage}.csv", SCHEMAS.get(stage, keys))
    raise FileNotFoundError(f"no {stage} found in {path}: run that stage first")


def write_stage(df: DataFrame, path: str, stage: str, resume: bool = False, csv: bool = False) -> bool:
    """Writes a stage unless ``resume`` is on and it is already committed; a skipped plan is never run.

    The CSV copy is made from the committed parquet table, so nothing is computed twice.
    """
    spark = df.sparkSession
    if resume and stage_exists(spark, path, stage):
        return False
    df.write.mode("overwrite").parquet(f"{path}/{stage}.parquet")
    if csv:
        write_csv(spark.read.parquet(f"{path}/{stage}.parquet"), f"{path}/{stage}.csv")
    return True


def write_scored(df: DataFrame, path: str, resume: bool = False) -> bool:
    return write_stage(df, path, SCORED, resume, csv=True)


def write_aggregates(df: DataFrame, path: str) -> None:
    write_csv(df, f"{path}/{AGGREGATES}.csv")


def write_judge_reliability(long: DataFrame, summary: DataFrame, path: str) -> None:
    """Both tables as CSV. Pass stored tables: ``long`` is read again for every table made from it."""
    write_csv(long, f"{path}/judge_reliability_scores.csv")
    write_csv(summary, f"{path}/judge_reliability_summary.csv")
