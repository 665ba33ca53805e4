"""Question sources, sampling and the sampled-set export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evenkeel.functions.hashing import seeded_hash
from evenkeel.functions.text import strip, with_policy
from evenkeel.operators.groups import first_k_by_hash, pin_small

# Accepted column titles, best first, compared in lower case.
QUESTION_TITLES = ("question", "questions", "consumer question")
ANSWER_TITLES = ("answer", "answers", "trusted answer", "response")
FOCUS_TITLES = ("focus", "focus (drug)", "drug", "focus_area")
TYPE_TITLES = ("question type", "qtype", "category")

REQUIRED = ("id", "question", "gold_answer")
OPTIONAL = ("gold_keywords", "category", "notes")


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A delimited file with header, quoted line breaks and doubled quotes, every column a string."""
    return spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', inferSchema=False)


def with_ordinal(files: DataFrame, name: str = "ordinal") -> DataFrame:
    """1-based row number in file order (path, then position) of a DataFrame read from files.

    Each file block is read by one task in order, so a row's place is its offset in the block plus the rows of
    the blocks before. Only the block table (one row per block) is ordered in one task; rows are never
    gathered or sorted, and up to 10,000 blocks they are not shuffled either.
    """
    block = ["_path", "_start"]
    placed = files.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    blocks = placed.groupBy(*block).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    joined = placed.join(pin_small(offsets), block)
    return joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop(
        *block, "_at", "_first", "_rows", "_before"
    )


def read_gold_csv(
    spark: SparkSession, path: str, missing_text: str | None = None, keep_ordinal: bool = False
) -> DataFrame:
    """Questions ``id, question, gold_answer, category`` with ids q1, q2, … in file order."""
    raw = read_table(spark, path)
    missing = [c for c in ("question", "answer") if c not in raw.columns]
    if missing:
        raise ValueError(f"gold CSV lacks required columns {missing}")
    return with_ordinal(raw).select(
        F.concat(F.lit("q"), "ordinal").alias("id"),
        with_policy(F.col("question"), missing_text).alias("question"),
        with_policy(F.col("answer"), missing_text).alias("gold_answer"),
        F.lit("").alias("category"),
        *(["ordinal"] if keep_ordinal else []),
    )


def read_gold_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Questions from a pipe table: first pipe line is the header, the second is skipped.

    ``path`` may also be a directory of part files, of which the first one starts with the header.
    Malformed rows, missing columns and duplicate ids are errors; each check is one counting job.
    """
    files = spark.read.text(path)
    lines = files.select(
        strip(F.col("value")).alias("line"),
        F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    table = lines.filter(F.col("line").startswith("|") & F.col("line").endswith("|"))
    head = table.orderBy("path", "start", "at").limit(2).collect()
    if len(head) < 2:
        raise ValueError("no pipe table found: a header and a separator line are required")
    titles = [t.strip() for t in head[0]["line"].strip("|").split("|")]
    absent = [c for c in REQUIRED if c not in titles]
    if absent:
        raise ValueError(f"pipe table lacks required columns {absent}")
    cells = F.split(F.regexp_replace("line", r"\A\|+|\|+\z", ""), r"\|", -1)
    body = table.filter(~F.col("at").isin([r["at"] for r in head]))
    rows = body.withColumn("cells", F.transform(cells, strip))
    bad = rows.filter(F.size("cells") != len(titles)).agg(F.count(F.lit(1)), F.min("line")).first()
    if bad[0]:
        raise ValueError(f"malformed rows: {bad[0]}, one of them {bad[1]!r}")
    keep = [*REQUIRED, *[c for c in OPTIONAL if c in titles]]
    out = rows.select(*[F.get("cells", titles.index(c)).alias(c) for c in keep])
    twice = out.groupBy("id").count().filter("count > 1").agg(F.count(F.lit(1)), F.min("id")).first()
    if twice[0]:
        raise ValueError(f"duplicate question ids: {twice[0]}, the first of them {twice[1]!r}")
    return out


def _find(columns: Sequence[str], titles: Sequence[str]) -> str | None:
    """The column whose title stands first in ``titles``; of columns with the same title the last."""
    best, found = len(titles), None
    for column in columns:
        title = column.strip().lower()
        rank = titles.index(title) if title in titles else len(titles)
        if rank < len(titles) and rank <= best:
            best, found = rank, column
    return found


def usable(question: Column, answer: Column) -> Column:
    """True for a row with both texts; blank counts as missing."""
    return (F.coalesce(question, F.lit("")) != "") & (F.coalesce(answer, F.lit("")) != "")


def normalize_qa_source(
    df: DataFrame,
    question_col: str | None = None,
    answer_col: str | None = None,
    source: str = "MedicationQA",
) -> DataFrame:
    """``question, answer, source, focus_area`` from a table whose titles vary; blank rows are dropped."""

    def text(name: str) -> Column:
        return F.col(f"`{name}`").cast("string")

    question = question_col or _find(df.columns, QUESTION_TITLES)
    answer = answer_col or _find(df.columns, ANSWER_TITLES)
    if question is None or answer is None:
        raise ValueError(f"no question/answer columns among {df.columns}; pass question_col and answer_col")
    focus, kind = _find(df.columns, FOCUS_TITLES), _find(df.columns, TYPE_TITLES)
    area = text(focus) if focus else F.lit("")
    if kind:
        area = F.concat(F.coalesce(area, F.lit("")), F.lit(" | "), F.coalesce(text(kind), F.lit("")))
    return df.select(
        strip(text(question)).alias("question"),
        strip(text(answer)).alias("answer"),
        F.lit(source).alias("source"),
        area.alias("focus_area"),
    ).filter(usable(F.col("question"), F.col("answer")))


def head_sample(questions: DataFrame, n: int, order_by: str | Column | None = None) -> DataFrame:
    """The first n questions in file order; by default the number in the id gives that order."""
    if n <= 0:
        raise ValueError("sample size must be positive")
    order = F.regexp_extract("id", r"(\d+)\z", 1).try_cast("bigint") if order_by is None else order_by
    return questions.orderBy(order, "id").limit(n)


def random_sample(questions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n questions without replacement (all, if there are fewer), chosen by a seeded hash of the id."""
    if n <= 0:
        raise ValueError("sample size must be positive")
    rest = [c for c in questions.columns if c == "question"]
    return first_k_by_hash(questions, [], n, seeded_hash(seed, F.col("id")), ["id", *rest])


def sample_questions(
    questions: DataFrame, head: int | None = None, random: int | None = None, seed: int = 42
) -> DataFrame:
    """At most one kind of sampling."""
    if head is not None and random is not None:
        raise ValueError("use head or random sampling, not both")
    if head is not None:
        return head_sample(questions, head)
    return questions if random is None else random_sample(questions, random, seed)


def export_sample(questions: DataFrame, n: int, seed: int, path: str) -> DataFrame:
    """Writes exactly the question set that a run with the same n and seed uses."""
    from evenkeel.sources.stages import write_csv

    sampled = random_sample(questions, n, seed)
    write_csv(sampled, path)
    return sampled
