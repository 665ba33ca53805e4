import re
import sys

from pyspark.sql import functions as F

from evenkeel.functions import text


def plain_normalize(value):
    value = " ".join(value.lower().split())
    return re.sub(r"[^a-z0-9 ]", "", value)


CASES = [
    " Hello, WORLD!!  Celiac-disease\t\n",
    "",
    "?!.",
    " ",
    "a - b",
    "- a",
    "İstanbul K µ é​x",
    "a\x1cb\x1dc\x1ed\x1fe",
    "one two　three\x85four",
]


def test_normalize_cases(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "t string")
    got = [r[0] for r in df.select(text.normalize(F.col("t"))).collect()]
    assert got == [plain_normalize(c) for c in CASES]
    assert got[0] == "hello world celiacdisease"
    assert got[4] == "a  b" and got[5] == " a"


def test_normalize_every_code_point(spark):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    step = 256
    rows = [("".join(f"a{chr(c)}b" for c in points[i : i + step]),) for i in range(0, len(points), step)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", text.normalize(F.col("t")).alias("n")).collect()
    assert not [r.t[:9] for r in got if r.n != plain_normalize(r.t)]


def test_missing_text_policy(spark):
    df = spark.createDataFrame([(None,), ("A",)], "t string")
    kept = [r[0] for r in df.select(text.normalize(text.with_policy(F.col("t")))).collect()]
    named = [r[0] for r in df.select(text.normalize(text.with_policy(F.col("t"), "nan"))).collect()]
    assert kept == [None, "a"] and named == ["nan", "a"]


def test_judge_replies(spark):
    expected = {
        '{"score": .8}': None,
        "1.5": 1.0,
        "score=-1": 1.0,
        "score=5/10": 1.0,
        "10 mg": None,
        "": None,
        "Score = 0.75 rationale=ok": 0.75,
        "score=.4": 0.4,
        '{"score": 0.6, "rationale": "1"}': 0.6,
        "SCORE=0": 0.0,
        "no number": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in expected], "t string")
    got = {r.t: r.s for r in df.select("t", text.parse_judge_score(F.col("t")).alias("s")).collect()}
    assert got == expected


def test_preview_and_strip(spark):
    df = spark.createDataFrame([("  ab\ncd \n",)], "t string")
    row = df.select(text.preview(F.col("t"), 5).alias("p"), text.strip(F.col("t")).alias("s")).first()
    assert row.p == "  ab " and row.s == "ab\ncd"
