import pytest
from pyspark.sql import functions as F

from evenkeel.sources import questions, stages


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_gold_csv(spark, tmp_path):
    path = write(tmp_path / "g.csv", 'question,answer\n"one\nline",A\ntwo,"say ""hi"", ok"\nthree,\n')
    rows = questions.read_gold_csv(spark, path).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        ("q1", "one\nline", "A", ""), ("q2", "two", 'say "hi", ok', ""), ("q3", "three", None, "")
    ]
    named = questions.read_gold_csv(spark, path, missing_text="nan").filter("id = 'q3'").first()
    assert named.gold_answer == "nan"
    with pytest.raises(ValueError, match="answer"):
        questions.read_gold_csv(spark, write(tmp_path / "b.csv", "question,foo\na,b\n"))


def test_ordinal_over_files_and_blocks(spark, tmp_path):
    lines = [f"row {i}" for i in range(400)]
    for part in range(4):
        write(tmp_path / "many" / f"part-{part}.txt", "\n".join(lines[part * 100 : part * 100 + 100 - part]) + "\n")
    expected = [x for p in range(4) for x in lines[p * 100 : p * 100 + 100 - p]]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = questions.with_ordinal(spark.read.text(str(tmp_path / "many"))).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.value for r in got] == expected and [r.ordinal for r in got] == list(range(1, len(expected) + 1))


TABLE = """# Questions

| id | question | gold_answer | notes |
|----|:---------|-------------|-------|
| q1 |  What?   | This.       | n |
  | q2 | Why? | Because.  |  |
not a row
"""


def test_markdown(spark, tmp_path):
    rows = questions.read_gold_markdown(spark, write(tmp_path / "q.md", TABLE)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("q1", "What?", "This.", "n"), ("q2", "Why?", "Because.", "")]
    with pytest.raises(ValueError, match="malformed"):
        questions.read_gold_markdown(spark, write(tmp_path / "a.md", TABLE + "| q3 | x |\n"))
    with pytest.raises(ValueError, match="duplicate"):
        questions.read_gold_markdown(spark, write(tmp_path / "b.md", TABLE + "| q1 | x | y | z |\n"))
    with pytest.raises(ValueError, match="lacks"):
        questions.read_gold_markdown(spark, write(tmp_path / "c.md", "| id | question |\n|---|---|\n"))
    with pytest.raises(ValueError, match="no pipe table"):
        questions.read_gold_markdown(spark, write(tmp_path / "d.md", "nothing\n"))


def test_markdown_in_part_files(spark, tmp_path):
    write(tmp_path / "d" / "part-0.md", "| id | question | gold_answer |\n|--|--|--|\n| q1 | a | b |\n")
    write(tmp_path / "d" / "part-1.md", "".join(f"| x{i} | some longer question | b |\n" for i in range(200)))
    rows = questions.read_gold_markdown(spark, str(tmp_path / "d")).collect()
    assert len(rows) == 201 and {r.gold_answer for r in rows} == {"b"}


def test_qa_source(spark, tmp_path):
    path = write(
        tmp_path / "m.csv",
        "Question,Answer,Focus (Drug),Question Type\n what is a? , It is a. ,a,Information\nhow b?,,b,Usage\nwhy c?,So.,,\n",
    )
    out = questions.normalize_qa_source(questions.read_table(spark, path))
    assert [tuple(r) for r in out.collect()] == [
        ("what is a?", "It is a.", "MedicationQA", "a | Information"), ("why c?", "So.", "MedicationQA", " | ")
    ]
    stages.write_csv(out, str(tmp_path / "gold"))
    assert questions.read_gold_csv(spark, str(tmp_path / "gold")).count() == 2
    with pytest.raises(ValueError, match="question/answer"):
        questions.normalize_qa_source(spark.createDataFrame([(1, 2)], "foo int, bar int"))
    plain = spark.createDataFrame([("q", "a")], "Questions string, Response string")
    assert questions.normalize_qa_source(plain).first().focus_area == ""


def test_sampling(spark, tmp_path):
    df = spark.createDataFrame([(f"q{i}", f"t{i}") for i in range(1, 31)], "id string, question string")
    assert [r.id for r in questions.head_sample(df, 3).collect()] == ["q1", "q2", "q3"]
    assert [r.id for r in questions.head_sample(df, 11).collect()][-1] == "q11"
    picked = {r.id for r in questions.random_sample(df, 10, 1).collect()}
    assert len(picked) == 10 and picked == {r.id for r in questions.random_sample(df.repartition(5), 10, 1).collect()}
    assert picked != {r.id for r in questions.random_sample(df, 10, 2).collect()}
    assert questions.random_sample(df, 99).count() == 30
    for bad in ({"head": 0}, {"random": -1}, {"head": 1, "random": 1}):
        with pytest.raises(ValueError):
            questions.sample_questions(df, **bad)
    questions.export_sample(df, 10, 1, str(tmp_path / "s"))
    assert {r.id for r in stages.read_csv(spark, str(tmp_path / "s")).collect()} == picked


def test_csv_keeps_empty_and_missing_apart(spark, tmp_path):
    rows = [("a", "", 1), ("b", None, None), ('c "q"\n', "x,y\\", 3)]
    df = spark.createDataFrame(rows, "model string, response_text string, run_index int")
    stages.write_csv(df, str(tmp_path / "c"))
    back = stages.read_csv(spark, str(tmp_path / "c"), stages.RESPONSE_SCHEMA)
    assert sorted(map(tuple, back.collect())) == sorted(rows) and dict(back.dtypes)["run_index"] == "int"


def test_checkpoint_formats(spark, tmp_path):
    path = str(tmp_path / "r")
    write(tmp_path / "r" / "x.jsonl", '{"model":"a","question_id":"q1","run_index":0,"response_text":"é"}\n\n')
    assert [(r.model, r.run_index, r.response_text) for r in stages.read_responses(spark, path).collect()] == [("a", 0, "é")]
    stages.write_responses(stages.read_responses(spark, path), str(tmp_path / "w"), jsonl=False, csv=False)
    assert [p.name for p in (tmp_path / "w").iterdir()] == ["raw_responses.parquet"]


def test_stage_resume(spark, tmp_path):
    out = str(tmp_path)
    one, two = (spark.createDataFrame([(n,)], "model string") for n in ("one", "two"))
    with pytest.raises(FileNotFoundError, match="scored_responses"):
        stages.read_stage(spark, out, stages.SCORED)
    assert stages.write_stage(one, out, stages.SCORED, resume=True)
    assert not stages.write_stage(two, out, stages.SCORED, resume=True)
    assert stages.read_stage(spark, out, stages.SCORED).first().model == "one"
    (tmp_path / "scored_responses.parquet" / "_SUCCESS").unlink()  # a job that died half-way
    assert stages.write_stage(two, out, stages.SCORED, resume=True, csv=True)
    assert stages.read_stage(spark, out, stages.SCORED).first().model == "two"
    assert stages.read_csv(spark, f"{out}/scored_responses.csv").select(F.col("model")).first().model == "two"


def test_an_unreadable_answer_is_an_error(spark, tmp_path):
    from evenkeel.sources.stages import read_responses

    (tmp_path / "a.jsonl").write_text('{"model": "m", "question_id": "q1", "run_index": 0}\n\n')
    assert read_responses(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.jsonl").write_text('{"model": "m", "question_id": "q2", "run_in\n')
    with pytest.raises(Exception, match="unreadable answer in .*b.jsonl"):
        read_responses(spark, str(tmp_path)).collect()


def test_written_files_are_compressed_and_bounded_in_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "FILE_ROWS", 10, raising=False)
    rows = spark.range(35).selectExpr("'m' AS model", "concat('q', id) AS question_id", "'a\\nb' AS response_text").coalesce(1)
    stages.write_responses(rows, str(tmp_path), parquet=False)
    for kind in ("jsonl", "csv"):
        files = list((tmp_path / f"{stages.RAW}.{kind}").glob("part-*"))
        assert len(files) == 4 and all(f.suffix == ".gz" for f in files)
    assert stages.read_responses(spark, str(tmp_path / f"{stages.RAW}.jsonl")).select(*rows.columns).exceptAll(rows).isEmpty()
    back = stages.read_csv(spark, str(tmp_path / f"{stages.RAW}.csv"), stages.RESPONSE_SCHEMA)
    assert back.count() == 35 and back.exceptAll(rows).isEmpty()


def test_answers_read_back_lie_compressed_and_bounded(spark, tmp_path, monkeypatch):
    from evenkeel.plans import catalog, derived

    words = " ".join(f"word{i}" for i in range(60))
    turns = [(c, t, role, f"{c} {words}") for c in range(4) for t, role in ((1, "user"), (2, "assistant"))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    monkeypatch.setattr(stages, "FILE_ROWS", 40)
    monkeypatch.setattr(stages, "scratch_dir", lambda _: str(tmp_path / "kept"))
    got = catalog.read_responses(spark, str(tmp_path))
    files = list((tmp_path / "kept").glob("part-*"))
    answers = derived.answers(spark, str(tmp_path))
    assert all(f.name.endswith(".json.gz") for f in files) and len(files) >= 5
    assert sum(f.stat().st_size for f in files) < answers.select(F.sum(F.length("question"))).first()[0] / 4
    expected = answers.select(*got.columns)
    assert got.count() == 200 and got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()
