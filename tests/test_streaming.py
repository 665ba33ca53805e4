import json

from evenkeel.streaming import ingest


def land(path, rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("".join(json.dumps(dict(zip(("model", "question_id", "run_index", "response_text"), r))) + "\n" for r in rows))


def test_replays_and_restart_keep_one_row_per_key(spark, tmp_path):
    rows = [(f"m{i % 2}", f"q{i}", 0, f"t{i}") for i in range(50)]
    landing, out, ck = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "ck")
    land(landing / "a.json", rows)
    land(landing / "b.json", rows)
    ingest.stream_responses(spark, str(landing), out, ck, files_per_trigger=1).awaitTermination()
    assert ingest.read_landed(spark, out).count() == 50
    land(landing / "c.json", rows + [("m0", "q99", 0, "late"), (None, "q1", 0, "no key")])
    ingest.stream_responses(spark, str(landing), out, ck).awaitTermination()
    assert ingest.read_landed(spark, out).count() == 51
    progress = str(tmp_path / "progress")
    ingest.stream_progress(spark, str(landing), progress, str(tmp_path / "ck2")).awaitTermination()
    assert {r.model: r.completed_calls for r in ingest.read_progress(spark, progress).collect()} == {"m0": 26, "m1": 25}


def test_unreadable_lines_land_in_an_error_table(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    land(landing / "a.json", [("m0", "q1", 0, "fine"), (None, "q1", 0, "no key")])
    (landing / "b.json").write_text('{"model": "m0", "question_id": "q2", "run_in\n\n')
    ingest.stream_unreadable(spark, str(landing), out, str(tmp_path / "ck")).awaitTermination()
    got = {(r.path.rsplit("/", 1)[1], r.line[:30]) for r in spark.read.parquet(out).collect()}
    assert got == {("a.json", '{"question_id":"q1","run_index'), ("b.json", '{"model": "m0", "question_id":')}


def landed(spark, rows):
    shape = "model string, question_id string, run_index int, response_text string, timestamp_utc string"
    return spark.createDataFrame(rows, shape)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """A crash after the rows and before the checkpoint: the batch comes again, with the same number."""
    out, columns = str(tmp_path / "out"), ["model", "question_id", "run_index", "response_text"]
    first = landed(spark, [("m", f"q{i % 9}", 0, f"t{i}", f"{i:02}") for i in range(18)])
    second = landed(spark, [("m", f"q{i}", 0, "later", "99") for i in range(12)])
    for number, batch in ((0, first), (0, first), (1, second), (1, second)):
        ingest._new_keys(batch, number, out, columns, 4)
    paths = list(ingest._directories(spark, out, "batch_id=").values())
    got = {r.question_id: r.response_text for r in spark.read.option("basePath", out).parquet(*paths).collect()}
    assert len(paths) == 2 and got == {f"q{i}": f"t{i}" for i in range(9)} | {f"q{i}": "later" for i in range(9, 12)}


def test_progress_is_whole_at_any_time(spark, tmp_path):
    landing, out, ck = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "ck")
    assert ingest.read_progress(spark, out).count() == 0
    for n in range(11):
        land(landing / f"{n}.json", [("a", f"q{i}", 0, "x") for i in range(n + 1)] + [("b", "q", n, "y")])
        ingest.stream_progress(spark, str(landing), out, ck).awaitTermination()
        assert {r.model: r.completed_calls for r in ingest.read_progress(spark, out).collect()} == {"a": n + 1, "b": n + 1}
    assert len(ingest._directories(spark, out, "snapshot-")) == ingest.SNAPSHOTS
    (tmp_path / "out" / "snapshot-99").mkdir()  # begun, not committed
    assert ingest.read_progress(spark, out).count() == 2


def test_streams_keep_no_state(spark, tmp_path):
    landing = tmp_path / "landing"
    land(landing / "a.json", [("m", "q", 0, "x")])
    for start in (ingest.stream_responses, ingest.stream_progress):
        query = start(spark, str(landing), str(tmp_path / start.__name__), str(tmp_path / f"{start.__name__}-ck"))
        query.awaitTermination()
        assert all(not p.stateOperators for p in query.recentProgress)


def test_answers_are_moved_once_and_progress_moves_keys_only(spark):
    rows = [("m0", "q1", i, f"text {i} {j}", str(j)) for i in range(130) for j in range(3)]
    batch = landed(spark, rows)
    whole = ingest._one_per_key(batch, batch.columns)
    assert {(r.run_index, r.response_text) for r in whole.collect()} == {(i, f"text {i} 0") for i in range(130)}
    keys = ingest._one_per_key(batch, list(ingest.KEY))
    assert keys.count() == 130

    def plan(df):
        return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().optimizedPlan().toString()

    physical, _ = plan(whole)
    assert physical.count("Exchange") == 1
    assert "Window" not in plan(keys)[0] and "Sort" not in plan(keys)[0]
