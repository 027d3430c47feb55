import time

import pandas as pd

from paperloom.plans import catalog
from paperloom.streaming import intake

SF = "/root/testdata/sf0.001"


def test_settled_batch_and_stream(spark, tmp_path):
    rows = [("in/a.txt", 5, 1, 1), ("in/a.txt", 9, 2, 2), ("in/a.txt", 9, 2, 3), ("in/a.txt", 9, 2, 4), ("in/b.part", 1, 1, 1), ("in/b.part", 1, 1, 2), ("in/.c", 1, 1, 1), ("in/.c", 1, 1, 2), ("in/d", 1, 1, 2), ("in/d", 1, 1, 3)]
    schema = "path string, size long, mtime long, scan_no long"
    scans = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, intake.settled(scans).collect())) == [("in/a.txt", 3), ("in/d", 3)]
    for n in range(1, 5):
        pd.DataFrame([r for r in rows if r[3] == n], columns=["path", "size", "mtime", "scan_no"]).to_parquet(tmp_path / f"s{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = intake.settled_stream(stream).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("settled").collect())) == [("in/a.txt", 3), ("in/d", 3)]


def test_jobs_and_deliveries(spark):
    events = spark.createDataFrame([("j1", 1, "pending", 0.0, None), ("j1", 3, "running", 10.0, 100.0), ("j2", 2, "pending", 1.0, None), ("j3", 4, "running", 900.0, 100.0), ("j4", 5, "done", 5.0, None)], "job string, seq int, state string, at double, lease_seconds double")
    jobs = intake.job_table(events, now=1000.0)
    assert {r.job: r.state for r in jobs.collect()} == {"j1": "pending", "j2": "pending", "j3": "running", "j4": "done"}
    assert [r.job for r in intake.next_jobs(jobs, 1).collect()] == ["j1"]
    tries = [("m1", 1, 500, 10.0), ("m1", 2, 500, 20.0), ("m2", 1, 204, 5.0), ("m3", 1, 410, 5.0)] + [("m4", k, 500, float(k)) for k in range(1, 9)]
    out = {r.msg_id: (r.state, r.next_at) for r in intake.deliveries(spark.createDataFrame(tries, "msg_id string, attempt int, status int, at double")).collect()}
    assert out == {"m1": ("waiting", 320.0), "m2": ("done", None), "m3": ("failed", None), "m4": ("failed", None)}


def test_mailbox():
    box = {"validity": 7, "next": 4, "messages": {1: 10, 2: 10, 3: 10}}
    state, done = intake.mailbox_pass({}, box, 100, 2)
    assert done == [] and state["last"] == 3
    state, done = intake.mailbox_pass({}, box, 100, 2, backfill=True, deliver=lambda u: u != 2)
    assert done == [1, 3] and state["retry"] == {2: 1}
    box["messages"][4] = 500
    state, done = intake.mailbox_pass(state, box, 100, 2, deliver=lambda u: False)
    assert state["parked"] == [2, 4] and state["retry"] == {} and state["last"] == 4
    box["messages"][5] = 1
    state, done = intake.mailbox_pass(state, box, 100, 2, refuse=lambda u: u == 5)
    assert done == [] and state["parked"] == [2, 4] and state["last"] == 5
    assert intake.mailbox_pass(state, {**box, "validity": 8}, 100, 2, backfill=True)[1] == [1, 2, 3, 5]


def test_log_and_hourly_stream(spark, tmp_path):
    rows = spark.createDataFrame([("r", "b"), ("r", "a"), ("q", "z")], "run string, event string")
    assert sorted((r.run, r.event, r.seq) for r in intake.event_log(rows, ["event"]).collect()) == [("q", "z", 0), ("r", "a", 0), ("r", "b", 1)]
    got = intake.hourly_stream(spark, SF, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sum(r.n for r in got.collect()) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert "event_islands" in catalog.queries()


def _run(df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_jobs_stream(spark, tmp_path):
    rows = [[("j", 1, "pending", 0.0, None), ("j", 2, "running", 1.0, 5.0)], [("j", 2, "running", 1.0, 5.0), ("j", 3, "done", 2.0, None), ("k", 1, "pending", 3.0, None)]]
    for n, part in enumerate(rows):
        pd.DataFrame(part, columns=["job", "seq", "state", "at", "lease_seconds"]).astype({"lease_seconds": "float64"}).to_parquet(tmp_path / f"e{n}.parquet")
    stream = spark.readStream.schema("job string, seq long, state string, at double, lease_seconds double").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "e*.parquet").parquet(str(tmp_path))
    query = intake.jobs_stream(stream).writeStream.format("memory").queryName("jobs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp-jobs")).start()
    try:  # timers keep such a query going, so that it is stopped when the rows are there
        until = time.monotonic() + 60
        while time.monotonic() < until and spark.table("jobs").count() < 4:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(tuple(r) for r in spark.table("jobs").collect()) == [("j", "done", 2.0), ("j", "pending", 0.0), ("j", "running", 1.0), ("k", "pending", 3.0)]


def test_mailbox_stream(spark, tmp_path):
    rows = [[("b", 1, 7, 3, 1, 10, True), ("b", 1, 7, 3, 2, 10, False)], [("b", 2, 7, 4, 1, 10, True), ("b", 2, 7, 4, 2, 10, True), ("b", 2, 7, 4, 3, 999, True)]]
    for n, part in enumerate(rows):
        pd.DataFrame(part, columns=["box", "pass_no", "validity", "next_uid", "uid", "size", "accepted"]).to_parquet(tmp_path / f"m{n}.parquet")
    stream = spark.readStream.schema("box string, pass_no long, validity long, next_uid long, uid long, size long, accepted boolean").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "m*.parquet").parquet(str(tmp_path))
    assert sorted(_run(intake.mailbox_stream(stream, 100, 3, backfill=True), "mail", tmp_path)) == [("b", 1, 1), ("b", 2, 2)]


def test_outbox(spark, tmp_path):
    path, now = str(tmp_path / "tries"), [0.0]
    send = intake.outbox_batch(lambda i, b: 200 if i == "a" else 503, path, lambda: now[0])
    batch = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "msg_id string, body string")
    for at in (0.0, 1.0, 6.0, 7.0, 400.0):
        now[0] = at
        send(batch, 0)
    tries = sorted((r.msg_id, r.attempt, r.status, r.at) for r in spark.read.parquet(path).where("attempt > 0").collect())
    assert tries == [("a", 1, 200, 0.0), ("b", 1, 503, 0.0), ("b", 2, 503, 6.0), ("b", 3, 503, 400.0)]


def test_log_faults(spark):
    log = spark.createDataFrame([("a", 0, "x"), ("a", 1, "run.finished"), ("b", 0, "x"), ("b", 2, "y"), ("c", 0, "run.finished"), ("c", 1, "z")], "run string, seq long, event string")
    assert sorted((r.run, r.fault) for r in intake.log_faults(log).collect()) == [("b", "gap"), ("b", "open"), ("c", "late"), ("c", "open")]
