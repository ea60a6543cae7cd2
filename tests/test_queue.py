"""The queue on arbitrary state: restarts in the middle of a retry, dead letters as a table, outcomes once."""

import time

import pytest

from lorewell.streaming import jobs, queue

EVENTS = "doc_id long, seq long, kind string, error string"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    for k, v in queue.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in queue.STORE:
        spark.conf.unset(k)


def put(spark, path, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def events(spark, path):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def read(spark, path, schema=queue.ACTIONS):
    return [] if not list(path.glob("batch=*/*.parquet")) else spark.read.schema(schema).parquet(*map(str, path.glob("batch=*"))).collect()


def wait(spark, path, there, seconds=90):
    until = time.monotonic() + seconds
    while time.monotonic() < until and not there(read(spark, path)):
        time.sleep(0.3)
    return read(spark, path)


def test_a_restart_in_the_middle_of_a_retry_loses_and_repeats_nothing(spark, tmp_path):
    source, out, dead = f"{tmp_path}/in", tmp_path / "out", tmp_path / "dead"
    start = lambda: queue.deliver(queue.actions(events(spark, source), base=20), str(out), str(dead), f"{tmp_path}/ck")
    put(spark, source, [(1, 1, "enqueue", None), (1, 2, "failure", "timeout"), (2, 1, "enqueue", None), (2, 2, "enqueue", None), (3, 1, "enqueue", None), (3, 2, "failure", "parse file: bad")])
    q = start()
    wait(spark, out, lambda rows: any(r.action == "retry" for r in rows))
    jobs.stop(q, 0)  # whatever runs is cut off
    assert not any(r.seq == -1 for r in read(spark, out))
    # delivered again, as a queue does that delivers at least once, and something new
    put(spark, source, [(1, 1, "enqueue", None), (1, 2, "failure", "timeout"), (2, 3, "success", None)])
    q = start()
    try:
        wait(spark, out, lambda rows: any(r.seq == -1 for r in rows) and any(r.seq == 3 for r in rows))
        put(spark, source, [(1, 3, "failure", "slow"), (1, 4, "failure", "late"), (1, 5, "success", None)])
        rows = wait(spark, out, lambda rows: any(r.action == "dead" and r.doc_id == 1 for r in rows))
    finally:
        jobs.stop(q, 30)
    got = sorted((r.doc_id, r.seq, r.action, r.attempt) for r in rows)
    assert got == [
        (1, -1, "start", 2), (1, 1, "start", 1), (1, 2, "retry", 2), (1, 3, "retry", 3), (1, 4, "dead", 3), (1, 5, "ignored", 0),
        (2, 1, "start", 1), (2, 2, "ignored", 1), (2, 3, "done", 1), (3, 1, "start", 1), (3, 2, "dead", 1),
    ]
    letters = {r.doc_id: (r.attempt, r.errors) for r in read(spark, dead)}
    assert letters == {1: (3, ["timeout", "slow", "late"]), 3: (1, ["parse file: bad"])}


def test_the_same_actions_as_without_timers(spark, tmp_path):
    rows = [(d, s, k, e) for d in range(6) for s, (k, e) in enumerate([("enqueue", None), ("failure", "x"), ("failure", "y"), ("enqueue", None), ("cancel", None), ("success", None)][: d + 1], 1)]
    put(spark, f"{tmp_path}/in", rows)
    q = queue.deliver(queue.actions(events(spark, f"{tmp_path}/in"), base=500, timers=False), f"{tmp_path}/out", f"{tmp_path}/dead", f"{tmp_path}/ck", availableNow=True)
    assert q.awaitTermination(60)
    got = sorted((r.doc_id, r.seq, r.action, r.attempt, r.delay_seconds) for r in read(spark, tmp_path / "out"))
    want = []
    for d in range(6):
        state = (0, False)
        for _, s, k, e in [r for r in rows if r[0] == d]:
            state, *x = jobs.step(state, k, e, 3, 500)
            want.append((d, s, *x))
    assert got == sorted(want)


def test_outcomes_are_written_once_for_each_batch(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 1, "start", 1, 0, []), (1, 2, "ignored", 1, 0, []), (2, 4, "retry", 2, 5, ["x"])], queue.ACTIONS)
    handled = []

    def done(rows):
        handled.append(sorted(r.doc_id for r in rows.collect()))
        return rows.selectExpr("doc_id", "99L AS seq", "'success' AS kind", "CAST(NULL AS STRING) AS error")

    acts = lambda: spark.readStream.schema(queue.ACTIONS).parquet(f"{tmp_path}/in")
    for checkpoint in ("ck", "lost"):  # the second has forgotten that the batch was done
        queue.work(acts(), done, f"{tmp_path}/outcomes", f"{tmp_path}/{checkpoint}", availableNow=True).awaitTermination(60)
    assert handled == [[1]]
    assert [(r.doc_id, r.kind) for r in read(spark, tmp_path / "outcomes", EVENTS)] == [(1, "success")]


def test_session_lists(spark, tmp_path):
    schema = "session_id string, ts timestamp, role string, content string"
    for part in ([("a", k) for k in range(25)], [("a", 30), ("b", 1)]):
        spark.createDataFrame([(s, k, "user", f"m{k}") for s, k in part], "session_id string, k int, role string, content string").selectExpr("session_id", "timestamp_seconds(k) AS ts", "role", "content").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = queue.session_lists(stream).writeStream.format("memory").queryName("session_lists").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="0 seconds").start()
    until = time.monotonic() + 60
    while time.monotonic() < until and spark.table("session_lists").count() < 3:
        time.sleep(0.3)
    jobs.stop(q)
    assert sorted((r.session_id, r.turns, r["last"]) for r in spark.table("session_lists").collect()) == [("a", 20, "m24"), ("a", 20, "m30"), ("b", 1, "m1")]
