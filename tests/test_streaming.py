"""Streams give what their batch twins give."""

import datetime
import json
import random

from pyspark.sql import functions as F

from docspark.operators import tasks as K
from docspark.plans import tables as B
from docspark.streaming import tasks as T

SF = "/root/testdata/sf0.001"


def test_state_equals_batch(spark, tmp_path):
    e = B.task_events(spark, SF)
    e.repartition(2).write.parquet(f"{tmp_path}/in")
    good, bad = T.split(T.read_events(spark, f"{tmp_path}/in", e.schema, files=1))
    assert "reason" in bad.columns

    def keep(batch, n):
        batch.withColumn("n", F.lit(n)).write.mode("append").parquet(f"{tmp_path}/out")

    T.keyed_state(good).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").groupBy("task_id").agg(F.max_by(F.struct("status", "started_at", "completed_at", "result", "failures", "events"), "n").alias("s")).select("task_id", "s.*")
    batch = K.state(e.filter(K.valid(e))).select(rows.columns)
    assert sorted(map(str, rows.collect())) == sorted(map(str, batch.collect()))


def test_late_result_counts_by_its_own_time(spark, tmp_path):
    e = B.task_events(spark, SF)
    one = e.filter(K.valid(e) & F.col("ts").isNotNull()).first()
    hour = one["ts"].replace(hour=0, minute=0, second=0, microsecond=0)
    rows = [(minute, {**one.asDict(), "event_id": k, "ts": hour.replace(minute=minute), "status": "processing", "props": props}) for k, (minute, props) in enumerate([(10, "a"), (30, None), (20, "b")])]
    for batch in (rows[:2], rows[2:]):
        spark.createDataFrame([[r[c] for c in e.columns] for _, r in batch], e.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def keep(batch, n):
        batch.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")

    source = T.read_events(spark, f"{tmp_path}/in", e.schema, files=1)
    T.keyed_state(source).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/out/*").orderBy(F.desc("n")).first()
    batch = K.state(spark.read.parquet(f"{tmp_path}/in")).first()
    assert (last["result"], last["events"]) == (batch["result"], 3) and batch["result"] == "b"


def test_buckets_equal_batch(spark, tmp_path):
    e = B.task_events(spark, SF)
    for side in (F.col("ts") >= "2024-01-15", F.col("ts") < "2024-01-15", F.col("ts").isNull()):  # the later events come first
        e.filter(side).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    counts = T.per_bucket(T.read_events(spark, f"{tmp_path}/in", e.schema, files=1), late=None)
    got = T.last_counts(counts, ["bucket", "status"], f"{tmp_path}/out", f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().count() > 1
    assert sorted(map(str, got.collect())) == sorted(map(str, K.per_bucket(e).collect()))


def finished(spark):
    rows = [
        ("d1", "parse", "completed", json.dumps({"content": "para one\n\npara two"})), ("d2", "parse", "completed", json.dumps({"content": ""})), ("d3", "parse", "failed", None),
        ("d4", "chunk", "completed", json.dumps({"chunks": [{"text": "x y", "index": 0}, {"text": " ", "index": 1}]})), ("d5", "chunk", "completed", "{broken"),
        ("d6", "vectorize", "completed", "{}"), ("d7", "process_complete", "failed", "{}"), ("d8", None, "completed", "{}"), ("d9", "process_complete", "completed", None), ("d10", "new type", "completed", "z"),
    ]
    return spark.createDataFrame(rows, "document_id string, type string, status string, result string")


def test_next_stages(spark):
    got = [(r.type, r.document_id, r["index"], r.text, len(r.vector or [])) for r in T.next_stages(finished(spark)).collect()]
    assert sorted(got, key=str) == [("chunk", "d1", 0, "para one\n\npara two", 0), ("new type", "d10", None, "z", 0), ("vectorize", "d4", 0, "x y", 64), ("vectorize", "d6", None, "{}", 0)]
    none = lambda done: done.select("type", "document_id", F.lit(-1).alias("index"), F.lit("mine").alias("text"), F.lit(None).cast("array<float>").alias("vector"))
    got = T.next_stages(finished(spark), {"vectorize": ("stored", none)}, default=lambda done: none(done).limit(0)).collect()
    assert [(r.type, r.document_id, r["index"]) for r in got] == [("stored", "d6", -1)]


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path, monkeypatch):
    df = finished(spark)
    df.write.parquet(f"{tmp_path}/in")
    stream = lambda: T.fan_out(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c")
    stream().awaitTermination()
    read = lambda: sorted(str(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    once = read()
    assert len(once) == 4
    # As if the stream had failed after the batch was written and before that was noted.
    for p in (tmp_path / "c" / "commits").iterdir():
        p.unlink()
    stream().awaitTermination()
    assert read() == once


def callbacks(spark, rows):
    """(event_id, task, document, type, status, minutes) as callbacks."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, t, d, k, s, at + datetime.timedelta(minutes=m), 1.0, f"r{i}") for i, t, d, k, s, m in rows]
    return spark.createDataFrame(rows, "event_id bigint, task_id string, document_id string, type string, status string, ts timestamp, value double, props string")


HEARTBEAT = (None, None, None, None, None)


def test_document_machine_in_any_order(spark, tmp_path):
    """Shuffled and repeated callbacks in many batches give the rows of the ordered table."""
    rng = random.Random(3)
    rows = [(i, f"t{i % 9}", f"d{i % 7}", "parse", rng.choice(["pending", "processing", "completed", "failed", "unknown"]), rng.randrange(600)) for i in range(500)]
    e = callbacks(spark, rows)
    twice = rows + rng.sample(rows, 200)
    rng.shuffle(twice)
    for k in range(6):
        callbacks(spark, twice[k::6]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for minutes in (2000, 4000):
        callbacks(spark, [(*HEARTBEAT, minutes)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = T.read_events(spark, f"{tmp_path}/in", e.schema, files=1)
    T.run_to_end(T.document_changes(source, "700 minutes"), f"{tmp_path}/out", f"{tmp_path}/c")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, K.document_changes(e).collect()))
    assert {r.allowed for r in got} == {True, False}


def test_document_machine_follows_only_allowed_changes():
    moves = [(1, "processing"), (2, "processing"), (3, "completed"), (4, "failed"), (5, "processing"), (6, "completed")]
    changed, status = K.follow("uploaded", moves)
    assert changed == [(1, "uploaded", "processing", True), (3, "processing", "completed", True), (4, "completed", "failed", False), (5, "completed", "processing", False)] and status == "completed"
    assert K.follow("failed", [(1, "completed"), (2, "processing"), (3, "failed")]) == ([(1, "failed", "completed", False), (2, "failed", "processing", True), (3, "processing", "failed", True)], "failed")


def test_state_expires_by_the_clock_of_events(spark, tmp_path):
    """A week after its last event a task is forgotten; the state store is empty then; a later event begins anew."""
    day = 24 * 60
    steps = [
        [(1, "a", "d", "parse", "processing", 0), (2, "a", "d", "parse", "failed", 10), (3, "b", "d", "parse", "processing", 5 * day)],
        [(*HEARTBEAT, 6 * day)],
        [(*HEARTBEAT, 8 * day)],
        [(4, "a", "d", "parse", "processing", 9 * day), (5, "b", "d", "parse", "completed", 10 * day), (5, "b", "d", "parse", "completed", 10 * day)],
        [(*HEARTBEAT, 30 * day)],
    ]
    schema = callbacks(spark, steps[0]).schema
    states = []

    def keep(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{tmp_path}/out")

    for step in steps:
        callbacks(spark, step).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = T.keyed_state(T.read_events(spark, f"{tmp_path}/in", schema), expire_days=7, within="1 hour").writeStream.foreachBatch(keep)
        q = q.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        states.append({o["operatorName"]: o["numRowsTotal"] for o in q.lastProgress["stateOperators"]}["applyInPandasWithState"])
    assert states == [2, 2, 1, 2, 0]
    rows = [(r.task_id, r.status, r.failures, r.events, r.expired) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("batch", "task_id").collect()]
    assert rows == [
        ("a", "failed", 1, 2, False), ("b", "processing", 0, 1, False), ("a", "failed", 1, 2, True), ("a", "processing", 0, 1, False), ("b", "completed", 0, 2, False), ("a", "processing", 0, 1, True), ("b", "completed", 0, 2, True),
    ]


def test_gaps_within_a_batch_begin_anew(spark, tmp_path):
    day = 24 * 60
    rows = [(1, "a", "d", "parse", "failed", 0), (2, "a", "d", "parse", "failed", 3 * day), (3, "a", "d", "parse", "failed", 12 * day), (4, "a", "d", "parse", "processing", 13 * day)]
    e = callbacks(spark, rows)
    e.write.parquet(f"{tmp_path}/in")
    stream = T.keyed_state(T.read_events(spark, f"{tmp_path}/in", e.schema), expire_days=7, late="30 days")
    last = T.last_counts(stream, ["task_id"], f"{tmp_path}/out", f"{tmp_path}/c").first()
    assert (last.status, last.failures, last.events, last.expired) == ("processing", 1, 2, False)
    batch = K.remembered(e, F.lit("2024-01-15").cast("timestamp")).first()
    assert tuple(batch) == ("a", "processing", 1, 2, False)


def test_repeated_failures_count_once(spark, tmp_path):
    """Three failures, each told twice or more: two retries; the state counts three."""
    rows = [(i, "a", "d", "parse", "failed", i) for i in (1, 2, 3, 4)] + [(9, "b", "e", "chunk", "failed", 2), (10, "b", "e", "chunk", "completed", 3)]
    for batch in (rows[:2], [rows[0], rows[4]], rows[1:3] * 2, rows[:2] + rows[5:], [rows[3]] * 3):
        callbacks(spark, batch).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    e = callbacks(spark, rows)
    source = lambda: T.read_events(spark, f"{tmp_path}/in", e.schema, files=1)
    T.run_to_end(T.retries(source(), 3, within="1 day"), f"{tmp_path}/out", f"{tmp_path}/c")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == [("a", "d", "parse", 1), ("a", "d", "parse", 2), ("b", "e", "chunk", 1)] == sorted(map(tuple, K.retries(e, 3).collect()))
    state = T.last_counts(T.keyed_state(T.split(source())[0], within="1 day"), ["task_id"], f"{tmp_path}/out2", f"{tmp_path}/c2")
    assert {r.task_id: (r.events, r.failures, r.status) for r in state.collect()} == {"a": (4, 4, "failed"), "b": (2, 1, "completed")}


def test_files_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one  two\n\n\n\nthree")
    sink = lambda batch: batch.write.mode("append").parquet(f"{tmp_path}/out")
    for name in ("b.txt", "c.txt"):
        T.ingest_files(spark, str(tmp_path / "in"), sink, f"{tmp_path}/c").awaitTermination()
        (tmp_path / "in" / name).write_text(name)
    T.ingest_files(spark, str(tmp_path / "in"), sink, f"{tmp_path}/c").awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["b.txt", "c.txt", "one two\n\nthree"]


def test_repeated_callbacks(spark, tmp_path):
    e = B.task_events(spark, SF)
    e.unionByName(e).repartition(1).write.parquet(f"{tmp_path}/in")
    T.run_to_end(T.distinct_events(T.read_events(spark, f"{tmp_path}/in", e.schema)), f"{tmp_path}/out", f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/out").count() == e.count()
