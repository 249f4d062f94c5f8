"""Tasks and their callbacks as keyed state, over whole tables of events."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.registry import STAGE_PROGRESS, TRANSITIONS, allowed_change

STATUSES = ("pending", "processing", "completed", "failed")
TYPES = ("parse", "chunk", "vectorize", "process_complete")
REQUIRED = ("task_id", "document_id", "status", "type")
CHUNK = "struct<text:string,index:int>"
VECTOR = "struct<chunk_index:int,vector:array<double>>"
#: The schema of each type's result.
RESULTS = {
    "parse": "content string, title string, pages int, words int, chars int, error string",
    "chunk": f"document_id string, chunks array<{CHUNK}>, chunk_count int, error string",
    "vectorize": f"document_id string, vectors array<{VECTOR}>, vector_count int, dimension int, error string",
    "process_complete": "document_id string, parse_status string, chunk_status string, vector_status string, chunk_count int, vector_count int, dimension int, error string",
}


def valid(events: DataFrame) -> Column:
    """All required fields are there, the status and the type are known."""
    there = [F.coalesce(F.col(c), F.lit("")) != "" for c in REQUIRED]
    return there[0] & there[1] & F.col("status").isin(*STATUSES) & F.col("type").isin(*TYPES)


def fault(events: DataFrame) -> Column:
    missing = F.filter(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in REQUIRED)), lambda x: x.isNotNull())
    return (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
        .when(~F.col("status").isin(*STATUSES), F.concat(F.lit("unknown status "), F.col("status")))
        .when(~F.col("type").isin(*TYPES), F.concat(F.lit("unknown type "), F.col("type")))
    )


def parse_result(kind: str, result: Column) -> Column:
    """The result of a task of this type; null if it is no such JSON."""
    if kind not in RESULTS:
        raise ValueError(f"unknown type {kind!r}")
    return F.from_json(result, RESULTS[kind])


def state(events: DataFrame) -> DataFrame:
    """One row for each task, after all its valid events in order of (ts, event_id).

    The status is the last one; started_at is the first time that it was
    processed, completed_at the last time that it ended if it has ended; the
    result is the last one given.  Aggregates alone: no window, no order within
    a task is needed, so a task with very many events is no problem.
    """
    order = F.struct("ts", "event_id")
    ended = F.col("status").isin("completed", "failed")
    last = events.groupBy("task_id").agg(
        F.max_by(F.struct("document_id", "type", "status", "ts"), order).alias("last"),
        F.min(F.when(F.col("status") == "processing", F.col("ts"))).alias("started_at"),
        F.max(F.when(ended, F.col("ts"))).alias("ended_at"),
        F.max_by("props", F.when(F.col("props").isNotNull(), order)).alias("result"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.count("*").alias("events"),
    )
    terminal = F.col("last.status").isin("completed", "failed")
    return last.select(
        "task_id", F.col("last.document_id").alias("document_id"), F.col("last.type").alias("type"), F.col("last.status").alias("status"),
        "started_at", F.when(terminal, F.col("ended_at")).alias("completed_at"), F.col("last.ts").alias("updated_at"), "result", "failures", "events",
    )


def document_status(status: Column) -> Column:
    """The document's status for a task's; pending changes nothing."""
    return F.when(status.isin("completed", "failed", "processing"), status)


def document_states(events: DataFrame) -> DataFrame:
    """(document_id, status): by the last event that changes it."""
    moved = events.withColumn("new", document_status(F.col("status"))).filter("new is not null")
    return moved.groupBy("document_id").agg(F.max_by("new", F.struct("ts", "event_id")).alias("status"))


def transitions(events: DataFrame) -> DataFrame:
    """Each status change of each document and whether it is allowed; repeated statuses are left out."""
    w = Window.partitionBy("document_id").orderBy("ts", "event_id")
    moved = events.withColumn("new", document_status(F.col("status"))).filter("new is not null")
    moved = moved.withColumn("old", F.lag("new", 1, "uploaded").over(w)).filter("old <> new")
    return moved.select("event_id", "document_id", "old", "new", allowed_change(F.col("old"), F.col("new")).alias("allowed"))


CHANGES = "event_id bigint, document_id string, old string, new string, allowed boolean"


def follow(status: str, events: list[tuple[int, str]]) -> tuple[list[tuple[int, str, str, bool]], str]:
    """(event_id, old, new, allowed) of the changes that these events ask for, and the status after them."""
    changed = []
    for event_id, new in events:
        if new != status:
            allowed = new in TRANSITIONS[status]
            changed.append((event_id, status, new, allowed))
            if allowed:
                status = new
    return changed, status


def document_changes(events: DataFrame) -> DataFrame:
    """The status changes of each document, beginning with uploaded: one that isn't allowed leaves the status as it is.

    (event_id, document_id, old, new, allowed) in the order of (ts, event_id);
    repeated events and repeated statuses give no row.  A document's events pass in
    order and only its status is held, so no document is too large.
    """
    moved = events.filter(valid(events) & document_status(F.col("status")).isNotNull() & F.col("ts").isNotNull())
    moved = moved.select("document_id", "ts", "event_id", "status").dropDuplicates(["event_id"])
    moved = moved.repartition("document_id").sortWithinPartitions("document_id", "ts", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, status = None, None
        for batch in batches:
            names, ids, new = (batch.column(k).to_pylist() for k in (0, 2, 3))
            rows = []
            for name, some in groupby(zip(names, ids, new, strict=True), key=lambda r: r[0]):
                if name != document:
                    document, status = name, "uploaded"
                changed, status = follow(status, [r[1:] for r in some])
                rows += [(i, document, *rest) for i, *rest in changed]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.string()] * 3, pa.bool_()], strict=True)], names=["event_id", "document_id", "old", "new", "allowed"])

    return moved.mapInArrow(run, CHANGES)


def outcome(result: Column) -> Column:
    """failed with an error; completed if parsing and chunking are, even where vectors failed; else no change."""
    return F.when(F.coalesce(result["error"], F.lit("")) != "", "failed").when((result["parse_status"] == "completed") & (result["chunk_status"] == "completed"), "completed")


def stage_progress(stage: Column) -> Column:
    said = F.lit(None).cast("int")
    for name, value in STAGE_PROGRESS.items():
        said = F.when(stage == name, value).otherwise(said)
    return said


def status_progress(status: Column) -> Column:
    return F.when(status.isin("processing", "failed"), 50).when(status == "completed", 100).otherwise(0)


def batch_progress(done: Column, total: Column) -> Column:
    return 20 + F.floor(done / total * 70).cast("int")


def eligible(tasks: DataFrame, max_retries: int = 3) -> DataFrame:
    """Failed tasks that may be tried again."""
    return tasks.filter((F.col("status") == "failed") & (F.col("failures") < max_retries))


def retries(events: DataFrame, max_retries: int = 3) -> DataFrame:
    """(task_id, document_id, type, attempt): a row for each failure after which a task is tried again, attempts from 1."""
    failed = events.filter("status = 'failed'").dropDuplicates(["event_id"])
    counted = failed.groupBy("task_id").agg(F.min_by(F.struct("document_id", "type"), F.struct("ts", "event_id")).alias("first"), F.count("*").alias("n"))
    tried = F.least(F.col("n"), F.lit(max_retries - 1))
    return counted.filter(tried > 0).select("task_id", "first.*", F.explode(F.sequence(F.lit(1).cast("bigint"), tried)).alias("attempt"))


def remembered(events: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(task_id, status, failures, events, expired): tasks whose state is forgotten after so many days without an event, as of `now`.

    Only what came after a task's last such gap counts.
    """
    w = Window.partitionBy("task_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.make_dt_interval(F.lit(days))
    rows = events.withColumn("life", F.count_if(gap).over(w))
    lives = rows.groupBy("task_id", "life").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("status") == "failed").alias("failures"), F.count("*").alias("events"), F.max("ts").alias("last"))
    last = lives.groupBy("task_id").agg(F.max_by(F.struct("status", "failures", "events", "last"), "life").alias("s"))
    return last.select("task_id", "s.status", "s.failures", "s.events", (F.col("s.last") + F.make_dt_interval(F.lit(days)) < now).alias("expired"))


def sweep(tasks: DataFrame, now: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Tasks that are kept, and those whose last change is too long ago."""
    old = F.col("updated_at") < now - F.make_dt_interval(F.lit(days))
    return tasks.filter(~old), tasks.filter(old)


def per_bucket(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(bucket, status, n): events per status and time bucket."""
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "status", "n")


def gaps(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(task_id, begin, n): sessions of events with less than the gap between them."""
    w = F.session_window("ts", gap)
    return events.groupBy("task_id", w.alias("w")).agg(F.count("*").alias("n")).select("task_id", F.col("w.start").alias("begin"), "n")
