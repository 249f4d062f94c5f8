"""Task callbacks as streams; each has a batch twin in docspark.operators.tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docspark.functions import chunks as C
from docspark.functions import text as X
from docspark.operators import tasks as K
from docspark.operators.embed import embed

STATE = "status string, started_at timestamp, ended_at timestamp, result string, last_ts timestamp, last_id bigint, failures bigint, events bigint, result_ts timestamp, result_id long"
OUTPUT = "task_id string, status string, started_at timestamp, completed_at timestamp, result string, failures bigint, events bigint, expired boolean"
OUT = [x.split()[0] for x in OUTPUT.split(", ")]
MACHINE_STATE = "status string, last_us bigint, last_id bigint, wait_us array<bigint>, wait_ids array<bigint>, waits array<string>"


def read_events(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; `ts` as a timestamp, for watermarks."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid callbacks, and the others with the reason."""
    return events.filter(K.valid(events)), events.filter(~K.valid(events)).withColumn("reason", K.fault(events))


def timely(events: DataFrame, late: str, also: Column | None = None) -> DataFrame:
    """Valid events with a time, under a watermark that all events move on.

    An event without a task is a heartbeat: in a quiet stream it moves the watermark, so
    that what waits for it goes on, and does nothing else.
    """
    good = K.valid(events) if also is None else K.valid(events) & also
    # In one predicate with ts: others are applied below the watermark, which heartbeats then wouldn't reach.
    return events.withWatermark("ts", late).filter(F.when(F.col("ts").isNull(), False).otherwise(good))


@dataclass
class Task:
    """What is known of a task: a fold over its events in any order."""

    status: str | None = None
    started: datetime | None = None
    ended: datetime | None = None
    result: str | None = None
    last: tuple = (None, -1)
    failures: int = 0
    events: int = 0
    result_at: tuple = (None, -1)

    def add(self, rows: pd.DataFrame) -> None:
        """Events sorted by (ts, event_id), looked at as arrays: a few operations on each, as there are many tasks."""
        status, ts, ids = rows["status"].to_numpy(object), rows["ts"].to_numpy("datetime64[ns]"), rows["event_id"].to_numpy()
        at = lambda i: (pd.Timestamp(ts[i]), int(ids[i]))
        earliest = lambda a, b: b if a is None else a if b is None else min(a, b)
        latest = lambda a, b: b if a is None else a if b is None else max(a, b)
        timed = ~np.isnat(ts)
        failed = status == "failed"
        begun, done = np.flatnonzero((status == "processing") & timed), np.flatnonzero((failed | (status == "completed")) & timed)
        self.events += len(rows)
        self.failures += int(failed.sum())
        self.started = earliest(self.started, pd.Timestamp(ts[begun[0]]) if len(begun) else None)
        self.ended = latest(self.ended, pd.Timestamp(ts[done[-1]]) if len(done) else None)
        props = rows["props"].to_numpy(object)
        told = next((i for i in range(len(props) - 1, -1, -1) if not pd.isna(props[i])), None)
        if told is not None and (self.result is None or at(told) >= self.result_at):
            self.result, self.result_at = props[told], at(told)
        if self.last[0] is None or at(-1) >= self.last:
            self.status, self.last = status[-1], at(-1)

    def row(self, task_id: str, expired: bool = False) -> pd.DataFrame:
        done = self.ended if self.status in ("completed", "failed") else None
        return pd.DataFrame([(task_id, self.status, self.started, done, self.result, self.failures, self.events, expired)], columns=OUT)

    def stored(self) -> tuple:
        return (self.status, self.started, self.ended, self.result, *self.last, self.failures, self.events, *self.result_at)

    @classmethod
    def read(cls, x: tuple) -> Task:
        return cls(x[0], x[1], x[2], x[3], (x[4], x[5]), x[6], x[7], (x[8], x[9]))


def keyed_state(events: DataFrame, expire_days: int | None = None, within: str | None = None, late: str = "1 hour", mode: str = "update") -> DataFrame:
    """The state of each task after each batch that touches it.

    Events of a task may come in any order: the status is that of the greatest
    (ts, event_id) so far, times are minima and maxima.

    With `within`, an event id that comes again in that time (by ts) changes nothing.
    With `expire_days`, a task without an event for longer is forgotten: a row with
    `expired` says so when the watermark, `late` behind the newest event, has passed
    that time, and a later event begins anew.  Time is that of the events, so a stream
    that is read to its end (availableNow) ends, and gives the same however its
    events are divided into batches, as long as none is later than `late`.
    """
    if expire_days:
        events = timely(events, within or late)
        events = events.dropDuplicatesWithinWatermark(["event_id"]) if within else events
    elif within:
        events = distinct_events(events, within)
    span = pd.Timedelta(days=expire_days or 0)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        task = Task.read(state.get) if state.exists else Task()
        if state.hasTimedOut:
            state.remove()
            yield task.row(key[0], expired=True)
            return
        rows = list(parts)
        rows = rows[0] if len(rows) == 1 else pd.concat(rows)
        # Events without a time are last.
        rows = rows.iloc[np.lexsort((rows["event_id"].to_numpy(), rows["ts"].to_numpy("datetime64[ns]").view("int64"), rows["ts"].isna().to_numpy()))]
        if expire_days:
            gaps = np.flatnonzero(rows["ts"].diff() > span)
            if len(gaps):
                rows, task = rows.iloc[gaps[-1] :], Task()
            elif task.last[0] is not None and rows["ts"].iloc[0] - task.last[0] > span:
                task = Task()
        task.add(rows)
        state.update(task.stored())
        if expire_days:
            state.setTimeoutTimestamp(max(int((task.last[0] + span).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield task.row(key[0])

    return events.groupBy("task_id").applyInPandasWithState(update, OUTPUT, STATE, mode, "EventTimeTimeout" if expire_days else "NoTimeout")


def document_changes(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The status changes of each document as a machine that keeps its status where a change isn't allowed.

    (event_id, document_id, old, new, allowed), in the order of (ts, event_id) whatever
    the order of arrival: events wait in the state until the watermark, `late` behind
    the newest event, has passed them.  Events that come again, and those that name
    the status that the document has, change nothing and give no row; refused changes give one.
    Heartbeats as in `timely`.
    """
    moves = timely(events, late, K.document_status(F.col("status")).isNotNull()).select("document_id", "event_id", "ts", "status")

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, last_us, last_id, us, ids, waits = state.get if state.exists else ("uploaded", -(2**62), -1, [], [], [])
        held = {i: (u, w) for u, i, w in zip(us, ids, waits, strict=True)}
        for part in parts:
            for u, i, w in zip(part["ts"].astype("datetime64[us]").astype("int64").tolist(), part["event_id"].tolist(), part["status"].tolist(), strict=True):
                if (u, i) > (last_us, last_id):
                    held.setdefault(i, (u, w))
        mark = state.getCurrentWatermarkMs() * 1000
        order = sorted((u, i, w) for i, (u, w) in held.items())
        ready = [x for x in order if x[0] <= mark]
        rest = order[len(ready) :]
        changed, status = K.follow(status, [(i, w) for _, i, w in ready])
        if ready:
            last_us, last_id = ready[-1][:2]
        state.update((status, last_us, last_id, *(list(x) for x in (zip(*rest, strict=True) if rest else ([], [], [])))))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame([(i, key[0], old, new, ok) for i, old, new, ok in changed], columns=["event_id", "document_id", "old", "new", "allowed"])

    return moves.groupBy("document_id").applyInPandasWithState(update, K.CHANGES, MACHINE_STATE, "append", "EventTimeTimeout")


def retries(events: DataFrame, max_retries: int = 3, within: str = "1 hour") -> DataFrame:
    """(task_id, document_id, type, attempt): a row for each failure after which the task is tried again.

    The failures of a task are counted in the state; the one that reaches the limit
    gives no row, nor do later ones.  A failure that comes again within the time
    (by ts) isn't counted.  Attempts are numbered from 1 in the order of arrival.
    """
    failed = distinct_events(events, within).filter("status = 'failed'").select("task_id", "document_id", "type", "ts", "event_id")

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        for part in parts:
            rows = part.sort_values(["ts", "event_id"])
            attempt = seen + 1 + np.arange(len(rows))
            again = attempt < max_retries
            yield pd.DataFrame({"task_id": key[0], "document_id": rows["document_id"].to_numpy()[again], "type": rows["type"].to_numpy()[again], "attempt": attempt[again]})
            seen += len(rows)
        state.update((min(seen, max_retries),))

    return failed.groupBy("task_id").applyInPandasWithState(update, "task_id string, document_id string, type string, attempt bigint", "failures bigint", "append", "NoTimeout")


def per_bucket(events: DataFrame, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """(bucket, status, n): counts per status and time bucket; events later than `late` are dropped.

    With late=None none is dropped, in whatever order they come; counts are then
    kept for all buckets, and the output mode has to be update or complete.
    """
    counted = (events.withWatermark("ts", late) if late else events).groupBy(F.window("ts", width).alias("w"), "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("bucket"), "status", "n")


def distinct_events(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """Callbacks come at least once; repeated event ids within the time are dropped."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_id"])


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, then stop."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def last_counts(df: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """An aggregate or keyed state run in update mode over all that is there now: the last row of each key.

    Also what append mode holds back until a watermark passes is there.
    """

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)

    df.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    values = [c for c in df.columns if c not in keys]
    last = df.sparkSession.read.parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, "last.*")


def parsed_to_chunks(done: DataFrame) -> DataFrame:
    """Chunks of the content of parse results; an empty content has none."""
    texts = done.select("document_id", K.parse_result("parse", F.col("result"))["content"].alias("text"))
    cut = C.paragraph_chunks(texts, 1000, 200)
    return cut.select("document_id", "index", "text", F.lit(None).cast("array<float>").alias("vector"))


def chunks_to_vectors(done: DataFrame) -> DataFrame:
    """Vectors of the chunks of chunk results; empty chunks have none."""
    rows = done.select("document_id", F.explode(K.parse_result("chunk", F.col("result"))["chunks"]).alias("c"))
    vectors, _ = embed(rows.select("document_id", F.col("c.index").alias("index"), F.col("c.text").alias("text")))
    return vectors.select("document_id", "index", "text", "vector")


def passed_on(done: DataFrame) -> DataFrame:
    """The default handler: the result as it came, for whoever asks for it."""
    return done.select("type", "document_id", F.lit(None).cast("int").alias("index"), F.col("result").alias("text"), F.lit(None).cast("array<float>").alias("vector"))


Handler = Callable[[DataFrame], DataFrame]
#: What follows when a task of this type has completed: the next task's type and its rows.
HANDLERS: dict[str, tuple[str, Handler]] = {"parse": ("chunk", parsed_to_chunks), "chunk": ("vectorize", chunks_to_vectors)}


def next_stages(batch: DataFrame, handlers: dict[str, tuple[str, Handler]] = HANDLERS, default: Handler = passed_on) -> DataFrame:
    """(type, document_id, index, text, vector): the follow-up rows of all completed tasks of a batch.

    Tasks of a type without a handler go to the default one and keep their type;
    tasks that are not completed, and results that are broken or empty, give no row.
    """
    done = batch.filter("status = 'completed' AND type IS NOT NULL AND result IS NOT NULL")
    shown = ["type", "document_id", "index", "text", "vector"]
    made = [handle(done.filter(F.col("type") == kind)).withColumn("type", F.lit(then)).select(shown) for kind, (then, handle) in handlers.items()]
    return reduce(DataFrame.unionByName, [*made, default(done.filter(~F.col("type").isin(*handlers))).select(shown)])


def fan_out(events: DataFrame, path: str, checkpoint: str, handlers: dict[str, tuple[str, Handler]] = HANDLERS, default: Handler = passed_on) -> StreamingQuery:
    """Writes the follow-up rows of every batch below path/batch=<id>, by type.

    A batch that runs again, after a failure between its writing and its
    checkpoint, replaces what it wrote, so that nothing is there twice.
    """

    def each(batch: DataFrame, n: int) -> None:
        next_stages(batch, handlers, default).write.mode("overwrite").partitionBy("type").parquet(f"{path}/batch={n}")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_files(spark: SparkSession, path: str, sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Newly arrived text files as (path, text), handed to `sink` batch by batch."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    rows = files.select(F.input_file_name().alias("path"), X.clean_text("value").alias("text"))
    return rows.writeStream.foreachBatch(lambda batch, _: sink(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
