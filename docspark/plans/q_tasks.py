"""STR, JSN and retention: task events as keyed state (the batch twins of the streams)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docspark.operators import tasks as K
from docspark.plans import tables as B
from docspark.plans.q_text import packed_sql
from docspark.plans.register import query

STAMP = "'%Y-%m-%d %H:%M:%S'"


def ev(body: str, *more: str) -> str:
    return B.sql(body, B.EVENTS, *more)


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def events(spark, sf):
    e = B.task_events(spark, sf)
    return e.filter(K.valid(e))


VALID = "valid AS (SELECT * FROM task_events WHERE status IN ('pending', 'processing', 'completed', 'failed'))"


@query("str1_validation", ev("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'missing task_id' WHEN status = 'signup' THEN 'unknown status signup' END AS reason FROM task_events"))
def validation(spark, sf):
    e = B.task_events(spark, sf).withColumn("task_id", F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("task_id")))
    return e.select("event_id", K.fault(e).alias("reason"))


@query(
    "str2_task_state",
    ev(
        f"""SELECT task_id, last.s AS status, strftime(started, {STAMP}) AS started_at, CASE WHEN last.s IN ('completed', 'failed') THEN strftime(ended, {STAMP}) END AS completed_at, result, failures, n AS events
        FROM (SELECT task_id, max_by({{'s': status}}, {{'a': ts, 'b': event_id}}) AS last, min(ts) FILTER (status = 'processing') AS started, max(ts) FILTER (status IN ('completed', 'failed')) AS ended,
                     max_by(props, {{'a': ts, 'b': event_id}}) FILTER (props IS NOT NULL) AS result, count(*) FILTER (status = 'failed') AS failures, count(*) AS n FROM valid GROUP BY task_id)""",
        VALID,
    ),
)
def task_state(spark, sf):
    return K.state(events(spark, sf)).select("task_id", "status", stamp("started_at"), stamp("completed_at"), "result", "failures", "events")


MOVES = "moves AS (SELECT event_id, document_id, coalesce(lag(status) OVER (PARTITION BY document_id ORDER BY ts, event_id), 'uploaded') AS old, status AS new FROM valid WHERE status <> 'pending')"


@query(
    "str3_transitions",
    ev("SELECT event_id, document_id, old, new, (old = 'uploaded') OR (old = 'processing' AND new IN ('completed', 'failed')) OR (old = 'failed' AND new = 'processing') AS allowed FROM moves WHERE old <> new", VALID, MOVES),
)
def transitions(spark, sf):
    return K.transitions(events(spark, sf))


CHANGES_SQL = ev(
    """SELECT event_id, document_id, old, new, new IN (CASE old WHEN 'uploaded' THEN 'processing' WHEN 'failed' THEN 'processing' END, CASE WHEN old IN ('uploaded', 'processing') THEN 'completed' END, CASE WHEN old IN ('uploaded', 'processing') THEN 'failed' END) IS TRUE AS allowed
       FROM (SELECT document_id, e.event_id, e.new, b.status AS old FROM followed AS b JOIN numbered AS e USING (document_id) WHERE e.k = b.k + 1) WHERE old <> new""",
    VALID,
    "numbered AS (SELECT document_id, event_id, status AS new, row_number() OVER (PARTITION BY document_id ORDER BY ts, event_id) AS k FROM valid WHERE status <> 'pending')",
    """followed(document_id, k, status) AS (
         SELECT DISTINCT document_id, CAST(0 AS BIGINT), 'uploaded' FROM numbered
         UNION ALL SELECT f.document_id, e.k, CASE WHEN f.status = 'uploaded' OR (f.status = 'processing' AND e.new IN ('completed', 'failed')) OR (f.status = 'failed' AND e.new = 'processing') THEN e.new ELSE f.status END
         FROM followed f JOIN numbered e ON e.document_id = f.document_id AND e.k = f.k + 1)""",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("str3_changes", CHANGES_SQL)
def document_changes(spark, sf):
    """Each document as a machine: refused changes leave its status."""
    return K.document_changes(B.task_events(spark, sf))


@query("str4_document_states", ev("SELECT document_id, max_by(status, {'a': ts, 'b': event_id}) AS status FROM valid WHERE status <> 'pending' GROUP BY document_id", VALID))
def document_states(spark, sf):
    return K.document_states(events(spark, sf))


@query(
    "str5_outcomes",
    ev("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 3 > 0 AND event_id % 5 > 0 THEN 'completed' END AS outcome FROM task_events WHERE type = 'process_complete'"),
)
def outcomes(spark, sf):
    k = F.col("event_id")
    said = F.to_json(F.struct(
        F.when(k % 7 == 0, "broken").alias("error"), F.when(k % 3 > 0, "completed").otherwise("failed").alias("parse_status"),
        F.when(k % 5 > 0, "completed").otherwise("failed").alias("chunk_status"), F.lit("failed").alias("vector_status"),
    ))
    e = B.task_events(spark, sf).filter("type = 'process_complete'")
    return e.select("event_id", K.outcome(K.parse_result("process_complete", said)).alias("outcome"))


@query("jsn1_results", ev("SELECT event_id, CASE WHEN event_id % 9 > 0 THEN 'c' || event_id END AS first_text, CASE WHEN event_id % 9 > 0 THEN CAST(event_id % 100 AS INTEGER) END AS chunk_count FROM task_events WHERE type = 'chunk'"))
def results(spark, sf):
    k = F.col("event_id")
    good = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("c"), k).alias("text"), F.lit(0).alias("index"))).alias("chunks"), (k % 100).cast("int").alias("chunk_count")))
    r = K.parse_result("chunk", F.when(k % 9 > 0, good).otherwise("{broken"))
    return B.task_events(spark, sf).filter("type = 'chunk'").select("event_id", r.alias("r")).select("event_id", F.get("r.chunks", 0)["text"].alias("first_text"), F.col("r.chunk_count").alias("chunk_count"))


@query("jsn3_task_round_trip", ev("SELECT event_id, task_id, status, status <> 'signup' AS known FROM task_events"))
def round_trip(spark, sf):
    e = B.task_events(spark, sf).select("event_id", F.to_json(F.struct("task_id", "status")).alias("j"))
    back = e.select("event_id", F.from_json("j", "task_id string, status string").alias("t"))
    return back.select("event_id", "t.task_id", "t.status", F.col("t.status").isin(*K.STATUSES).alias("known"))


@query("str8_retention", ev("SELECT task_id, max(ts) < TIMESTAMP '2024-01-25' AS swept FROM valid GROUP BY task_id", VALID))
def retention(spark, sf):
    now = F.lit("2024-02-01").cast("timestamp")
    kept, gone = K.sweep(K.state(events(spark, sf)), now)
    return kept.select("task_id", F.lit(False).alias("swept")).unionByName(gone.select("task_id", F.lit(True).alias("swept")))


REMEMBERED_SQL = ev(
    """SELECT task_id, max_by(status, {'a': ts, 'b': event_id}) AS status, count(*) FILTER (status = 'failed') AS failures, count(*) AS events, max(ts) + INTERVAL 7 DAY < (SELECT max(ts) FROM task_events) + INTERVAL 3 DAY AS expired
       FROM (SELECT *, max(life) OVER (PARTITION BY task_id) AS newest FROM lives) WHERE life = newest GROUP BY task_id""",
    VALID,
    "lives AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS life FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY task_id ORDER BY ts, event_id) > INTERVAL 7 DAY AS gap FROM valid))",
)


@query("str8_remembered", REMEMBERED_SQL)
def remembered(spark, sf):
    """The state of tasks that is forgotten after a week without an event, three days after the newest event."""
    e = B.task_events(spark, sf)
    newest = e.agg(F.max("ts")).first()[0] or datetime(1970, 1, 1)
    return K.remembered(events(spark, sf), F.lit(newest + timedelta(days=3)))


RETRIES_SQL = ev("SELECT task_id, document_id, type, unnest(range(1, least(n, 2) + 1)) AS attempt FROM (SELECT task_id, min_by(document_id, {'a': ts, 'b': event_id}) AS document_id, min_by(type, {'a': ts, 'b': event_id}) AS type, count(*) AS n FROM valid WHERE status = 'failed' GROUP BY task_id)", VALID)


@query("str10_retries", RETRIES_SQL)
def retries(spark, sf):
    return K.retries(events(spark, sf))


@query("str10_eligible", ev("SELECT task_id, failures FROM (SELECT task_id, max_by(status, {'a': ts, 'b': event_id}) AS status, count(*) FILTER (status = 'failed') AS failures FROM valid GROUP BY task_id) WHERE status = 'failed' AND failures < 15", VALID))
def eligible(spark, sf):
    return K.eligible(K.state(events(spark, sf)), 15).select("task_id", "failures")


@query("str11_buckets", ev(f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {STAMP}) AS bucket, status, count(*) AS n FROM valid GROUP BY ALL", VALID))
def buckets(spark, sf):
    return K.per_bucket(events(spark, sf)).select(stamp("bucket"), "status", "n")


@query(
    "str11_session_gaps",
    ev(
        f"""SELECT task_id, strftime(min(ts), {STAMP}) AS begin, count(*) AS n FROM (
          SELECT task_id, ts, sum(new) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS g FROM (
            SELECT task_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM valid WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id))) GROUP BY task_id, g""",
        VALID,
    ),
)
def session_gaps(spark, sf):
    return K.gaps(events(spark, sf), "6 hours").select("task_id", stamp("begin"), "n")


NEXT_SQL = f"""SELECT 'chunk' AS type, CAST(doc_id AS VARCHAR) AS document_id, index, text, 0 AS dimension FROM ({packed_sql("paragraph", "text", 1000, 200)}) WHERE doc_id % 4 = 0
  UNION ALL SELECT 'vectorize', CAST(doc_id AS VARCHAR), i, s, 64 FROM (SELECT doc_id, unnest([0, 1]) AS i, unnest([text, ' ']) AS s FROM documents WHERE doc_id % 4 = 1) WHERE trim(s, chr(9) || chr(10) || ' ') <> ''
  UNION ALL SELECT CASE doc_id % 4 WHEN 2 THEN 'vectorize' ELSE 'process_complete' END, CAST(doc_id AS VARCHAR), NULL, 'as it came', 0 FROM documents WHERE doc_id % 4 IN (2, 3)"""


def finished(spark, sf):
    """The documents as results of completed tasks of all types, some with a failed twin."""
    d, k = B.read(spark, sf, "documents"), F.col("doc_id") % 4
    kind = F.element_at(F.array(*map(F.lit, K.TYPES)), (k + 1).cast("int"))
    chunks = F.to_json(F.struct(F.array(F.struct(F.col("text"), F.lit(0).alias("index")), F.struct(F.lit(" ").alias("text"), F.lit(1).alias("index"))).alias("chunks")))
    result = F.when(k == 0, F.to_json(F.struct(F.col("text").alias("content")))).when(k == 1, chunks).otherwise("as it came")
    done = d.select(F.col("doc_id").cast("string").alias("document_id"), kind.alias("type"), F.lit("completed").alias("status"), result.alias("result"))
    return done.unionByName(done.filter("document_id LIKE '%7'").withColumn("status", F.lit("failed")))


def shown(follow_ups):
    return follow_ups.select("type", "document_id", "index", "text", F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0)).alias("dimension"))


@query("str6_next_stages", NEXT_SQL)
def next_stages(spark, sf):
    """What follows from completed tasks of every type: chunks, vectors, and the rest by the default handler."""
    from docspark.streaming.tasks import next_stages as follow

    return shown(follow(finished(spark, sf)))


@query("win5_breakpoints", f"WITH {B.CHUNKS}, d AS (SELECT file_id, id, CASE WHEN lag(vector) OVER w IS NOT NULL THEN round(1 - least(1, greatest(-1, list_cosine_similarity(vector, lag(vector) OVER w))), 6) END AS distance FROM chunks WINDOW w AS (PARTITION BY file_id ORDER BY id)), l AS (SELECT file_id, quantile_cont(distance, 0.95) AS q FROM d GROUP BY file_id) SELECT file_id, id, distance, CAST(sum(CASE WHEN distance > q THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY id) AS BIGINT) AS chunk FROM d JOIN l USING (file_id)")
def breakpoints(spark, sf):
    from docspark.operators.semantic import breakpoints as cut

    return cut(B.chunks(spark, sf).select("file_id", "id", "vector"), "file_id", "id", "vector").select("file_id", "id", "distance", "chunk")
