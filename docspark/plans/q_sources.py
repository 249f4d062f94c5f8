"""SRC, SNK and ingest: parsing pages, tables written and read again."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators import registry as R
from docspark.plans import q_tasks
from docspark.plans import tables as B
from docspark.plans.register import SQL, query
from docspark.plans.q_text import CLEAN, packed_sql
from docspark.sources import files as S


def folder(spark, name: str) -> str:
    """A new folder that driver and executors share; only on one machine it may be below the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def html_text_sql(column: str) -> str:
    t = f"regexp_replace(coalesce({column}, ''), '(?is)<script\\b.*?</script[ \\t-\\r]*>|<style\\b.*?</style[ \\t-\\r]*>|<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '[ \\t-\\r]+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(?i)</?(?:{S.BLOCK_TAGS})\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for name, said in S.ENTITIES.items():
        t = f"replace({t}, '{name}', '{said.replace(chr(39), chr(39) * 2)}')"
    return f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10) || chr(10))"


@query("src3_pages_to_text", f"SELECT page_id, {html_text_sql('html')} AS text FROM pages")
def pages(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", S.html_to_text(F.col("html")).alias("text"))


@query(
    "udf3_parsers",
    B.sql("SELECT id, ends_with(file_name, '.md') OR ends_with(file_name, '.txt') AS parsed, CASE WHEN ends_with(file_name, '.md') THEN file_name || chr(10) || chr(10) || 'kept as it is: ' || id WHEN ends_with(file_name, '.txt') THEN '# ' || file_name || chr(10) || chr(10) || 'kept as it is: **' || id || '**' END AS text FROM registry", B.REGISTRY),
)
def parsers(spark, sf):
    """Contents with marks, which the parser of one kind takes away and the other's leaves; no parser for the other kinds."""
    content = F.concat(F.lit("# "), "file_name", F.lit("\n\nkept as it is: **"), "id", F.lit("**"))
    yes, no = S.parse(B.registry(spark, sf).withColumn("content", content))
    return yes.select("id", F.lit(True).alias("parsed"), "text").unionByName(no.select("id", F.lit(False).alias("parsed"), F.lit(None).cast("string").alias("text")))


@query("src5_snk1_vectors_written", "SELECT vec_id AS id, 'file' || label AS file_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS squares FROM embeddings")
def vectors_written(spark, sf):
    path = folder(spark, "chunks")
    S.write_chunks(B.chunks(spark, sf), path)
    c = S.read_chunks(spark, path)
    return c.select("id", "file_id", F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x), 6).alias("squares"))


@query("snk2_by_date", B.sql("SELECT id, file_name, year(uploaded_at) AS year, month(uploaded_at) AS month, day(uploaded_at) AS day FROM registry", B.REGISTRY))
def by_date(spark, sf):
    """The whole registry written by day and read again, with the columns that it is partitioned by."""
    path = folder(spark, "registry")
    S.write_by_date(B.registry(spark, sf), path, "uploaded_at")
    return spark.read.parquet(path).select("id", "file_name", *(F.col(c).cast("bigint").alias(c) for c in ("year", "month", "day")))


@query(
    "snk3_latest_chunk_result",
    B.sql("SELECT document_id, max_by(props, {'a': ts, 'b': event_id}) AS result FROM task_events WHERE type = 'chunk' AND status = 'completed' GROUP BY document_id", B.EVENTS),
)
def latest_chunk_result(spark, sf):
    done = B.task_events(spark, sf).filter("type = 'chunk' AND status = 'completed'")
    return R.latest(done, "document_id", "ts", "event_id").select("document_id", F.col("props").alias("result"))


@query("src6_append", B.sql("SELECT count(*) AS n FROM (SELECT * FROM segments UNION ALL SELECT * FROM segments)", B.SEGMENTS))
def append(spark, sf):
    path = folder(spark, "segments")
    S.append(B.segments(spark, sf), path)
    S.append(B.segments(spark, sf), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("src1_list_files", f"SELECT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang, '{X.UNKNOWN_MIME}' AS mime, count(DISTINCT doc_id % 8) AS n_files, count(DISTINCT doc_id % 8) AS n_ids, true AS named, true AS filled FROM documents GROUP BY lang")
def list_files(spark, sf):
    """The files of the documents written by language: of each folder below, how its files are listed."""
    path = folder(spark, "listed")
    B.read(spark, sf, "documents").withColumn("eighth", F.pmod("doc_id", F.lit(8))).repartition("lang", "eighth").write.partitionBy("lang", "eighth").parquet(path)
    files = S.list_files(spark, path).filter(F.col("name").startswith("part-")).withColumn("lang", F.regexp_extract("path", "/lang=([^/]*)/", 1))
    named = (F.col("name") == F.concat("id", F.lit(".parquet"))) & F.col("path").endswith(F.concat(F.lit("/"), "name"))
    return files.groupBy("lang", "mime").agg(F.count("*").alias("n_files"), F.countDistinct("path").alias("n_ids"), F.bool_and(named).alias("named"), F.bool_and(F.col("size") > 0).alias("filled"))


@query("src2_read_texts", "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def read_texts(spark, sf):
    """Each document written as a line of JSON, read as text and parsed again."""
    path = folder(spark, "texts")
    B.read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).write.json(path)
    lines = spark.read.text(path).select(F.from_json("value", "doc_id bigint, text string").alias("d"))
    return lines.select("d.doc_id", F.md5("d.text").alias("digest"))


@query(
    "dom1_ingest",
    f"""SELECT doc_id, 'doc' || doc_id || CASE WHEN doc_id % 10 = 0 THEN '.pdf' ELSE '.txt' END AS file_name, CASE WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN doc_id % 10 = 0 THEN 0 ELSE coalesce(n, 0) END AS segment_count
        FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({packed_sql("sentence", CLEAN, 1000, 200)}) GROUP BY doc_id) USING (doc_id)""",
)
def ingest(spark, sf):
    """Documents as files: cleaned, chunked, embedded, written as chunks, segments and registry; files that can't be parsed fail."""
    d = B.read(spark, sf, "documents")
    kind = F.when(F.col("doc_id") % 10 == 0, ".pdf").otherwise(".txt")
    path = folder(spark, "ingest")
    S.ingest(d.select("doc_id", F.concat(F.lit("doc"), F.col("doc_id"), kind).alias("file_name"), F.col("text").alias("content")), path)
    return spark.read.parquet(f"{path}/registry")


@query("str9_incremental_files", f"SELECT doc_id, {CLEAN} AS text FROM documents")
def incremental(spark, sf):
    """The documents table as files that arrive, read by a stream to its end."""
    from docspark.streaming.tasks import run_to_end

    path = folder(spark, "arrived")
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/document[s].parquet").select("doc_id", X.clean_text("text").alias("text"))
    run_to_end(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


def arrivals(spark, sf, name: str, *order: str):
    """The events table as a stream whose events all come twice, then a heartbeat three days after the last; how many days they span; a folder."""
    from docspark.streaming import tasks as T

    path = folder(spark, name)
    e = B.task_events(spark, sf)
    first, last = (t or datetime(1970, 1, 1) for t in e.agg(F.min("ts"), F.max("ts")).first())
    e.unionByName(e).repartitionByRange(*order).write.parquet(f"{path}/in")
    beat = spark.range(1).select(*(F.lit(last + timedelta(days=3) if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in e.schema))
    beat.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return T.read_events(spark, f"{path}/in", e.schema, files=1_000_000), (last - first).days + 1, path


@query("str2_stream_state", SQL["str2_task_state"])
def stream_state(spark, sf):
    """The events table as a stream that brings each event twice; the last state of each task, as str2_task_state gives it."""
    from docspark.streaming import tasks as T

    events, days, path = arrivals(spark, sf, "state", "ts")
    stream = T.keyed_state(T.split(events)[0], within=f"{days} days")
    last = T.last_counts(stream, ["task_id"], f"{path}/out", f"{path}/checkpoint")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return last.select("task_id", "status", at("started_at"), at("completed_at"), "result", "failures", "events")


@query("str3_stream_changes", SQL["str3_changes"])
def stream_changes(spark, sf):
    """The same as a stream, with events that come in no order and twice."""
    from docspark.streaming import tasks as T

    events, days, path = arrivals(spark, sf, "changes", "value")
    # All wait until the heartbeat, three days after the last event, has passed them.
    T.run_to_end(T.document_changes(events, "1 day"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


@query("str8_stream_remembered", SQL["str8_remembered"])
def stream_remembered(spark, sf):
    """The state of tasks with a lifetime of a week, as of the heartbeat."""
    from docspark.streaming import tasks as T

    events, days, path = arrivals(spark, sf, "remembered", "ts")
    stream = T.keyed_state(events, expire_days=7, within="1 minute")
    return T.last_counts(stream, ["task_id"], f"{path}/out", f"{path}/checkpoint").select("task_id", "status", "failures", "events", "expired")


@query("str10_stream_retries", SQL["str10_retries"])
def stream_retries(spark, sf):
    """Failed tasks that are tried again, at most twice each, with failures that come twice."""
    from docspark.streaming import tasks as T

    events, days, path = arrivals(spark, sf, "retries", "ts")
    T.run_to_end(T.retries(T.split(events)[0], within=f"{days} days"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


@query("str6_stream_next_stages", SQL["str6_next_stages"])
def stream_next_stages(spark, sf):
    """The same as a stream that writes each batch's rows below the batch's number; a batch that runs twice replaces itself."""
    from docspark.streaming import tasks as T

    path = folder(spark, "stages")
    done = q_tasks.finished(spark, sf)
    done.write.parquet(f"{path}/in")
    T.fan_out(spark.readStream.schema(done.schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return q_tasks.shown(spark.read.parquet(f"{path}/out"))


@query("str11_stream_buckets", SQL["str11_buckets"])
def stream_buckets(spark, sf):
    """Counts per hour and status by a stream, for all events: a table's files come in any order and its last hours count too."""
    from docspark.streaming import tasks as T

    path = folder(spark, "buckets")
    e = B.task_events(spark, sf)
    e.repartitionByRange("ts").write.parquet(f"{path}/in")
    counts = T.per_bucket(T.split(T.read_events(spark, f"{path}/in", e.schema))[0], late=None)
    return T.last_counts(counts, ["bucket", "status"], f"{path}/out", f"{path}/checkpoint").select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "status", "n")
