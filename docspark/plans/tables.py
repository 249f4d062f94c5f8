"""The library's tables as they are derived from a star schema and from conversations.

orders stand for the registry of documents, lineitem for their segments,
embeddings for chunks with vectors, conversations for chats, events for the
callbacks of tasks.  Each frame has its definition in SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which queries with a "now" are asked.
NOW = "1998-08-02 12:00:00"


def read(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    return df.select(*columns) if columns else df


def registry(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    kind = F.element_at(F.array(*map(F.lit, [".pdf", ".md", ".txt", ".DOCX"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    status = (
        F.when(F.col("o_orderpriority") == "5-LOW", "failed")
        .when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "processing")
        .otherwise("uploaded")
    )
    uploaded = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("Doc_"), F.col("o_orderkey"), kind).alias("file_name"),
        F.floor("o_totalprice").alias("file_size"),
        status.alias("status"),
        uploaded.alias("uploaded_at"),
        (uploaded + F.make_dt_interval(hours=(F.col("o_orderkey") % 50).cast("int"))).alias("updated_at"),
        F.concat_ws(",", F.lower(F.split("o_orderpriority", "-")[1]), F.concat(F.lit("c"), F.col("o_custkey") % 10)).alias("tags"),
        (F.col("o_custkey") % 10).alias("user_id"),
    )


REGISTRY = """registry AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Doc_' || o_orderkey || (['.pdf', '.md', '.txt', '.DOCX'])[o_orderkey % 4 + 1] AS file_name,
         CAST(floor(o_totalprice) AS BIGINT) AS file_size,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'uploaded' END AS status,
         CAST(o_orderdate AS TIMESTAMP) AS uploaded_at, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 50 AS INTEGER)) AS updated_at,
         lower(split_part(o_orderpriority, '-', 2)) || ',c' || (o_custkey % 10) AS tags, o_custkey % 10 AS user_id
  FROM orders)"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("document_id"),
        F.col("l_linenumber").alias("position"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.concat_ws(" ", F.lit("part"), F.col("l_partkey"), F.col("l_returnflag"), F.col("l_linestatus")).alias("text"),
    )


SEGMENTS = """segments AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS document_id, l_linenumber AS position, l_partkey AS part, l_suppkey AS supplier,
         'part ' || l_partkey || ' ' || l_returnflag || ' ' || l_linestatus AS text FROM lineitem)"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    metadata = F.create_map(
        F.lit("label"), F.concat(F.lit("label-"), F.col("label")), F.lit("parity"), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")
    )
    return e.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("file"), F.col("label")).alias("file_id"),
        F.concat(F.lit("file"), F.col("label"), F.lit(".txt")).alias("file_name"),
        F.col("vec_id").cast("int").alias("position"),
        F.concat(F.lit("chunk "), F.col("vec_id") % 40).alias("text"),
        F.col("embedding").alias("vector"),
        metadata.alias("metadata"),
    )


CHUNKS = """chunks AS (
  SELECT vec_id AS id, 'file' || label AS file_id, 'file' || label || '.txt' AS file_name, CAST(vec_id AS INTEGER) AS position,
         'chunk ' || (vec_id % 40) AS text, CAST(embedding AS DOUBLE[]) AS vector, 'label-' || label AS m_label,
         CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS m_parity FROM embeddings)"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int"))
    return c.select(
        F.col("conv_id").alias("session_id"), F.col("turn"), F.col("role"), F.col("text").alias("content"), at.alias("created_at"),
        (F.col("conv_id") % 7).alias("user_id"),
    )


MESSAGES = """messages AS (
  SELECT conv_id AS session_id, turn, role, text AS content, conv_id % 7 AS user_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS created_at FROM conversations)"""


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    first = F.min_by(F.substring("content", 1, 30), F.struct("turn", "content"))
    return m.groupBy("session_id").agg(
        first.alias("title"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.max("user_id").alias("user_id")
    )


SESSIONS = """sessions AS (
  SELECT session_id, min_by(substr(content, 1, 30), {'turn': turn, 'content': content}) AS title, min(created_at) AS created_at,
         max(created_at) AS updated_at, max(user_id) AS user_id FROM messages GROUP BY session_id)"""

STATUS = {"view": "pending", "click": "processing", "purchase": "completed", "error": "failed"}
TYPES = ("parse", "chunk", "vectorize", "process_complete")


def task_events(spark: SparkSession, sf: str) -> DataFrame:
    """Callbacks; events of type signup have a status that is not known."""
    e = read(spark, sf, "events")
    status = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in STATUS.items() for x in p)), "event_type"), F.col("event_type"))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id"),
        F.concat(F.lit("t"), F.col("user_id")).alias("task_id"),
        F.concat(F.lit("d"), F.col("user_id") % 200).alias("document_id"),
        kind.alias("type"),
        status.alias("status"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value"),
        F.col("props"),
    )


EVENTS = """task_events AS (
  SELECT event_id, 't' || user_id AS task_id, 'd' || (user_id % 200) AS document_id, (['parse', 'chunk', 'vectorize', 'process_complete'])[user_id % 4 + 1] AS type,
         CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END AS status,
         CAST(ts AS TIMESTAMP) AS ts, value, props FROM events)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit (a fixed rule)."""
    data = f"list_transform(range(0, CAST(length(hex(encode({text}))) AS BIGINT), 2), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(i + 1 AS BIGINT), 2) AS BIGINT))"
    step = "list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda a, b: {step}), 4294967295)"


def sql(body: str, *tables: str) -> str:
    return f"WITH {', '.join(tables)} {body}" if tables else body
