"""FLT, PRJ, J, AGG, TOP, SET and DOM on the registry of documents and its segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import dates as D
from docspark.functions import text as X
from docspark.functions import vector as V
from docspark.operators import registry as R
from docspark.operators import tasks as K
from docspark.operators.metadata import merge_metadata as merge_nested
from docspark.plans import tables as B
from docspark.plans.register import query

def now():
    return F.lit(B.NOW).cast("timestamp")


def reg(body: str, *more: str) -> str:
    return B.sql(body, B.REGISTRY, *more)


@query("flt1_point_lookup", reg("SELECT id, file_name, status FROM registry WHERE id = (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders)"))
def point_lookup(spark, sf):
    key = B.read(spark, sf, "orders").agg(F.max("o_orderkey").cast("string")).first()[0]
    return R.lookup(B.registry(spark, sf), key).select("id", "file_name", "status")


@query("flt2_status", reg("SELECT id FROM registry WHERE status = 'failed'"))
def status(spark, sf):
    return B.registry(spark, sf).filter(R.conditions(status="failed")).select("id")


@query("flt3_tag_substring", reg("SELECT id, tags FROM registry WHERE tags ILIKE '%HIGH%'"))
def tag(spark, sf):
    return B.registry(spark, sf).filter(R.conditions(tag="HIGH")).select("id", "tags")


@query("flt3_exact_tag", reg("SELECT id, tags FROM registry WHERE list_contains(string_split(tags, ','), 'c7')"))
def exact_tag(spark, sf):
    return B.registry(spark, sf).filter(R.has_tag("tags", "c7")).select("id", "tags")


@query("flt4_name_substring", reg("SELECT id, file_name FROM registry WHERE file_name ILIKE '%c\\_12%' ESCAPE '\\'"))
def name(spark, sf):
    return B.registry(spark, sf).filter(R.conditions(name="c_12")).select("id", "file_name")


@query("flt5_time_range", reg("SELECT id FROM registry WHERE uploaded_at >= TIMESTAMP '1995-01-01' AND uploaded_at <= TIMESTAMP '1995-06-30'"))
def time_range(spark, sf):
    return B.registry(spark, sf).filter(R.conditions(begin="1995-01-01", end="1995-06-30")).select("id")


@query("flt6_user", reg("SELECT id, user_id FROM registry WHERE user_id = 3"))
def user(spark, sf):
    return B.registry(spark, sf).filter(R.conditions(user=3)).select("id", "user_id")


ALL_CONDITIONS = "status = 'completed' AND tags ILIKE '%urgent%' AND file_name ILIKE '%.md%' AND uploaded_at >= TIMESTAMP '1994-01-01'"


@query("flt7_all_conditions", reg(f"SELECT id FROM registry WHERE {ALL_CONDITIONS}"))
def all_conditions(spark, sf):
    return B.registry(spark, sf).filter(R.conditions(status="completed", tag="urgent", name=".md", begin="1994-01-01")).select("id")


@query("agg2_filtered_total", reg(f"SELECT count(*) AS total FROM registry WHERE {ALL_CONDITIONS}"))
def filtered_total(spark, sf):
    return all_conditions(spark, sf).agg(F.count("*").alias("total"))


@query("flt14_allowed_types", reg("SELECT id, ends_with(file_name, '.pdf') OR ends_with(file_name, '.md') OR ends_with(file_name, '.markdown') OR ends_with(file_name, '.txt') AS accepted FROM registry"))
def allowed(spark, sf):
    yes, no = R.accepted(B.registry(spark, sf))
    return yes.select("id", F.lit(True).alias("accepted")).unionByName(no.select("id", F.lit(False).alias("accepted")))


@query("prj1_registry_list", reg("SELECT id AS file_id, file_name AS filename, status, tags, file_size AS size, strftime(uploaded_at, '%Y-%m-%dT%H:%M:%SZ') AS upload_time, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_time FROM registry"))
def listing(spark, sf):
    return B.registry(spark, sf).select(
        F.col("id").alias("file_id"), F.col("file_name").alias("filename"), "status", "tags", F.col("file_size").alias("size"),
        D.rfc3339(F.col("uploaded_at")).alias("upload_time"), D.rfc3339(F.col("updated_at")).alias("updated_time"),
    )


@query("prj2_source_info", B.sql("SELECT text, file_id, file_name, position FROM chunks", B.CHUNKS))
def source_info(spark, sf):
    return B.chunks(spark, sf).select("text", "file_id", "file_name", "position")


# The document id of a task is that of a registry row: d7 belongs to document 7.
LATEST = "latest AS (SELECT substr(document_id, 2) AS document_id, max_by({'task_id': task_id, 'status': status, 'ts': ts}, {'ts': ts, 'id': event_id}) AS t FROM task_events GROUP BY 1)"


def tasks(spark, sf):
    return B.task_events(spark, sf).withColumn("document_id", F.substring("document_id", 2, 20))


@query("j3_latest_task", reg("SELECT id, t.task_id AS task_id, t.status AS task_status FROM registry LEFT JOIN latest ON id = document_id", B.EVENTS, LATEST))
def latest_task(spark, sf):
    return R.with_latest_task(B.registry(spark, sf), tasks(spark, sf)).select("id", "task_id", "task_status")


@query("prj3_document_info", reg("SELECT id, '{\"id\":\"' || id || '\",\"status\":\"' || registry.status || '\"' || coalesce(',\"task_id\":\"' || t.task_id || '\",\"task_status\":\"' || t.status || '\"', '') || '}' AS info FROM registry LEFT JOIN latest ON id = document_id", B.EVENTS, LATEST))
def document_info(spark, sf):
    both = R.with_latest_task(B.registry(spark, sf), tasks(spark, sf))
    return both.select("id", F.to_json(F.struct("id", "status", "task_id", "task_status")).alias("info"))


@query(
    "j4_latest_process_complete",
    reg("SELECT id, max_by(task_id, {'ts': ts, 'id': event_id}) AS task_id FROM registry JOIN task_events ON id = substr(document_id, 2) WHERE type = 'process_complete' GROUP BY id", B.EVENTS),
)
def latest_complete(spark, sf):
    done = R.latest(tasks(spark, sf).filter("type = 'process_complete'"), "document_id", "ts", "event_id")
    return B.registry(spark, sf).join(done, F.col("id") == F.col("document_id")).select("id", "task_id")


@query("j5_document_tasks", reg("SELECT DISTINCT id, task_id FROM registry JOIN task_events ON id = substr(document_id, 2)", B.EVENTS))
def document_tasks(spark, sf):
    links = tasks(spark, sf).select("document_id", "task_id").distinct()
    return B.registry(spark, sf).select("id").join(links, F.col("id") == F.col("document_id")).select("id", "task_id")


@query("j6_segments", reg("SELECT id, position, text FROM registry JOIN segments ON id = document_id WHERE status = 'uploaded'", B.SEGMENTS))
def document_segments(spark, sf):
    docs = B.registry(spark, sf).filter("status = 'uploaded'").select("id")
    return docs.join(B.segments(spark, sf), F.col("id") == F.col("document_id")).select("id", "position", "text")


@query("j7_vectors_with_registry", B.sql("SELECT c.id, r.file_name, coalesce(r.status, 'unknown') AS status FROM chunks c LEFT JOIN registry r ON CAST(c.id AS VARCHAR) = r.id", B.REGISTRY, B.CHUNKS))
def vectors_with_registry(spark, sf):
    r = B.registry(spark, sf).select(F.col("id").alias("document_id"), "file_name", "status")
    both = B.chunks(spark, sf).select("id").join(r, F.col("id").cast("string") == F.col("document_id"), "left")
    return both.select("id", "file_name", F.coalesce("status", F.lit("unknown")).alias("status"))


@query("j8_chunks_with_vectors", "SELECT vec_id AS id, 'chunk ' || (vec_id % 40) AS text, len(embedding) AS dimension FROM embeddings")
def chunks_with_vectors(spark, sf):
    c = B.chunks(spark, sf)
    return c.select("id", "text").join(c.select("id", "vector"), "id").select("id", "text", F.size("vector").cast("bigint").alias("dimension"))


GONE = "gone AS (SELECT id FROM registry WHERE status = 'failed')"


@query(
    "j10_dom5_delete_documents",
    reg(
        """SELECT 'documents' AS name, count(*) AS n FROM registry WHERE id NOT IN (SELECT id FROM gone) UNION ALL
           SELECT 'segments', count(*) FROM segments WHERE document_id NOT IN (SELECT id FROM gone) UNION ALL
           SELECT 'chunks', count(*) FROM embeddings WHERE CAST(vec_id AS VARCHAR) NOT IN (SELECT id FROM gone) UNION ALL
           SELECT 'tasks', count(*) FROM task_events WHERE substr(document_id, 2) NOT IN (SELECT id FROM gone)""",
        B.SEGMENTS, B.EVENTS, GONE,
    ),
)
def delete_documents(spark, sf):
    r = B.registry(spark, sf)
    chunks = B.chunks(spark, sf).withColumn("file_id", F.col("id").cast("string"))
    left = R.delete_documents(r.filter("status = 'failed'"), r, B.segments(spark, sf), chunks, tasks(spark, sf))
    out = None
    for name_, df in left.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name_).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("j12_delete_chunks", B.sql("SELECT id FROM chunks WHERE file_id NOT IN ('file2') AND id % 9 <> 0", B.CHUNKS))
def delete_chunks(spark, sf):
    c = B.chunks(spark, sf)
    by_id = R.without(c, c.filter("id % 9 = 0"), "id")
    return R.without(by_id, c.filter("file_id = 'file2'").select("file_id").distinct(), "file_id", "file_id").select("id")


@query("agg1_counts", B.sql("SELECT document_id, count(*) AS n FROM segments GROUP BY document_id", B.SEGMENTS))
def counts(spark, sf):
    return B.segments(spark, sf).groupBy("document_id").agg(F.count("*").alias("n"))


@query("agg3_status_metrics", reg("SELECT count(*) AS total, count(*) FILTER (status = 'uploaded') AS uploaded, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM registry"))
def metrics(spark, sf):
    return R.status_metrics(B.registry(spark, sf))


@query("agg4_distribution", reg("SELECT s.status, count(r.id) AS n FROM (VALUES ('uploaded'), ('processing'), ('completed'), ('failed')) s(status) LEFT JOIN registry r ON r.status = s.status GROUP BY s.status"))
def distribution(spark, sf):
    return R.status_distribution(B.registry(spark, sf))


STATS = "per AS (SELECT r.id, r.file_size, (SELECT count(*) FROM segments s WHERE s.document_id = r.id) AS segments FROM registry r)"


@query(
    "agg5_statistics",
    reg("SELECT count(*) AS documents, CAST(sum(file_size) AS BIGINT) AS total_size, round(avg(file_size), 4) AS average_size, CAST(sum(segments) AS BIGINT) AS total_segments, round(avg(segments), 4) AS average_segments FROM per", B.SEGMENTS, STATS),
)
def statistics(spark, sf):
    s = R.statistics(B.registry(spark, sf), B.segments(spark, sf))
    return s.withColumns({"average_size": F.round("average_size", 4), "average_segments": F.round("average_segments", 4)})


@query("agg6_processing_times", reg("SELECT round(min(s), 3) AS min_seconds, round(max(s), 3) AS max_seconds, round(avg(s), 3) AS avg_seconds FROM (SELECT greatest(epoch(updated_at) - epoch(uploaded_at), 0) AS s FROM registry WHERE status = 'completed')"))
def processing_times(spark, sf):
    return R.processing_times(B.registry(spark, sf)).select(*(F.round(c, 3).alias(c) for c in ("min_seconds", "max_seconds", "avg_seconds")))


@query("agg7_whole_averages", reg("SELECT CAST(floor(avg(file_size)) AS BIGINT) AS average_size, CAST(floor(avg(segments)) AS BIGINT) AS average_segments FROM per", B.SEGMENTS, STATS))
def whole_averages(spark, sf):
    s = R.statistics(B.registry(spark, sf), B.segments(spark, sf))
    return s.select(F.col("average_size").cast("bigint").alias("average_size"), F.col("average_segments").cast("bigint").alias("average_segments"))


@query("dom6_dashboard", reg("SELECT 'total' AS name, CAST(count(*) AS DOUBLE) AS value FROM per UNION ALL SELECT 'total_size', CAST(sum(file_size) AS DOUBLE) FROM per UNION ALL SELECT 'total_segments', CAST(sum(segments) AS DOUBLE) FROM per UNION ALL SELECT 'completed', CAST(count(*) AS DOUBLE) FROM registry WHERE status = 'completed'", B.SEGMENTS, STATS))
def dashboard(spark, sf):
    r = B.registry(spark, sf)
    both = R.statistics(r, B.segments(spark, sf)).join(R.status_metrics(r))
    rows = [F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in ("total", "total_size", "total_segments", "completed")]
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("agg11_section_sums", B.sql("SELECT document_id, count(*) AS page_count, CAST(sum(length(replace(text, ' ', ''))) AS BIGINT) AS chars, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS words FROM segments GROUP BY document_id", B.SEGMENTS))
def section_sums(spark, sf):
    return B.segments(spark, sf).groupBy("document_id").agg(F.count("*").alias("page_count"), F.sum(X.count_chars("text")).alias("chars"), F.sum(X.count_words("text")).alias("words"))


@query("agg12_vector_summary", B.sql("SELECT file_id, count(*) AS chunk_count, count(vector) AS vector_count, max(len(vector)) AS dimension FROM chunks GROUP BY file_id", B.CHUNKS))
def vector_summary(spark, sf):
    return B.chunks(spark, sf).groupBy("file_id").agg(F.count("*").alias("chunk_count"), F.count("vector").alias("vector_count"), F.max(F.size("vector")).cast("bigint").alias("dimension"))


@query(
    "agg13_merge_metadata",
    """WITH m AS (SELECT c_custkey // 4 AS household, c_custkey AS k, c_name, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS money FROM customer),
       n AS (SELECT household, nation, min(k) AS k FROM m GROUP BY ALL)
       SELECT household, first(c_name ORDER BY k) AS name, coalesce(first(segment ORDER BY k) FILTER (k % 2 = 0), '') AS segment,
              (SELECT list('n' || nation ORDER BY n.k) FROM n WHERE n.household = m.household) AS tags,
              CASE WHEN count(*) FILTER (k % 4 IN (2, 3)) > 0 THEN 'household of many' ELSE 'household' END AS kind,
              first(money ORDER BY k) FILTER (money <> 0) AS first_money, max_by(k, k) FILTER (k % 4 = 3) AS fourth, list_sort(list(DISTINCT k % 4)) AS places
       FROM m GROUP BY household""",
)
def merge_metadata(spark, sf):
    """Of four customers each: the first name and segment, a union of tags, a text that a later one contains, and a nested object with values of its own."""
    k = F.col("c_custkey")
    given = F.to_json(F.struct(
        F.col("c_name").alias("name"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("segment"), F.array(F.concat(F.lit("n"), "c_nationkey")).alias("tags"),
        F.struct(F.when(k % 4 >= 2, "household of many").otherwise("household").alias("kind"), F.col("c_acctbal").alias("money"), F.when(k % 4 == 3, k).alias("fourth"), F.array(k % 4).alias("places")).alias("more"),
    ))
    rows = B.read(spark, sf, "customer").select(F.floor(k / 4).alias("household"), "c_custkey", given.alias("metadata"))
    merged = merge_nested(rows, "household", "c_custkey", "metadata")
    m = F.from_json("metadata", "name string, segment string, tags array<string>, more struct<kind: string, money: double, fourth: bigint, places: array<bigint>>")
    merged = merged.select("household", m.alias("m"))
    return merged.select("household", "m.name", "m.segment", "m.tags", "m.more.kind", F.col("m.more.money").alias("first_money"), "m.more.fourth", F.sort_array("m.more.places").alias("places"))


@query(
    "agg14_union_metadata",
    "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'later-' || vec_id ELSE 'label-' || label END AS label, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, CASE WHEN vec_id % 3 < 2 THEN 'x' || vec_id END AS extra, CASE WHEN vec_id % 3 < 2 THEN 3 ELSE 2 END AS n FROM embeddings",
)
def union_metadata(spark, sf):
    """Each chunk's own later map: one that replaces a value and adds one, one that adds one, an empty one."""
    k = F.col("id")
    extra, none = (F.lit("extra"), F.concat(F.lit("x"), k)), F.create_map().cast("map<string,string>")
    later = F.when(k % 3 == 0, F.create_map(F.lit("label"), F.concat(F.lit("later-"), k), *extra)).when(k % 3 == 1, F.create_map(*extra)).otherwise(none)
    m = B.chunks(spark, sf).select("id", R.union_metadata(F.col("metadata"), later).alias("m"))
    return m.select("id", *(F.col("m")[n].alias(n) for n in ("label", "parity", "extra")), F.size("m").alias("n"))


@query("top3_top8_registry_page", reg("SELECT id, strftime(uploaded_at, '%Y-%m-%d') AS day FROM registry ORDER BY uploaded_at DESC, id OFFSET 100 LIMIT 100"))
def registry_page(spark, sf):
    return R.page(B.registry(spark, sf), "uploaded_at", 2, 500).select("id", F.date_format("uploaded_at", "yyyy-MM-dd").alias("day"))


@query("win2_segment_index", B.sql("SELECT document_id, text, CAST(row_number() OVER (PARTITION BY document_id ORDER BY position, part, supplier, text) - 1 AS INTEGER) AS index FROM segments", B.SEGMENTS))
def segment_index(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy("position", "part", "supplier", "text")
    return B.segments(spark, sf).select("document_id", "text", (F.row_number().over(w) - 1).alias("index"))


@query("set1_upsert", B.sql("SELECT id, CASE WHEN id % 4 = 0 THEN 'new' ELSE text END AS text FROM chunks UNION ALL SELECT id + 1000000, 'added' FROM chunks WHERE id % 10 = 0", B.CHUNKS))
def upsert(spark, sf):
    c = B.chunks(spark, sf).select("id", "text")
    new = c.filter("id % 4 = 0").select("id", F.lit("new").alias("text")).unionByName(c.filter("id % 10 = 0").select((F.col("id") + 1000000).alias("id"), F.lit("added").alias("text")))
    return R.upsert(c, new, "id")


@query("set2_append_valid", B.sql("SELECT id FROM chunks UNION ALL SELECT id + 1000000 FROM chunks WHERE id % 3 <> 0", B.CHUNKS))
def append_valid(spark, sf):
    c = B.chunks(spark, sf).select("id", "vector")
    batch = c.select((F.col("id") + 1000000).alias("id"), F.when(F.col("id") % 3 == 0, F.slice("vector", 1, 3)).otherwise(F.col("vector")).alias("vector"))
    return c.unionByName(batch.filter(V.fault(F.col("vector"), 64).isNull())).select("id")


@query("set4_tag_union", reg("SELECT id, array_to_string(list_sort(list_distinct(list_concat(string_split(tags, ','), ['c1', 'extra']))), ',') AS tags FROM registry"))
def tag_union(spark, sf):
    more = F.array(F.lit("c1"), F.lit("extra"))
    return B.registry(spark, sf).select("id", F.array_join(F.array_sort(F.array_union(F.split("tags", ","), more)), ",").alias("tags"))


@query("set5_search_scope", B.sql("SELECT DISTINCT id FROM chunks WHERE file_id IN ('file0', 'file4')", B.CHUNKS))
def search_scope(spark, sf):
    c = B.chunks(spark, sf)
    return c.filter("file_id = 'file0'").unionByName(c.filter("file_id = 'file4'")).select("id").distinct()


@query("dom8_update_tags", reg("SELECT id, CASE WHEN CAST(id AS BIGINT) % 8 = 0 THEN 'changed' ELSE tags END AS tags FROM registry"))
def update_tags(spark, sf):
    r = B.registry(spark, sf).select("id", "tags")
    changes = r.filter(F.col("id").cast("bigint") % 8 == 0).select("id", F.lit("changed").alias("tags"))
    return R.update(r, changes, "id")


@query(
    "dom9_status_update",
    reg("SELECT id, CASE WHEN k % 6 = 0 THEN 'completed' WHEN k % 6 = 1 THEN 'processing' ELSE status END AS status, CASE WHEN k % 6 = 0 THEN strftime(TIMESTAMP '" + B.NOW + "', '%Y-%m-%d %H:%M:%S') END AS processed_at, CASE WHEN k % 6 <= 1 THEN CAST(greatest(0, least(100, k % 300 - 50)) AS INTEGER) END AS progress FROM (SELECT *, CAST(id AS BIGINT) AS k FROM registry)"),
)
def status_update(spark, sf):
    r, k = B.registry(spark, sf), F.col("id").cast("bigint")
    changes = r.filter(k % 6 <= 1).select("id", F.when(k % 6 == 0, "completed").otherwise("processing").alias("new_status"), F.lit(None).cast("string").alias("new_error"), (k % 300 - 50).cast("int").alias("new_progress"))
    done = R.set_status(r, changes, now())
    return done.select("id", "status", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss").alias("processed_at"), "progress")


@query("snk2_storage_path", reg("SELECT id, strftime(uploaded_at, '%Y/%m/%d/') || id || lower('.' || string_split(file_name, '.')[-1]) AS path FROM registry"))
def storage_path(spark, sf):
    from docspark.sources.files import storage_path as path

    return B.registry(spark, sf).select("id", path(F.col("id"), F.col("file_name"), F.col("uploaded_at")).alias("path"))


@query("dt1_dt2_times", reg("SELECT id, strftime(uploaded_at, '%Y-%m-%dT%H:%M:%SZ') AS parsed, strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'Z' ELSE '+00:00' END AS zoned FROM registry"))
def times(spark, sf):
    k = F.col("id").cast("bigint")
    iso = F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(k % 2 == 0, iso).otherwise(F.concat(iso, F.lit("+00:00")))
    other = F.when(k % 3 == 0, F.date_format("uploaded_at", "yyyy-MM-dd HH:mm:ss")).when(k % 3 == 1, F.date_format("uploaded_at", "yyyy/MM/dd HH:mm:ss")).otherwise(D.with_zone(said))
    return B.registry(spark, sf).select("id", D.rfc3339(D.parse_time(other, now())).alias("parsed"), D.with_zone(said).alias("zoned"))


@query("dt3_dt6_labels", reg(f"SELECT id, CASE date_diff('day', CAST(uploaded_at AS DATE), DATE '1998-08-02') WHEN 0 THEN 'Today, ' || strftime(uploaded_at, '%H:%M') WHEN 1 THEN 'Yesterday, ' || strftime(uploaded_at, '%H:%M') ELSE strftime(uploaded_at, '%Y-%m-%d') END AS label FROM registry"))
def labels(spark, sf):
    return B.registry(spark, sf).select("id", D.day_label(F.col("uploaded_at"), now()).alias("label"))


@query("dt4_expired", reg(f"SELECT id FROM registry WHERE uploaded_at < TIMESTAMP '{B.NOW}' - INTERVAL 365 DAY"))
def expired(spark, sf):
    return B.registry(spark, sf).filter(D.expired(F.col("uploaded_at"), now(), 365)).select("id")


@query("dt5_defaults", reg(f"SELECT id, strftime(coalesce(CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN uploaded_at END, TIMESTAMP '{B.NOW}'), '%Y-%m-%d %H:%M:%S') AS created, 'Chat ' || strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS title FROM registry"))
def defaults(spark, sf):
    given = F.when(F.col("id").cast("bigint") % 2 == 0, F.col("uploaded_at"))
    return B.registry(spark, sf).select("id", F.date_format(F.coalesce(given, now()), "yyyy-MM-dd HH:mm:ss").alias("created"), D.default_title("Chat", F.col("uploaded_at")).alias("title"))


@query("src4_merge_sections", B.sql("SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY position, text) AS text, count(*) AS page_count FROM segments GROUP BY document_id", B.SEGMENTS))
def merge_sections(spark, sf):
    from docspark.sources.files import merge_sections as merge

    return merge(B.segments(spark, sf), "document_id", "position", "text")


@query("str7_progress", reg("SELECT id, CASE status WHEN 'completed' THEN 100 WHEN 'uploaded' THEN 0 ELSE 50 END AS by_status, CAST(20 + floor((CAST(id AS BIGINT) % 16) / 16.0 * 70) AS INTEGER) AS by_batch FROM registry"))
def progress(spark, sf):
    return B.registry(spark, sf).select("id", K.status_progress(F.col("status")).alias("by_status"), K.batch_progress(F.col("id").cast("bigint") % 16, F.lit(16)).alias("by_batch"))
