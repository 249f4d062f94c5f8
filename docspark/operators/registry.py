"""The registry of documents: filters, pages, statistics, joins and changes.

Every ordering ends in a unique key.  Changes return new frames; nothing is
updated in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("uploaded", "processing", "completed", "failed")
ALLOWED = (".pdf", ".md", ".markdown", ".txt")
#: The status changes that are allowed; a repeated status changes nothing.
TRANSITIONS = {"uploaded": ("processing", "completed", "failed"), "processing": ("completed", "failed"), "failed": ("processing",), "completed": ()}
STAGE_PROGRESS = {"parsing": 20, "chunking": 50, "vectorizing": 75, "completed": 100}


def like(c: Column | str, part: str) -> Column:
    """Whether the text contains `part`, in any case; `%` and `_` in it are themselves."""
    escaped = part.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return F.ilike(F.col(c) if isinstance(c, str) else c, F.lit(f"%{escaped}%"))


def has_tag(c: Column | str, tag: str) -> Column:
    return F.array_contains(F.split(c, ","), tag)


def conditions(status=None, tag=None, name=None, begin=None, end=None, user=None, time: str = "uploaded_at", text: str = "file_name", tags: str = "tags") -> Column:
    """All given conditions together; without any, true."""
    found = []
    if status is not None:
        found.append(F.col("status") == status)
    if tag is not None:
        found.append(like(tags, tag))
    if name is not None:
        found.append(like(text, name))
    if begin is not None:
        found.append(F.col(time) >= F.lit(begin).cast("timestamp"))
    if end is not None:
        found.append(F.col(time) <= F.lit(end).cast("timestamp"))
    if user is not None:
        found.append(F.col("user_id") == user)
    return reduce(Column.__and__, found, F.lit(True))


def page_bounds(page: int | None, size: int | None) -> tuple[int, int]:
    """(offset, limit): pages count from 1 and hold 10 rows by default, 100 at most."""
    page = page if page and page > 0 else 1
    size = min(size, 100) if size and size > 0 else 10
    return (page - 1) * size, size


def page(df: DataFrame, by: str, number: int | None = None, size: int | None = None, key: str = "id", descending: bool = True) -> DataFrame:
    offset, limit = page_bounds(number, size)
    return df.orderBy(F.col(by).desc() if descending else F.col(by).asc(), F.col(key).asc()).offset(offset).limit(limit)


def lookup(df: DataFrame, value, key: str = "id") -> DataFrame:
    """The row with this key; LookupError if there is none."""
    found = df.filter(F.col(key) == value)
    if found.isEmpty():
        raise LookupError(f"no row with {key} = {value!r}")
    return found


def accepted(df: DataFrame, name: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """Rows whose file type may be uploaded (in lower case, as written), and the others."""
    kind = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return df.filter(kind.isin(*ALLOWED)), df.filter(~F.coalesce(kind, F.lit("")).isin(*ALLOWED))


def status_metrics(df: DataFrame) -> DataFrame:
    """One row of counts: zeros for an empty registry."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def status_distribution(df: DataFrame) -> DataFrame:
    """A row for each status, also for those that no document has."""
    known = df.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return known.join(df.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def statistics(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Total and average sizes and segments over all documents."""
    per = segments.groupBy("document_id").agg(F.count("*").alias("segments"))
    both = df.join(per, df["id"] == per["document_id"], "left").withColumn("segments", F.coalesce("segments", F.lit(0)))
    return both.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.avg("file_size"), F.lit(0.0)).alias("average_size"),
        F.coalesce(F.sum("segments"), F.lit(0)).alias("total_segments"),
        F.coalesce(F.avg("segments"), F.lit(0.0)).alias("average_segments"),
    )


def processing_times(df: DataFrame) -> DataFrame:
    """Least, greatest and mean seconds from upload to the last change of completed documents; 0 without any."""
    seconds = F.greatest((F.unix_micros("updated_at") - F.unix_micros("uploaded_at")) / 1e6, F.lit(0.0))
    done = df.filter("status = 'completed'").select(seconds.alias("s"))
    return done.agg(*(F.coalesce(f("s"), F.lit(0.0)).alias(n) for n, f in (("min_seconds", F.min), ("max_seconds", F.max), ("avg_seconds", F.avg))))


def latest(df: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """The newest row of each key, by one aggregate without a window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(by, tie)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def with_latest_task(df: DataFrame, tasks: DataFrame, id_column: str = "id") -> DataFrame:
    newest = latest(tasks, "document_id", "ts", "event_id").select("document_id", "task_id", F.col("status").alias("task_status"), F.col("ts").alias("task_ts"))
    return df.join(newest, df[id_column] == newest["document_id"], "left").drop("document_id")


def without(df: DataFrame, gone: DataFrame, key: str, other: str = "id") -> DataFrame:
    """The rows whose key is not among the deleted ids; rows without a key stay."""
    return df.join(gone.select(F.col(other).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")


def delete_documents(gone: DataFrame, documents: DataFrame, segments: DataFrame, chunks: DataFrame, tasks: DataFrame) -> dict[str, DataFrame]:
    """All tables without the deleted documents."""
    return {
        "documents": without(documents, gone, "id"),
        "segments": without(segments, gone, "document_id"),
        "chunks": without(chunks, gone, "file_id"),
        "tasks": without(tasks, gone, "document_id"),
    }


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both; of a key that both have, the new one.  `new` has each key once."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def update(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The rows with the columns of `changes` where these are not null; keys that are not there change nothing."""
    names = [c for c in changes.columns if c != key]
    renamed = changes.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in names))
    both = df.join(renamed, key, "left")
    return both.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns))


def unknown_keys(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes to rows that are not there, which a caller treats as errors."""
    return changes.join(df.select(key), key, "left_anti")


def set_status(df: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Applies (id, new_status, new_error, new_progress): processed_at when terminal, progress within 0 and 100."""
    both = df.join(changes, "id", "left")
    changed = F.col("new_status").isNotNull()
    return both.select(
        "id",
        F.coalesce("new_status", "status").alias("status"),
        F.when(changed, F.coalesce("new_error", F.lit(""))).alias("error"),
        F.when(F.col("new_status").isin("completed", "failed"), now).alias("processed_at"),
        F.when(F.col("new_progress").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.col("new_progress")))).alias("progress"),
    )


def allowed_change(old: Column, new: Column) -> Column:
    """Whether a document may go from one status to another."""
    ok = F.lit(False)
    for a, targets in TRANSITIONS.items():
        for b in targets:
            ok = ok | ((old == a) & (new == b))
    return ok


def union_metadata(a: Column, b: Column) -> Column:
    """Both maps; of a key that both have, the later value."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
