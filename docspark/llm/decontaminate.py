"""Benchmark decontamination: broadcast hash set of test n-grams, scanned over all documents.

Texts are normalised to lower-case alphanumeric words.  The n-grams of the
benchmark are a table whose size is counted first; it is broadcast in blocks of
at most `max_windows` n-grams, and each block is one narrow pass over the
documents, which carries the hits along.  A hash hit counts only after its
words have been compared.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.frames import add_columns, set_aside
from docspark.llm.words import Hasher, alnum_words, mix, slices

#: A window of the benchmark takes about 200 bytes, so that a block is at most 100 MB.
MAX_WINDOWS = 500_000
SEED = 10
FILTER_BITS = 20


def benchmark_windows(items: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """(key, size, words, items): every distinct window of the benchmark, its words joined by spaces, and the items that have it."""
    hasher = Hasher(SEED)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                w = alnum_words(part.column(1))
                names = part.column(0).to_pylist()
                hashes = hasher.ranges(w.data, w.starts, w.ends)
                rows: list[tuple] = []
                for k, m in enumerate(w.counts):
                    size, i = min(n, int(m)), int(w.first[k])
                    words = w.text(i, i + int(m))
                    keys = hasher.grams(hashes[i : i + int(m)], size).astype(np.int64) if size else []
                    rows += [(int(key), size, b" ".join(words[j : j + size]), names[k] or "") for j, key in enumerate(keys)]
                cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "size", "words", "item"])

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias(text))
    found = rows.mapInArrow(cut, "key bigint, size int, words binary, item string")
    return found.groupBy("key", "size", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _scan(rows: list, hasher: Hasher):
    """A function of a batch with text, hits and items that adds this block's hits."""
    by_size: dict[int, dict[int, list[tuple[bytes, list[str]]]]] = defaultdict(lambda: defaultdict(list))
    for key, size, words, items in rows:
        by_size[size][key & (2**64 - 1)].append((bytes(words), items))
    sizes = {}
    for size, table in by_size.items():
        keys = np.sort(np.array(list(table), np.uint64))
        near = np.zeros(1 << FILTER_BITS, bool)
        near[keys & np.uint64((1 << FILTER_BITS) - 1)] = True
        sizes[size] = (keys, near, table)
    top = max(sizes, default=0)
    low = np.uint64((1 << FILTER_BITS) - 1)

    def scan(texts: pa.Array) -> tuple[np.ndarray, list[tuple[int, int, list[str]]]]:
        w = alnum_words(texts)
        hits: list[tuple[int, int, list[str]]] = []
        if len(w.starts):
            words = hasher.ranges(w.data, w.starts, w.ends)
            end = w.first[1:]
            run = words.copy()
            for size in range(1, min(top, len(words)) + 1):
                m = len(words) - size + 1
                if size > 1:  # as in Hasher.grams, a word more each time
                    run = run[:m] * hasher.step + words[size - 1 :]
                if size not in sizes:
                    continue
                keys, near, table = sizes[size]
                grams = mix(run)
                at = np.flatnonzero(near[grams & low])
                at = at[keys[np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)] == grams[at]]
                at = at[at + size <= end[np.searchsorted(end, at, "right")]]  # within one document
                for i in at.tolist():
                    said = b" ".join(w.text(i, i + size))
                    hits += [(i, size, items) for text, items in table[int(grams[i])] if text == said]
        return w.first, hits

    return scan


def mark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = 13, item_id: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS
) -> DataFrame:
    """Adds n_words, hit_words (covered word positions as start, end, start, end ...) and hit_items to each document.

    A window is n consecutive words of an item, or all words of an item that has
    fewer.  A word is hit if it lies inside an occurrence of a window.

    Null or empty texts have no words and no hits; items without words have no
    windows; an item with a null id is named by the empty string; repeated items
    and documents count each for itself; an empty benchmark hits nothing.
    Columns of `docs` with the three names are replaced.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, n, item_id, item_text)
    count = windows.count()
    blocks = max(1, -(-count // max_windows))
    hasher = Hasher(SEED)
    out = docs
    for block in range(blocks):
        rows = [tuple(r) for r in windows.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect()]
        sent = spark.sparkContext.broadcast(rows)
        first_pass = block == 0
        cache: dict = {}

        def make(part: pa.RecordBatch, sent=sent, first_pass=first_pass, cache=cache) -> list[pa.Array]:
            if "scan" not in cache:
                cache["scan"] = _scan(sent.value, hasher)
            first, hits = cache["scan"](part.column(part.schema.get_field_index(text)))
            size = part.num_rows
            held = [[] for _ in range(size)] if first_pass else [list(x) for x in part.column(part.schema.get_field_index("hit_words")).to_pylist()]
            names = [set() for _ in range(size)] if first_pass else [set(x) for x in part.column(part.schema.get_field_index("hit_items")).to_pylist()]
            touched = set()
            for i, width, items in hits:
                k = int(np.searchsorted(first, i, "right")) - 1
                held[k] += (i - int(first[k]), i - int(first[k]) + width)
                names[k].update(items)
                touched.add(k)
            for k in touched:
                held[k] = _union(held[k])
            return [pa.array(np.diff(first), pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]

        if first_pass:
            out = add_columns(out, text, "n_words bigint, hit_words array<int>, hit_items array<string>", make)
        else:
            out = _again(out, text, make)
    return out


def _again(df: DataFrame, text: str, make) -> DataFrame:
    """A further block's pass: the same columns with more hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = dict(zip(("n_words", "hit_words", "hit_items"), make(part), strict=True))
                yield pa.RecordBatch.from_arrays([made.get(n, part.column(i)) for i, n in enumerate(part.schema.names)], names=part.schema.names)

    return df.mapInArrow(run, df.schema)


#: Columns that mark() and judge() add.
MADE = ("n_words", "hit_words", "hit_items", "n_hit", "contaminated")


def _union(flat: list[int]) -> list[int]:
    """Intervals [start, end, start, end ...] as disjoint ones in order."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def judge(marked: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit and contaminated (a hit, and at least one word in `share` is hit) to what mark() returns."""
    n_hit = F.expr("aggregate(hit_words, 0L, (s, x) -> x - s)")  # end - (start - (end - ... )): the alternating sum
    hit = marked.withColumn("n_hit", n_hit)
    return hit.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """The documents without contaminated ones (`remove="documents"`), or with the hit words cut out (`"spans"`).

    The columns stay those of `docs`, also those named as what is computed here.
    Null and empty texts stay as they are, as does everything if the benchmark is
    empty; repeated rows are judged each.  Cutting keeps the text outside the hit
    words as it is; a document that is all hit becomes empty.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    held, back = set_aside(docs, MADE)
    text = next((n for n, c in back.items() if c == text), text)
    marked = mark(held, benchmark, text, **options)
    if remove == "documents":
        return judge(marked).filter("not contaminated").select([F.col(f"`{c}`") for c in held.columns]).withColumnsRenamed(back)

    def cut(part: pa.RecordBatch) -> list[pa.Array]:
        texts = part.column(part.schema.get_field_index(text))
        w, out = alnum_words(texts), texts.to_pylist()
        for k, flat in enumerate(part.column(part.schema.get_field_index("hit_words")).to_pylist()):
            if flat:
                raw, i = out[k].encode(), int(w.first[k])
                begin = int(w.starts[i]) - _before(raw)
                left, pieces = 0, []
                for a, b in zip(flat[::2], flat[1::2], strict=True):
                    pieces.append(raw[left : int(w.starts[i + a]) - begin])
                    left = int(w.ends[i + b - 1]) - begin
                out[k] = b"".join([*pieces, raw[left:]]).decode()
        return [pa.array(out, pa.string())]

    return add_columns(marked, text, f"`{text}` string", cut).select([F.col(f"`{c}`") for c in held.columns]).withColumnsRenamed(back)


def _before(raw: bytes) -> int:
    """Bytes before the first word of a text."""
    return int(alnum_words(pa.array([raw.decode()])).starts[0])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = judge(mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS said
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS said
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
),
hits AS (SELECT rid, i, dw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.said = bw.said),
hit_words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT rid, i, size FROM hits)) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""
