"""Document fingerprints: SimHash, and permuted block tables for near ones.

Each term (a run of five words) has a hash of 128 bits; its weight, the bytes
of its words, votes for each bit that is set and against each that is not, and
the sign of the sum is the fingerprint's bit.  Texts with fewer words are one
term.

To find all fingerprints within a Hamming radius r, the bits are cut into b > r
blocks.  Two fingerprints within the radius agree on at least b - r blocks, so a
table for every choice of b - r blocks, joined on their bits, meets every pair;
a pair counts only in the first table where it meets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.frames import add_columns
from docspark.llm.words import LOWER, WHITE, Hasher, inside, mix, slices, split, utf8

BITS = 128
WORDS = 5
RADIUS = 4
BLOCKS = 6
HASHER = Hasher(3)
#: The eight bits of each byte value.
OCTETS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def fingerprints(texts: pa.Array, n: int = WORDS) -> np.ndarray:
    """A row of 16 bytes for each text; without words all bits are 0."""
    data, offsets = utf8(texts)
    w = split(LOWER[data], offsets, WHITE)
    hashes = HASHER.ranges(w.data, w.starts, w.ends)
    length = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    at = inside(w.first, n)
    terms, doc, weight = HASHER.grams(hashes, n)[at], np.searchsorted(w.first, at, "right") - 1, length[at + n] - length[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        whole = [HASHER.grams(hashes[a:b], b - a)[0] for a, b in zip(w.first[short].tolist(), w.first[short + 1].tolist(), strict=True)]
        terms, doc = np.concatenate([terms, np.array(whole, np.uint64)]), np.concatenate([doc, short])
        weight = np.concatenate([weight, length[w.first[short + 1]] - length[w.first[short]]])
    octets = np.stack([terms, mix(terms + np.uint64(0x9E3779B97F4A7C15))], 1).astype("<u8").view(np.uint8)
    k, rows = len(texts), doc * 256
    weight = weight.astype(np.float64)
    total = np.bincount(doc, weight, k)[:, None]
    votes = [np.bincount(rows + octets[:, j], weight, k * 256).reshape(k, 256) @ OCTETS for j in range(BITS // 8)] if k else []
    return np.packbits(np.stack([2 * v > total for v in votes], 1).reshape(k, BITS), axis=1) if k else np.zeros((0, BITS // 8), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits of rows of fingerprints."""
    return 1 - np.bitwise_count(a ^ b).sum(1) / BITS


def add_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the column fingerprint (32 hex digits); null and empty texts get zeros, equal texts equal ones."""

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([x.tobytes().hex() for x in fingerprints(part.column(part.schema.get_field_index(text)))], pa.string())]

    return add_columns(docs, text, "fingerprint string", make)


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """First hex digit (from 1) and number of hex digits of each block."""
    cuts = [round(BITS // 4 * k / blocks) for k in range(blocks + 1)]
    return [(a + 1, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def find_within(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fingerprint, other, distance): all fingerprints of `corpus` within the radius of those of `queries`.

    Both frames have a column fingerprint; equal ones are looked up once, so
    that groups of copies cost one row.  Null fingerprints are left out; a
    fingerprint of both frames finds itself at distance 0.
    """
    if not 0 <= radius < blocks:
        raise ValueError("there must be more blocks than the radius has bits")
    parts = _blocks(blocks)
    tables = list(combinations(range(blocks), blocks - radius))
    keys = F.array(*(F.concat(F.lit(f"{k}:"), *(F.substring("fingerprint", *parts[b]) for b in blocks_)) for k, blocks_ in enumerate(tables)))

    def halves(name: str) -> list:
        number = lambda a: F.conv(F.substring(name, a, 8), 16, 10).cast("bigint")
        return [number(1 + 8 * k) for k in range(BITS // 32)]

    def spread(df: DataFrame, name: str) -> DataFrame:
        one = df.select("fingerprint").filter("fingerprint is not null").distinct()
        one = one.select(F.col("fingerprint").alias(name), F.array(*halves("fingerprint")).alias(f"{name}_bits"), keys.alias(f"{name}_keys"))
        return one.select("*", F.posexplode(f"{name}_keys").alias(f"{name}_table", "key"))

    a, b = spread(queries, "fingerprint"), spread(corpus, "other")
    distance = sum((F.bit_count(F.col("fingerprint_bits")[k].bitwiseXOR(F.col("other_bits")[k])) for k in range(BITS // 32)), F.lit(0))
    first = F.array_position(F.zip_with("fingerprint_keys", "other_keys", lambda x, y: x == y), F.lit(True)) - 1
    return a.join(b, (a["key"] == b["key"]) & (distance <= radius) & (first == F.col("fingerprint_table"))).select("fingerprint", "other", distance.alias("distance"))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(part, tail, doc_id, text) in ascending order of doc_id, partitioned by part.

    Each part ends with a row of tail = 1: the first document of the next part
    that has any (after the last part: of the first).  Only the bounds of the
    parts and the ids of their first documents pass through the driver.
    """
    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    probes = [k / parts for k in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("doc_id", probes, 10_000).alias("b")).first()["b"] if probes else []
    bounds = sorted(set(bounds or []))
    ids = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(ids, lambda b: b < F.col("doc_id"))))
    placed = rows.withColumns({"part": part, "tie": tie})
    found = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("one")).collect()
    firsts = sorted((r["part"], r["one"]["doc_id"], r["one"]["tie"]) for r in found)
    ahead = [(firsts[k - 1][0], doc_id, tie) for k, (_, doc_id, tie) in enumerate(firsts)]  # the one before, around the end
    ahead = docs.sparkSession.createDataFrame(ahead, "part int, first_id bigint, first_tie bigint")
    wanted = placed.filter(F.col("doc_id").isin([d for _, d, _ in firsts if d is not None]) | F.col("doc_id").isNull())
    # At most one row for each part: bounded by the number of partitions.
    tails = wanted.drop("part").join(F.broadcast(ahead), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
    tails = tails.groupBy("part").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tie").alias("tie"))
    both = placed.select("part", F.lit(0).alias("tail"), "doc_id", "text", "tie").unionByName(tails.select("part", F.lit(1).alias("tail"), "doc_id", "text", "tie"))
    return both.repartitionById(parts, "part").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_first(), "tie").drop("tie")


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much from the beginning of the next one."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def compare_with_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document's in ascending order of doc_id,
    after the last one the first.  Null ids come first, rows of equal ids stand
    in an order fixed by their texts, a null text is empty, a single document
    follows itself, and an empty table gives an empty result.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(ids: list, texts: list[str]) -> pa.RecordBatch:
        """For all texts but the last."""
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        fp, other = fingerprints(pa.array(texts, pa.large_string())), fingerprints(pa.array(changed, pa.large_string()))
        hexed = lambda x: pa.array([r.tobytes().hex() for r in x], pa.string())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(x) for x in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                hexed(fp[:-1]), hexed(other), pa.array(likeness(fp[:-1], other)), pa.array(likeness(fp[:-1], fp[1:])),
            ],
            names=[x.split()[0] for x in schema.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        at = tail = None
        for batch in batches:
            for piece in slices(batch, "text"):
                for part, is_tail, doc_id, text in zip(*(piece.column(k).to_pylist() for k in range(4)), strict=True):
                    if part != at or tail:  # another part begins; the last text was the tail of the one before
                        if len(texts) > 1:
                            yield compare(ids[: len(texts) - 1], texts)
                        ids, texts, at = [], [], part
                    tail = is_tail
                    ids.append(doc_id)
                    texts.append(text or "")
                if len(texts) > 1:
                    yield compare(ids[:-1], texts)
                    ids, texts = ids[-1:], texts[-1:]

    return with_next(docs, parts).mapInArrow(run, schema)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
