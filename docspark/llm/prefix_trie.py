"""The trie of conversations that begin alike, without shuffling what nobody shares.

A node is a sequence of turns with which one or more conversations begin.  Each
turn has a digest, and a prefix has the exclusive or of the digests of its turns
with their places, which running windows over blocks of turns give for
conversations of any length.  A count-min sketch counts all prefixes; its
counters stop at two, as only one or more than one matters.  An estimate of
one proves that a prefix is a conversation's own; all that follows such a prefix
is its own too and becomes nodes where it is.  Only prefixes whose parent may be
shared are shuffled and grouped exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm.frames import stored

#: Turns of a conversation that one window looks at; totals of such blocks are added up before.
BLOCK_TURNS = 65_536
#: Rows of the sketch and the bits of its width: four counters a prefix, within these bounds.
SKETCH_ROWS, LEAST_BITS, MOST_BITS = 4, 16, 24
#: Counters that are shuffled as one row.
CHUNK = 1 << 16
#: Ids of ending conversations that are joined to one text before they are hashed.
IDS_TOGETHER = 10_000
EMPTY = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, keys: list[str], place: str, values: dict[str, Column], total: str) -> DataFrame:
    """Adds columns by name: the aggregate `total` (sum or bit_xor) of each value over rows of the same keys with a lower place.

    `place` is an integer from 0 on, without repeats within the keys.  Each
    window looks at one block of BLOCK_TURNS places, and windows over blocks see a
    row a block, so that no key is one task's alone.
    """
    add = getattr(F, total)
    plus = (lambda a, b: a.bitwiseXOR(b)) if total == "bit_xor" else (lambda a, b: a + b)
    rows = df.withColumn("_block", F.floor(F.col(place) / BLOCK_TURNS)).withColumns({f"_{n}": v for n, v in values.items()})
    before = rows.groupBy(*keys, "_block").agg(*(add(f"_{n}").alias(n) for n in values))
    order = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # Few conversations have a second block; only its rows need what came before them.
    later = before.select(*keys, "_block", *(add(n).over(order).alias(f"_before_{n}") for n in values)).filter("_block > 0")
    own = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.repartition(*keys, "_block").withColumns({n: F.coalesce(add(f"_{n}").over(own), F.lit(0)) for n in values})
    rows = rows.join(later, [*keys, "_block"], "left").withColumns({n: plus(F.col(n), F.coalesce(f"_before_{n}", F.lit(0))) for n in values})
    return rows.drop("_block", *(f"{x}{n}" for n in values for x in ("_", "_before_")))


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, at, digest, words): the turns in order; `at` ascends in a part, and parts follow each other.

    Only digests are shuffled, not texts.  A conversation may lie in several parts.
    """
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words")).filter("conv_id IS NOT NULL")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return stored(rows.select("conv_id", F.shiftright("at", 33).alias("part"), "at", "digest", "words"), "turns")


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are replaced by those of the first conversation of their group.

    Of conversation c the first h turns (h: crc32 of its decimal id, modulo
    `most`) become the first h turns of conversation c - c % group, or all if it has
    fewer.  Gives the turns (conv_id, place from 0 on, digest, words, last) and
    the conversations (conv_id, n_turns).

    Null roles and texts are empty; turns of the same number stand in the order of
    their digests, null numbers first; repeated rows are turns each; rows without a
    conv_id belong to no conversation; other columns are ignored.
    """
    turns = _turns(conversations)
    by_part = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = parts.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("n"))
    parts = stored(parts, "parts")
    convs = parts.filter("before = 0").select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h")
    )
    bases = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = convs.withColumn("n_turns", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    places = parts.drop("n").join(convs.select("conv_id", "h", "k", "n_turns"), "conv_id")
    placed = turns.join(places, ["conv_id", "part"]).withColumn("p", F.col("before") + F.col("at") - F.col("first"))
    own = placed.filter("p >= h").select("conv_id", (F.col("p") - F.col("h") + F.col("k")).alias("place"), "digest", "words", "n_turns")
    heads = placed.filter((F.col("conv_id") % group == 0) & (F.col("p") < most)).select(F.col("conv_id").alias("base"), F.col("p").alias("place"), "digest", "words")
    taken = convs.join(heads, "base").filter("place < h").select("conv_id", "place", "digest", "words", "n_turns")
    last = (F.col("place") + 1 == F.col("n_turns")).alias("last")
    return own.unionByName(taken).select("conv_id", "place", "digest", "words", last), convs.select("conv_id", "n_turns")


class Sketch:
    """Which counters of a count-min sketch are two or more, a bit each; an estimate is the least counter of its key."""

    def __init__(self, bits: int, two: np.ndarray):
        self.bits, self.two = bits, two

    @staticmethod
    def cells(bits: int, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """A counter in each row of the sketch for keys of two 64-bit integers."""
        a, b = a.view(np.uint64), b.view(np.uint64) | np.uint64(1)
        return [(((a + np.uint64(r) * b) >> np.uint64(64 - bits)) + np.uint64(r << bits)).astype(np.int64) for r in range(SKETCH_ROWS)]

    def alone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Keys that were certainly counted once at most."""
        out = np.zeros(len(a), bool)
        for cell in self.cells(self.bits, a, b):
            out |= (self.two[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 0
        return out


def sketched(rows: DataFrame, a: str, b: str, bits: int) -> Sketch:
    """The sketch of all keys (a, b): each task counts its own, equal parts of the tasks' counters are added up together.

    What reaches the driver is SKETCH_ROWS * 2^bits bits, whatever the input.
    """
    size = SKETCH_ROWS << bits
    chunk = min(CHUNK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros((2, size), bool)
        for batch in batches:
            for cell in Sketch.cells(bits, batch.column(0).to_numpy(), batch.column(1).to_numpy()):
                cell = np.sort(cell)
                two[cell[1:][cell[1:] == cell[:-1]]] = True
                two[cell[one[cell]]] = True
                one[cell] = True
        used = np.flatnonzero(one.reshape(-1, chunk).any(1))
        for k in range(0, len(used), 64):
            some = used[k : k + 64]
            planes = [[np.packbits(x.reshape(-1, chunk)[i], bitorder="little").tobytes() for i in some] for x in (one, two)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(p, pa.binary()) for p in planes)], names=["chunk", "one", "two"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, *planes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = (np.frombuffer(p, np.uint8) for p in planes)
                if i not in held:
                    held[i] = np.stack([one, two])
                else:
                    held[i][1] |= two | (held[i][0] & one)
                    held[i][0] |= one
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([x[1].tobytes() for x in held.values()], pa.binary())], names=["chunk", "two"])

    parts = rows.select(a, b).mapInArrow(count, "chunk bigint, one binary, two binary")
    two = np.zeros(size // 8, np.uint8)
    for r in parts.repartition("chunk").mapInArrow(merge, "chunk bigint, two binary").collect():
        two[r["chunk"] * chunk // 8 :][: chunk // 8] = np.frombuffer(r["two"], np.uint8)
    return Sketch(bits, two)


def _ends(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, ends_sha256): the hash of the ascending ids that stand with each key, comma-joined.

    Ids are joined to texts of IDS_TOGETHER by range, so that a key with many is
    joined by many tasks; only their texts meet, and are hashed as they pass.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            new = np.any([x[1:] != x[:-1] for x in columns[:-1]], axis=0)
            cuts = np.union1d(np.flatnonzero(new) + 1, np.arange(0, b.num_rows, IDS_TOGETHER)) if b.num_rows else np.zeros(0, np.int64)
            ids = columns[-1].tolist()
            texts = [",".join(map(str, ids[i:j])) for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[cuts], pa.int64()) for x in columns), pa.array(texts, pa.string())], names=[*b.schema.names, "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done: list[tuple] = []
            for *k, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != now:
                    if state:
                        done.append((*now, state.hexdigest()))
                    now, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _rows(done)
        if state:
            yield _rows([(*now, state.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * (len(key) + 1)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], names=[*key, "ends_sha256"])

    kinds = ", ".join(f"{k} bigint" for k in key)
    dealt = rows.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    texts = dealt.mapInArrow(join, f"{kinds}, conv_id bigint, ids string").repartition(*key).sortWithinPartitions(*key, "conv_id")
    return texts.mapInArrow(digest, f"{kinds}, ends_sha256 string")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(turns: DataFrame, conversations: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The nodes of the trie of all conversations, from what `rebuilt` gives.

    A row for each node: its smallest member, depth, its parent's smallest
    member, members, children, childless nodes below (itself included), tokens that
    storing each node once saves below it, and the hash of the members that end in it.
    The root has depth 0 and no parent; without conversations there is no node.
    Conversations without turns end in the root.  Nodes are told apart by 128
    bits.  The width of the sketch follows the number of turns up to 2^most_bits (most_bits: 3 or more);
    beyond, it proves less and more is grouped exactly.
    """
    place = F.col("place") + 1
    values = {f"p{i}": F.xxhash64(F.lit(i), "digest", place) for i in (1, 2)}
    rows = running(turns, ["conv_id"], "place", values, "bit_xor")
    rows = rows.select("conv_id", place.alias("depth"), *(F.col(n).bitwiseXOR(v).alias(f"k{n[1]}") for n, v in values.items()), "p1", "p2", "words", "last")
    rows = stored(rows, "prefixes")
    bits = min(most_bits, max(LEAST_BITS, int(4 * rows.count()).bit_length()))
    sent = turns.sparkSession.sparkContext.broadcast(sketched(rows, "k1", "k2", bits))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda n: b.column(b.schema.get_field_index(n)).to_numpy()
            alone = sent.value.alone(column("p1"), column("p2")) & (column("depth") > 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(alone)], names=[*b.schema.names, "alone"])

    marked = rows.mapInArrow(mark, "conv_id bigint, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, words bigint, last boolean, alone boolean")
    sha = F.sha2(F.col("conv_id").cast("string"), 256)
    own_ends = F.when(F.col("last"), sha).otherwise(EMPTY).alias("ends_sha256")
    single = [F.lit(1).cast("bigint").alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), own_ends]
    tails = marked.filter("alone").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *single)

    zero = F.lit(0).cast("bigint")
    roots = conversations.select("conv_id", zero.alias("depth"), *(zero.alias(n) for n in ("k1", "k2", "p1", "p2", "words")), (F.col("n_turns") == 0).alias("last"))
    some = stored(marked.filter("NOT alone").drop("alone").unionByName(roots), "perhaps_shared")
    key, parent = ["k1", "k2", "depth"], ["p1", "p2", "up"]
    nodes = some.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("last").alias("last"))
    nodes = stored(nodes.withColumn("up", F.col("depth") - 1), "nodes")
    shared = nodes.filter("n_convs > 1")
    tops = shared.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("up"), F.col("conv_id").alias("above"))
    # A parent that isn't shared is the node's own conversation's.
    nodes = stored(nodes.join(tops, parent, "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))), "nodes")
    singles = nodes.filter("n_convs = 1")
    children = nodes.filter("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children")).withColumnsRenamed(dict(zip(parent, key, strict=True)))
    shared = stored(nodes.filter("n_convs > 1").join(children, key, "left").fillna(0, ["n_children"]).drop("p1", "p2", "up", "above"), "shared")

    # Each childless node and each node's saving belong to one conversation; a node sums up its members'.
    saved = (F.col("n_convs") - 1) * F.col("words")
    leaves = singles.filter("above IS NOT NULL").select("conv_id").unionByName(shared.filter("n_children = 0").select("conv_id"))
    gives = leaves.select("conv_id", F.lit(1).alias("leaf"), zero.alias("saved")).unionByName(shared.select("conv_id", F.lit(0).alias("leaf"), saved.alias("saved")))
    gives = gives.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).filter("leaf > 0 OR saved > 0")
    sums = some.select(*key, "conv_id").join(gives, "conv_id").groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved"))
    # What its smallest member saves above a node is not below it.
    shared = running(shared, ["conv_id"], "depth", {"above": saved}, "sum")
    shared = shared.join(sums, key).join(_ends(some.filter("last"), key), key, "left")
    shared = shared.withColumn("saved_tokens", F.col("saved") - F.col("above")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return tails.unionByName(singles.select("conv_id", "depth", "parent_conv_id", *single)).unionByName(shared.select(*COLUMNS))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: CRC-32 of a decimal number, by its bits (a fixed rule).
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""

OP12_SQL = rf"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
told AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS g, len(regexp_extract_all(text, '[^ 	-
]+')) AS w FROM given),
t AS (SELECT conv_id, g, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS p FROM told),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, n, xor({_CRC.format(x="conv_id::VARCHAR")}, 4294967295) % 4 AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, t.p AS d, t.g, t.w FROM k JOIN t ON t.conv_id = k.base AND t.p <= k.h
      UNION ALL SELECT k.conv_id, k.k + t.p - k.h, t.g, t.w FROM k JOIN t ON t.conv_id = k.conv_id AND t.p > k.h),
s AS (SELECT conv_id, d, w, md5(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d)) AS id FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM k),
m AS (SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS last FROM s),
n AS (SELECT d, id, min(conv_id) AS conv_id, any_value(up) AS up, any_value(w) AS w, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last) AS ends FROM m GROUP BY d, id),
f AS (SELECT n.*, p.conv_id AS parent, (SELECT count(*) FROM n AS q WHERE q.d = n.d + 1 AND q.up = n.id) AS children FROM n LEFT JOIN n AS p ON p.d = n.d - 1 AND p.id = n.up),
below AS (SELECT s.d, s.id, sum((f.n - 1) * f.w) AS saved, count(*) FILTER (f.children = 0) AS leaves FROM f JOIN s ON s.conv_id = f.conv_id AND s.d <= f.d GROUP BY s.d, s.id)
SELECT f.conv_id, f.d::BIGINT AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.children AS n_children, below.leaves AS n_leaves,
       below.saved::BIGINT AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN below USING (d, id)"""
