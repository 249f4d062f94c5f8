"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

A shingle is five lower-cased words; a text with fewer words is one shingle.  Its
weight is (1 + ln tf) * idf, where the idf of a shingle is the mean of its words',
1 + IDF_SHARE * ln(N / df) / ln(N): document frequencies over all documents.  The
share is small, so that in a group of thousands of copies, whose words are in so
many documents, what the copies share still outweighs what they don't.

Each of the samples takes for every shingle of weight S the parameters r and c
(Gamma(2, 1)) and beta (uniform) that three parts of the shingle's hash select in
three tables,
t = floor(ln S / r + beta), and keeps the (shingle, t) of least
ln c - r (t - beta) - r.  Two texts agree in a sample with a probability of their
weighted Jaccard similarity.  Bands of samples are the keys under which documents
meet; every link is verified by the weighted Jaccard similarity of the shingles.

Within a band key no pairs are listed.  A band is led by the member that shares most
band keys with others (in a group of edits of one text, that text), and all members
of a leader's bands form one group.  A group is dealt by hash into cells of bounded
size.  Inside a cell, members are compared with all others at once, the leader first,
until those that have not been compared with all are known to be connected; pairs
of cells follow for groups that are still not one component.  So no link between
components is lost, a cell's memory is bounded, and only a spanning forest of links
leaves it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.blocks import KEYS, cuts, distinct, each_block, messages, pack, unpack
from docspark.llm.components import components
from docspark.llm.frames import stored
from docspark.llm.words import Hasher, alnum_words, inside, mix, utf8

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^4)^16 = 0.9998.
BANDS, ROWS = 16, 4
IDF_SHARE = 0.25
TABLE_BITS = 13
#: Bytes of shingles and weights in a cell of a group.
CELL_BYTES = 4_000_000
#: Shingles whose samples are drawn together.
TOGETHER = 8192
#: Bytes of sets that leave a block together.
SENT_BYTES = 4_000_000
#: A set on its way to a pair of cells (i = j: within one), from the first of them (side 0) or the second.
SET_SCHEMA = "leader bigint, i int, j int, side int, ref bigint, label bigint, set binary"
SET_NAMES = [x.split()[0] for x in SET_SCHEMA.split(", ")]
SET_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
HASHER = Hasher(9)


def sample_table(samples: int, bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, beta and ln c for each slot of a shingle's hash and each sample; each has a slot of its own."""
    rng = np.random.Generator(np.random.PCG64(909))
    shape = (1 << bits, samples)
    r = rng.gamma(2, 1, shape).astype(np.float32)
    return r, rng.random(shape, np.float32), np.log(rng.gamma(2, 1, shape)).astype(np.float32)


_TABLE: list = []


def signatures(shingles: np.ndarray, weights: np.ndarray, first: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """A row of hashes of (shingle, t) for each document; document k has shingles first[k]:first[k+1], none is empty."""
    if not _TABLE:
        _TABLE.append(sample_table(BANDS * ROWS))
    r, beta, ln_c = _TABLE[0]
    k = len(first) - 1
    best = np.full((k, samples), np.inf, np.float32)
    out = np.zeros((k, samples), np.uint64)
    ln_s = np.log(weights).astype(np.float32)[:, None]
    slots = [((shingles >> np.uint64(64 - (k + 1) * TABLE_BITS)) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64) for k in range(3)]
    columns = np.arange(samples)
    for a in range(0, len(shingles), TOGETHER):
        b = min(a + TOGETHER, len(shingles))
        rr, bb = r[slots[0][a:b]], beta[slots[1][a:b]]
        t = np.floor(ln_s[a:b] / rr + bb)
        score = ln_c[slots[2][a:b]] - rr * (t - bb + 1)
        d0, d1 = int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, b, "left"))
        cut = np.maximum(first[d0:d1] - a, 0)
        least = np.minimum.reduceat(score, cut, axis=0)
        size = np.diff(np.append(cut, b - a))
        hit = score == np.repeat(least, size, axis=0)
        i, j = np.nonzero(hit)
        doc = np.repeat(np.arange(d0, d1), size)[i]
        take = score[i, j] < best[doc, j]
        i, j, doc = i[take][::-1], j[take][::-1], doc[take][::-1]  # of equal scores the first counts
        out[doc, j] = mix(shingles[a + i] + mix(t[i, j].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + columns[j].astype(np.uint64)))
        best[doc, j] = score[i, j]
    return out


def band_keys(rows: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of a document's samples."""
    parts = rows.reshape(len(rows), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return key.view(np.int64)


def weighted(texts: pa.Array, idf=None, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, weights, first): the distinct shingles of each text in order of their hashes, and their weights.

    `idf` is a function of the hashes of all words; without it each is 1.
    """
    w = alnum_words(texts)
    hashes = HASHER.ranges(w.data, w.starts, w.ends)
    rare = np.ones(len(hashes)) if idf is None else idf(hashes)
    upto = np.concatenate([[0], np.cumsum(rare)])
    at = inside(w.first, n)
    shingles, doc, mean = HASHER.grams(hashes, n)[at], np.searchsorted(w.first, at, "right") - 1, (upto[at + n] - upto[at]) / n
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        a, b = w.first[short], w.first[short + 1]
        whole = [HASHER.grams(hashes[x:y], y - x)[0] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        shingles, doc = np.concatenate([shingles, np.array(whole, np.uint64)]), np.concatenate([doc, short])
        mean = np.concatenate([mean, (upto[b] - upto[a]) / (b - a)])
    order = np.lexsort((shingles, doc))
    shingles, doc, mean = shingles[order], doc[order], mean[order]
    new = np.ones(len(doc), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    one = np.flatnonzero(new)
    tf = np.diff(np.append(one, len(doc)))
    return shingles[one], (1 + np.log(tf)) * mean[one], np.searchsorted(doc[one], np.arange(len(texts) + 1))


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (ascending hashes, weights); 0 for two empty sets."""
    i = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both = b[0][i] == a[0]
    low = np.minimum(a[1][both], b[1][i[both]]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


@dataclass
class Members:
    """Weighted sets to be compared: shingles[first[k]:first[k+1]] and their weights are those of ref[k], of component label[k]."""

    ref: np.ndarray
    label: np.ndarray
    shingles: np.ndarray
    weights: np.ndarray
    first: np.ndarray

    def __post_init__(self):
        sums = np.concatenate([[0.0], np.cumsum(self.weights, dtype=np.float64)])
        self.total = np.diff(sums[self.first])
        order = np.argsort(self.shingles, kind="stable")
        self.sorted, self.by = self.shingles[order], self.weights[order]
        self.owner = np.repeat(np.arange(len(self.ref)), np.diff(self.first))[order]

    @classmethod
    def of(cls, rows: list[pa.RecordBatch]) -> Members:
        """Rows of (..., ref, label, set), a set being its hashes and then its weights."""
        table = pa.Table.from_batches(rows)
        said = [x.as_buffer() for x in table.column("set")]
        size = [x.size // 12 for x in said]
        shingles = [np.frombuffer(x, "<u8", n) for x, n in zip(said, size, strict=True)]
        weights = [np.frombuffer(x, "<f4", n, 8 * n) for x, n in zip(said, size, strict=True)]
        return cls(table.column("ref").to_numpy(), table.column("label").to_numpy(), np.concatenate(shingles), np.concatenate(weights), np.concatenate([[0], np.cumsum(size)]))

    def likeness(self, other: Members, k: int) -> np.ndarray:
        """The weighted Jaccard similarity of each member to the other's member k."""
        a, b = other.first[k], other.first[k + 1]
        low, high = np.searchsorted(self.sorted, other.shingles[a:b], "left"), np.searchsorted(self.sorted, other.shingles[a:b], "right")
        many = high - low
        upto = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(low - upto[:-1], many) + np.arange(upto[-1])
        common = np.bincount(self.owner[at], np.minimum(self.by[at], np.repeat(other.weights[a:b], many)), len(self.ref))
        return common / (self.total + other.total[k] - common)


def forest(sides: list[Members], similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) that connect whatever the similar pairs connect, given the components known.

    Of one side all pairs count, of two those across.  Members are compared with
    all others one after another, the first at first, until those left are of one
    component: each pair of two components has then been compared.
    """
    ref = np.concatenate([m.ref for m in sides])
    names, label = np.unique(np.concatenate([m.label for m in sides]), return_inverse=True)
    total, begin = np.concatenate([m.total for m in sides]), np.cumsum([0] + [len(m.ref) for m in sides])
    root, left, links = np.arange(len(names)), np.ones(len(ref), bool), []
    x = 0
    while True:
        now = root[label]
        waiting = np.flatnonzero(left)
        if links or not left.all() or len(sides) > 1:
            if not len(waiting):
                return links
            most = np.bincount(now[waiting]).argmax()
            apart = waiting[now[waiting] != most]
            if not len(apart):
                return links
            x = int(apart[0])
        left[x] = False
        side = 0 if x < begin[1] else 1
        other = (side + 1) % len(sides)
        span = slice(begin[other], begin[other + 1])
        open_pairs = (now[span] != now[x]) & (np.minimum(total[span], total[x]) >= similarity * np.maximum(total[span], total[x]) * (1 - 1e-6))
        if not open_pairs.any():
            continue
        near = np.flatnonzero(open_pairs & (sides[other].likeness(sides[side], x - begin[side]) >= similarity)) + begin[other]
        for one in near[np.unique(now[near], return_index=True)[1]].tolist():
            links.append((int(ref[x]), int(ref[one])))
            root[root == now[one]] = now[x]


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each run of equal values in the first `keys` columns."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        cut = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            key = columns[:, a].tolist()
            if held and key != current:
                yield held
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _digests(texts: pa.Array) -> list[bytes]:
    data, offsets = utf8(texts)
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _frequencies(blocks: DataFrame, column: int, parts: int) -> DataFrame:
    """(block, answers): for each distinct word of each block, 8 log2 of the documents that have it, as a byte."""

    def words(row: dict) -> Iterator[pa.RecordBatch]:
        w = alnum_words(unpack(row["rows"]).column(column))
        hashes = HASHER.ranges(w.data, w.starts, w.ends)
        keys, _, _, back = distinct(hashes, w.doc.astype(np.uint32))
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(first)
        count = np.diff(np.append(at, len(keys))).astype(np.uint32)
        yield messages(row["block"], parts, keys[at], count, np.zeros(len(at), bool))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            sizes = [len(r[2]) // 12 for r in rows]
            keys = np.concatenate([np.frombuffer(r[2], "<u8", n) for r, n in zip(rows, sizes, strict=True)])
            count = np.concatenate([np.frombuffer(r[2], "<u4", n, 8 * n) for r, n in zip(rows, sizes, strict=True)])
            _, back = np.unique(keys, return_inverse=True)
            total = np.bincount(back, count)[back]
            level = np.minimum(np.round(8 * np.log2(total)), 255).astype(np.uint8)
            at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            found = [level[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array(found, pa.binary())], names=["part", "block", "found"])

    answers = each_block(blocks, words, KEYS).repartitionById(parts, "part").mapInArrow(meet, "part int, block bigint, found binary")
    return answers.groupBy("block").agg(F.collect_list(F.struct("part", "found")).alias("answers"))


def _idf(answers: list[dict] | None, hashes: np.ndarray, documents: int, parts: int) -> np.ndarray:
    keys, back = np.unique(hashes, return_inverse=True)
    level, at = np.zeros(len(keys)), cuts(keys, parts)
    for x in answers or []:
        level[at[x["part"]] : at[x["part"] + 1]] = np.frombuffer(x["found"], np.uint8)
    return (1 + IDF_SHARE * np.clip(1 - level * (np.log(2) / 8) / np.log(max(documents, 2)), 0, 1))[back]


def classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, parts: int | None = None, keep_rows: bool = False, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(doc_id, class_id, kept): the class of near-duplicates of each document.

    The class is named by its least doc_id; `kept` is true for one document of
    each class, the one with that id (of several, the first by text and place).
    Equal texts are of one class.  Texts without any word are near nothing but
    their own copies; a null text counts as empty; null ids count as greater
    than all others; an empty table gives an empty result.  With `keep_rows` the
    kept documents themselves are returned, with all their columns.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = pack(docs, text)
    column, key_column = docs.columns.index(text), docs.columns.index(id_column)

    def copies(row: dict) -> Iterator[pa.RecordBatch]:
        batch = unpack(row["rows"])
        ref = (row["block"] << 16) + np.arange(batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(ref, pa.int64()), batch.column(key_column).cast(pa.int64()), pa.array(_digests(batch.column(column)), pa.binary())], names=["ref", "doc_id", "digest"])

    texts = stored(each_block(blocks, copies, "ref bigint, doc_id bigint, digest binary"), "texts", batch=8)
    documents = texts.count()
    # One document of each text stands for its copies.
    one = stored(texts.groupBy("digest").agg(F.min("ref").alias("ref"), F.min("doc_id").alias("least")), "one")
    chosen = one.select((F.shiftright("ref", 16)).alias("block"), F.expr("cast(ref & 65535 AS int)").alias("row"))
    lists = chosen.groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("chosen"))
    asked = stored(_frequencies(blocks, column, parts), "frequencies", batch=500)
    known = blocks.join(asked, "block", "left")

    def vectors(row: dict, name: str):
        some = np.array(sorted(row[name] or []), np.int64)
        texts = unpack(row["rows"]).column(column)
        # All texts of the block: its answers are for the words of all.
        shingles, weights, first = weighted(texts, lambda h: _idf(row["answers"], h, documents, parts))
        size = np.diff(first)[some]
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(first[some] - upto[:-1], size) + np.arange(upto[-1])
        return (row["block"] << 16) + some, shingles[at], weights[at], upto

    def bands(row: dict) -> Iterator[pa.RecordBatch]:
        ref, shingles, weights, first = vectors(row, "chosen")
        full = np.flatnonzero(np.diff(first))
        keys = band_keys(signatures(shingles, weights, np.append(first[full], first[-1]))) if len(full) else np.zeros((0, BANDS), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ref[full], BANDS), pa.int64()), pa.array(keys.ravel(), pa.int64()), pa.array(np.repeat(np.diff(first)[full], BANDS), pa.int32())], names=["ref", "band", "size"])

    placed = stored(each_block(known.join(lists, "block"), bands, "ref bigint, band bigint, size int"), "bands", batch=8)
    sizes = placed.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    met = stored(placed.join(sizes, "band"), "met")
    rank = met.groupBy("ref").agg(F.sum("members").alias("shared"))
    most = F.min(F.struct((-F.col("shared")).alias("s"), F.col("ref").alias("leader")))
    led = met.join(rank, "ref").groupBy("band").agg(most["leader"].alias("leader"), F.max("members").alias("members"))
    # A band of many members is dealt by parts of its members, so that no task gets them all.
    part = F.expr("cast(ceil(members / 1000) AS bigint)")
    led = led.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), part - 1))).select("band", "part", "leader")
    groups = met.withColumn("part", F.pmod(F.xxhash64("ref"), part)).join(led, ["band", "part"]).groupBy("leader", "ref").agg(F.max("size").alias("size"))
    groups = stored(groups, "groups")
    cells = groups.groupBy("leader").agg(F.ceil(F.sum("size") * 12 / F.lit(cell_bytes)).alias("cells")).filter("cells > 1")
    # Groups of one cell, which are nearly all, need not be counted out.
    dealt = groups.join(F.broadcast(cells) if cells.count() <= 100_000 else cells, "leader", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("ref"), F.col("cells")).cast("int"))

    def by_block(rows: DataFrame) -> DataFrame:
        wanted = rows.select(F.shiftright("ref", 16).alias("block"), F.expr("cast(ref & 65535 AS int)").alias("row"), "leader", "i", "j", "label")
        wanted = wanted.groupBy("block").agg(F.collect_list(F.struct("row", "leader", "i", "j", "label")).alias("wanted"))
        return known.join(wanted, "block")

    def sets(row: dict) -> Iterator[pa.RecordBatch]:
        row["rows_wanted"] = {w["row"] for w in row["wanted"]}
        ref, shingles, weights, first = vectors(row, "rows_wanted")
        said = {int(r): shingles[a:b].astype("<u8").tobytes() + weights[a:b].astype("<f4").tobytes() for r, a, b in zip(ref & 65535, first[:-1], first[1:], strict=True)}
        held, some = 0, []
        for w in row["wanted"]:
            for j in w["j"]:
                low, high = min(w["i"], j), max(w["i"], j)
                some.append((w["leader"], low, high, int(w["i"] > j), (row["block"] << 16) + w["row"], w["label"], said[w["row"]]))
                held += len(some[-1][-1])
                if held > SENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), SET_TYPES, strict=True)], names=SET_NAMES)
                    held, some = 0, []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), SET_TYPES, strict=True)], names=SET_NAMES)

    def linked(rows: DataFrame, name: str) -> DataFrame:
        """Links within the cells (i = j), or across the pairs of cells, of rows (leader, i, array of j, ref, label)."""

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some = []
            for cell in grouped(batches, 3):
                sides = [Members.of(x) for x in grouped(iter(cell), 4)]
                if cell[0].column(1)[0].as_py() == cell[0].column(2)[0].as_py() or len(sides) == 2:
                    some += forest(sides, similarity)
                if len(some) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=["a", "b"])
                    some = []
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=["a", "b"])

        sent = each_block(by_block(rows), sets, SET_SCHEMA).repartition("leader", "i", "j")
        sent = sent.sortWithinPartitions("leader", "i", "j", "side", F.col("ref") != F.col("leader"), "ref")
        return stored(sent.mapInArrow(link, "a bigint, b bigint"), name, batch=32)

    # The leader goes to all cells of its group, every other member to one.
    every = F.sequence(F.lit(0), F.col("cells").cast("int") - 1)
    first = dealt.withColumn("i", F.explode(F.when(F.col("ref") == F.col("leader"), every).otherwise(F.array("cell"))))
    near = linked(first.select("leader", "i", F.array("i").alias("j"), "ref", F.col("ref").alias("label")), "near")
    label = stored(components(near), "label")

    # Groups of several cells that are not one component: across the cells.
    several = dealt.filter("cells > 1").join(label.withColumnRenamed("node", "ref"), "ref", "left").withColumn("label", F.coalesce("label", "ref"))
    mixed = several.groupBy("leader").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("leader")
    several = stored(several.join(mixed, "leader"), "several")
    if not several.isEmpty():
        others = F.filter(every, lambda k: k != F.col("cell"))
        more = linked(several.select("leader", F.col("cell").alias("i"), others.alias("j"), "ref", "label"), "more")
        label = stored(components(near.unionByName(more)), "label")

    named = one.join(label.withColumnRenamed("node", "ref"), "ref", "left").withColumn("label", F.coalesce("label", "ref"))
    least = named.groupBy("label").agg(F.min("least").alias("class_id"), F.min(F.struct(F.col("least").isNull().alias("unknown"), "least", "digest"))["digest"].alias("best"))
    named = named.join(least, "label").select("digest", "class_id", (F.col("digest") == F.col("best")).alias("best"))
    # Of the class's first text, the first row with its id stays.
    keeper = texts.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "ref"))["ref"].alias("keeper"))
    named = stored(named.join(keeper, "digest"), "named")
    if not keep_rows:
        return texts.join(named, "digest").select("doc_id", "class_id", (F.col("best") & (F.col("ref") == F.col("keeper"))).alias("kept"))

    stay = named.filter("best").select((F.shiftright("keeper", 16)).alias("block"), F.expr("cast(keeper & 65535 AS int)").alias("row"))
    stay = stay.groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("stay"))

    def keep(row: dict) -> Iterator[pa.RecordBatch]:
        yield unpack(row["rows"]).take(pa.array(row["stay"], pa.int64()))

    # The list of rows grows with the table: the same join at every size.
    return each_block(blocks.join(stay.hint("merge"), "block"), keep, docs.schema)


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents without those of which a near-duplicate with a smaller id (or an equal text) stays."""
    return classes(docs, id_column, text, similarity, keep_rows=True)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
