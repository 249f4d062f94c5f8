"""Substring dedup by a relative Lempel-Ziv parse.

The corpus is cut into blocks, and each block is factored against the others.  An
index over all blocks knows the anchors of each: of the runs of n - 15 words within
a window of n the one with the least hash, about one for nine words; equal windows
have equal anchors.  For an anchor that another block has too the index names a
source, the place in the next block that has it (of those in order, the last one's
next is the first), so that a passage that stands in very many blocks is read in
each of them once.  Anchors that go on in the same source are one match, which is
extended greedily by comparing words at the source, as far as they agree; what
has n words or more is a factor, and its words are duplicates.

A longer match can begin where a factor ends, at another source than the one that
was named.  So windows with a known anchor that lie in no factor, those across
factor boundaries above all, are checked: their anchors are told to all blocks that
have them, and the windows of these anchors meet by their hashes in the index.  Copies of a whole text are factored once, by the block that has the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.blocks import ANSWER, KEYS, answered, ask, bits, copied, cuts, distinct, each_block, flags, messages, pack, part_of, unpack
from docspark.llm.frames import stored
from docspark.llm.words import Hasher, Words, inside, utf8, white_words

WORDS = 35
#: Seeds of a window at most.
SEEDS = 16
FIRST, SECOND = Hasher(51), Hasher(52)
#: A place in a block.
SOURCE = np.dtype([("block", "<i8"), ("at", "<u4")])


@dataclass
class Windows:
    """The windows of a block."""

    words: Words
    #: Word numbers at which a window begins, and the seed of each.
    at: np.ndarray
    seeds: np.ndarray
    hashes: np.ndarray
    runs: np.ndarray
    n: int

    @classmethod
    def of(cls, texts: pa.Array, n: int) -> Windows:
        w = white_words(texts)
        hashes = FIRST.ranges(w.data, w.starts, w.ends)
        at = inside(w.first, n)
        least = runs = FIRST.grams(hashes, max(1, n - SEEDS + 1))
        seeds, width = min(SEEDS, n), 1
        while width < seeds:  # the least of `width` runs; the last step may overlap
            step = min(width, seeds - width)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            width += step
        return cls(w, at, least[at], hashes, runs, n)

    def seed_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct seeds, and which of them are in the block more than once."""
        keys = np.unique(self.seeds)
        if not len(keys):
            return keys, np.zeros(0, bool)
        slot = np.minimum(np.searchsorted(keys, self.runs), len(keys) - 1)
        return keys, np.bincount(slot[keys[slot] == self.runs], minlength=len(keys)) > 1

    def anchors(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words at which a run begins that is one of the keys, within a text, and which key it is."""
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(keys, self.runs), len(keys) - 1)
        at = inside(self.words.first, max(1, self.n - SEEDS + 1))
        at = at[keys[slot[at]] == self.runs[at]]
        return at, slot[at]

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the windows at these places of `at`."""
        w = self.words
        other = SECOND.ranges(w.data, w.starts, w.ends)
        return FIRST.grams(self.hashes, self.n)[self.at[chosen]], (SECOND.grams(other, self.n)[self.at[chosen]] >> np.uint64(32)).astype(np.uint32)


def _long_texts(windows: Windows, texts: pa.Array, n: int) -> tuple[list[int], list[bytes]]:
    """Rows with n words or more and digests of their texts."""
    data, offsets = utf8(texts)
    rows = np.flatnonzero(windows.words.counts >= n).tolist()
    return rows, [hashlib.blake2b(data[offsets[k] : offsets[k + 1]], digest_size=16).digest() for k in rows]


def _doc_parts(digests: list[bytes], parts: int) -> dict[int, bytes]:
    """The block's distinct digests for each index partition, in order."""
    out: dict[int, list[bytes]] = {}
    for d in sorted({*digests}):
        out.setdefault(int(part_of(np.frombuffer(d[:8], "<u8"), parts)[0]), []).append(d)
    return {p: b"".join(x) for p, x in out.items()}


def _copies(digests: list[bytes], answers: list[dict], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each long text: whether it has a copy, and whether another one is looked up in its place."""
    sent, kind = _doc_parts(digests, parts), {}
    for x in answers or []:
        said = sent.get(x["part"], b"")
        kind |= {said[16 * k : 16 * k + 16]: v for k, v in enumerate(x["docs"])}
    seen: dict[bytes, int] = {}
    for d in digests:
        seen[d] = seen.get(d, 0) + 1
    has = np.array([kind.get(d, 0) > 0 or seen[d] > 1 for d in digests], bool)
    met: set[bytes] = set()
    later = []
    for d in digests:
        later.append(kind.get(d, 0) == 2 or d in met)
        met.add(d)
    return has, np.array(later, bool)


def _wanted(windows: Windows, texts: pa.Array, answers: list[dict], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The seeds that occur twice; places of the windows that have one, without copied texts; rows that are copies throughout; a mask of copies that are looked up elsewhere."""
    keys, _ = windows.seed_keys()
    rows, digests = _long_texts(windows, texts, windows.n)
    has, later = _copies(digests, answers, parts)
    hot = answered(answers, keys, parts)
    chosen = hot[np.searchsorted(keys, windows.seeds)] if len(keys) else np.zeros(0, bool)
    skipped = np.zeros(len(texts), bool)
    skipped[np.array(rows, np.int64)[later]] = True
    doc = np.searchsorted(windows.words.first, windows.at, "right") - 1
    return keys[hot], np.flatnonzero(chosen & ~skipped[doc]), np.array(rows, np.int64)[has], skipped


def _sources(rows: list[tuple]) -> pa.RecordBatch:
    """One index partition of anchors: which occur twice, and for those a place in the next block that has them (block -1: only this one)."""
    sizes = [len(r[2]) // 12 for r in rows]
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[2], "<u8", n) for r, n in zip(rows, sizes, strict=True))])
    place = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r[2], "<u4", n, 8 * n) for r, n in zip(rows, sizes, strict=True))])
    many = np.concatenate([np.zeros(0, bool), *(flags(r[3], n) for r, n in zip(rows, sizes, strict=True))])
    block = np.repeat(np.array([r[1] for r in rows], np.int64), sizes)
    order = np.lexsort((block, keys))
    new = np.append(True, keys[order][1:] != keys[order][:-1])[: len(order)]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    after = np.arange(1, len(order) + 1)
    after[first + size - 1] = first
    several = np.repeat(size, size) > 1
    found, source = np.zeros(len(keys), bool), np.zeros(len(keys), SOURCE)
    found[order] = several | many[order]
    source["block"][order] = np.where(several, block[order][after], -1)
    source["at"][order] = place[order][after]
    spans = list(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([bits(found[a:b]) for a, b in spans], pa.binary()), pa.array(copied(rows), pa.binary()), pa.array([source[a:b][found[a:b]].tobytes() for a, b in spans], pa.binary())],
        names=["part", "block", "found", "docs", "sources"],
    )


def _marked(rows: list[tuple]) -> pa.RecordBatch:
    """One index partition: which keys a block has marked."""
    sizes = [len(r[2]) // 12 for r in rows]
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).tolist()
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[2], "<u8", n) for r, n in zip(rows, sizes, strict=True))])
    mark = np.concatenate([np.zeros(0, bool), *(flags(r[3], n) for r, n in zip(rows, sizes, strict=True))])
    _, back = np.unique(keys, return_inverse=True)
    found = np.bincount(back, mark)[back] > 0 if len(keys) else mark
    said = [bits(found[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array(said, pa.binary()), pa.array([b""] * len(rows), pa.binary())], names=["part", "block", "found", "docs"])


def _named(answers: list[dict], keys: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The source of each key that occurs twice; others have none."""
    out, at = np.full(len(keys), np.array((-1, 0), SOURCE)), cuts(keys, parts)
    for x in answers or []:
        a, b = at[x["part"]], at[x["part"] + 1]
        out[a:b][hot[a:b]] = np.frombuffer(x["sources"], SOURCE)
    return out


def _matches(block: int, windows: Windows, skipped: np.ndarray, answers: list[dict], parts: int) -> list[tuple]:
    """(source, block, begin, shift, words): ranges of words to be compared with those of a source block, `shift` words further on.

    Anchors that follow each other with the same source and shift are one range,
    with as many words on both sides as a window of one of them can have.
    """
    keys, _ = windows.seed_keys()
    hot = answered(answers, keys, parts)
    at, key = windows.anchors(keys)
    if not len(at):
        return []
    named = _named(answers, keys, hot, parts)
    source, place = named["block"][key], named["at"][key].astype(np.int64)
    # An anchor that the block has twice or more has its own next place as source (the last one the place before): what repeats itself is one match.
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, back = order[:-1][same], order[1:][same]
    place[back], source[back] = at[again], block
    place[again], source[again] = at[back], block
    w = windows.words
    doc = np.searchsorted(w.first, at, "right") - 1
    use = hot[key] & ~skipped[doc] & (source >= 0)
    at, doc, source, shift = at[use], doc[use], source[use], (place - at)[use]
    if not len(at):
        return []
    new = np.append(True, (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]) | (np.diff(at) > windows.n))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    side = min(SEEDS, windows.n) - 1
    begin = np.maximum(at[first] - side, w.first[doc[first]])
    end = np.minimum(at[last] + windows.n, w.first[doc[first] + 1])  # a run and as many words as there are seeds
    words = (windows.hashes >> np.uint64(32)).astype("<u4")
    return [(s, block, b, d, words[b:e].tobytes()) for s, b, e, d in zip(source[first].tolist(), begin.tolist(), end.tolist(), shift[first].tolist(), strict=True)]


def _extended(windows: Windows, asked: list[dict]) -> tuple[np.ndarray, ...]:
    """(block, begin, end, at): the factors of these ranges in this source block, and where in it they begin."""
    w = windows.words
    words = (windows.hashes >> np.uint64(32)).astype("<u4")
    said = [np.frombuffer(x["words"], "<u4") for x in asked]
    size = np.array([len(x) for x in said], np.int64)
    upto = np.cumsum(size) - size
    begin = np.array([x["begin"] for x in asked], np.int64)
    here = np.repeat(begin - upto, size) + np.arange(int(size.sum()))
    there = here + np.repeat(np.array([x["shift"] for x in asked], np.int64), size)
    known = (there >= 0) & (there < len(words))
    same = known & (np.concatenate(said) == words[np.where(known, there, 0)])
    cut = np.zeros(len(same), bool)  # no factor goes on into another range, or at the source into another text
    cut[upto] = True
    border = np.zeros(len(words) + 1, bool)
    border[w.first] = True
    cut |= border[np.where(known, there, 0)]
    first = np.flatnonzero(same & (cut | ~np.append(False, same[:-1])))
    ends = np.flatnonzero(same & np.append(cut[1:] | ~same[1:], True)) + 1
    long = ends - first >= windows.n
    first, ends = first[long], ends[long]
    ask = np.searchsorted(upto, first, "right") - 1
    return np.array([x["block"] for x in asked], np.int64)[ask], here[first], here[first] + ends - first, there[first]


def _inside(factors: list[dict], windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Which windows lie in a factor, and the change of coverage at each word."""
    change, starts = np.zeros((2, len(windows.words.starts) + 1), np.int64)
    begin, end = (np.array([x[n] for x in factors or []], np.int64) for n in ("begin", "end"))
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    np.add.at(starts, begin, 1)
    np.add.at(starts, end - windows.n + 1, -1)
    return np.cumsum(starts)[windows.at] > 0, change


def find_spans(docs: DataFrame, finish, schema, text: str = "text", n: int = WORDS, parts: int | None = None) -> DataFrame:
    """Finds the words covered by repeated windows; `finish(batch, words, covered)` makes the output of each block."""
    _, joined, _, parts = _parsed(docs, text, n, parts)
    column = docs.columns.index(text)

    def left(row: dict) -> Iterator[pa.RecordBatch]:
        """All anchors that occur twice, marked where a window of theirs lies in no factor."""
        texts = unpack(row["rows"]).column(column)
        windows = Windows.of(texts, n)
        keys, chosen, *_ = _wanted(windows, texts, row["answers"], parts)
        chosen = chosen[~_inside(row["factors"], windows)[0][chosen]]
        yield messages(row["block"], parts, keys, np.zeros(len(keys), np.uint32), np.isin(keys, windows.seeds[chosen], assume_unique=False))

    def asked(row: dict, windows: Windows, keys: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """The windows whose anchor some block has marked: of those the others must be known too."""
        marked = answered(row["left"], keys, parts)
        return chosen[marked[np.searchsorted(keys, windows.seeds[chosen])]] if len(chosen) else chosen

    def places(row: dict) -> Iterator[pa.RecordBatch]:
        texts = unpack(row["rows"]).column(column)
        windows = Windows.of(texts, n)
        keys, chosen, *_ = _wanted(windows, texts, row["answers"], parts)
        first, second, count, _ = distinct(*windows.keys(asked(row, windows, keys, chosen)))
        yield messages(row["block"], parts, first, second, count > 1)

    def covered(row: dict) -> Iterator[pa.RecordBatch]:
        batch = unpack(row["rows"])
        texts = batch.column(column)
        windows = Windows.of(texts, n)
        w = windows.words
        keys, chosen, copies, _ = _wanted(windows, texts, row["answers"], parts)
        change = _inside(row["factors"], windows)[1]
        chosen = asked(row, windows, keys, chosen)
        first, _, _, back = distinct(*windows.keys(chosen))
        known = answered(row["places"], first, parts)[back] if len(chosen) else np.zeros(0, bool)
        begin = windows.at[chosen[known]]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + n, -1)
        np.add.at(change, w.first[copies], 1)
        np.add.at(change, w.first[copies + 1], -1)
        yield from finish(batch, w, np.cumsum(change[:-1]) > 0)

    marked = ask(each_block(joined, left, KEYS), parts, _marked).withColumnRenamed("answers", "left")
    joined = joined.join(marked, "block", "left")
    found = ask(each_block(joined, places, KEYS), parts).withColumnRenamed("answers", "places")
    return each_block(joined.join(found, "block", "left"), covered, schema)


def _factored(blocks: DataFrame, known: DataFrame, column: int, n: int, parts: int) -> DataFrame:
    """(block, begin, end, source, at): factors of n words or more, in words of their blocks."""

    def matches(row: dict) -> Iterator[pa.RecordBatch]:
        texts = unpack(row["rows"]).column(column)
        windows = Windows.of(texts, n)
        rows = _matches(row["block"], windows, _wanted(windows, texts, row["answers"], parts)[3], row["answers"], parts)
        for k in range(0, len(rows), 1000):
            columns = zip(*rows[k : k + 1000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)], names=["source", "block", "begin", "shift", "words"])

    def extend(row: dict) -> Iterator[pa.RecordBatch]:
        windows = Windows.of(unpack(row["rows"]).column(column), n)
        block, begin, end, at = _extended(windows, row["asked"])
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(np.full(len(block), row["block"]), pa.int64()), pa.array(at, pa.int32())], names=["block", "begin", "end", "source", "at"])

    sent = each_block(blocks.join(known, "block", "left"), matches, "source bigint, block bigint, begin int, shift int, words binary")
    # A block is named as the source of each of its anchors to one other block, so what it is asked is no more than it holds.
    asked = sent.groupBy("source").agg(F.collect_list(F.struct("block", "begin", "shift", "words")).alias("asked")).withColumnRenamed("source", "block")
    return each_block(blocks.join(asked, "block"), extend, "block bigint, begin int, end int, source bigint, at int")


def _parsed(docs: DataFrame, text: str, n: int, parts: int | None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The blocks; the blocks with what the index says of their anchors, and their factors; all factors; the number of index partitions."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = pack(docs, text)
    column = docs.columns.index(text)

    def seeds(row: dict) -> Iterator[pa.RecordBatch]:
        texts = unpack(row["rows"]).column(column)
        windows = Windows.of(texts, n)
        keys, many = windows.seed_keys()
        at, key = windows.anchors(keys)
        place = np.zeros(len(keys), np.uint32)
        place[key[::-1]] = at[::-1]  # the first place of each
        _, digests = _long_texts(windows, texts, n)
        yield messages(row["block"], parts, keys, place, many, _doc_parts(digests, parts))

    known = stored(ask(each_block(blocks, seeds, KEYS), parts, _sources, ANSWER + ", sources binary"), "seeds", batch=500)
    factors = stored(_factored(blocks, known, column, n, parts), "factors")
    own = factors.groupBy("block").agg(F.collect_list(F.struct("begin", "end")).alias("factors"))
    return blocks, blocks.join(known.join(own, "block", "left"), "block", "left"), factors, parts


def factors(docs: DataFrame, text: str = "text", n: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """The blocks (block, rows) and the factors (block, begin, end, source, at) of the parse.

    A factor says that words begin to end - 1 of a block, all of one document, are
    those of block `source` from word `at` on, and has n words or more.  Words are
    counted over all documents of a block, in their order.  Copies of a whole text
    have factors in one place only.
    """
    blocks, _, found, _ = _parsed(docs, text, n, None)
    return blocks, found


def spans(mask: np.ndarray) -> list[int]:
    """The runs of true values as start, end, start, end ..."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge.tolist()


def duplicate_spans(docs: DataFrame, text: str = "text", n: int = WORDS) -> DataFrame:
    """Adds n_words and spans (start, end, start, end ... in words) of the words in repeated windows.

    Words are separated by ASCII white space.  A window is n consecutive words
    of one document; it is repeated if the same words also begin anywhere else,
    in the same document or another (overlapping itself included).

    Null, empty and shorter texts have no windows; a row that is there twice is
    covered throughout if it has n words; other columns are kept, those with
    these names replaced; an empty table gives an empty result.
    """
    docs = docs.drop("n_words", "spans")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType()))])

    def finish(batch: pa.RecordBatch, w: Words, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [spans(mask[a:b]) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w.counts, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=schema.names)

    return find_spans(docs, finish, schema, text, n)


def cut_words(text: str, flat: list[int]) -> str:
    """The text without the words of these spans and the white space after each span."""
    w = white_words(pa.array([text], pa.large_string()))
    left, out = 0, []
    raw = text.encode()
    for a, b in zip(flat[::2], flat[1::2], strict=True):
        out.append(raw[left : int(w.starts[a])])
        left = int(w.starts[b]) if b < len(w.starts) else len(raw)
    return b"".join([*out, raw[left:]]).decode()


def remove_repeats(docs: DataFrame, text: str = "text", n: int = WORDS) -> DataFrame:
    """The same rows and columns, each text without its repeated spans; other texts stay as they are."""

    def finish(batch: pa.RecordBatch, w: Words, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        k = batch.schema.get_field_index(text)
        texts = batch.column(k).to_pylist()
        hit = np.unique(np.searchsorted(w.first, np.flatnonzero(mask), "right") - 1)
        for d in hit.tolist():
            texts[d] = cut_words(texts[d], spans(mask[w.first[d] : w.first[d + 1]]))
        yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return find_spans(docs, finish, docs.schema, text, n)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def finish(batch: pa.RecordBatch, w: Words, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        removed, digests = [], []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            gone = mask[a:b]
            removed.append(int(gone.sum()))
            kept = np.flatnonzero(~gone) + a
            digests.append(hashlib.sha256(b" ".join([w.data[s:e].tobytes() for s, e in zip(w.starts[kept].tolist(), w.ends[kept].tolist(), strict=True)])).hexdigest())
        columns = [batch.column(0), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return find_spans(docs, finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT rid, i, md5(array_to_string(w[i : i + 34], ' ')) AS said
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
),
hit AS (SELECT rid, i FROM win WHERE said IN (SELECT said FROM win GROUP BY said HAVING count(*) > 1)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS k FROM hit),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
kept AS (
  SELECT rid, string_agg(x, ' ' ORDER BY k) AS said, count(*) AS n
  FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = word.rid AND gone.k = word.k) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
