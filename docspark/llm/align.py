"""Alignment of two tokenizers over a corpus: which of their ids stand for the same bytes, and in how many documents.

Both tokenizers cut the same bytes.  Offsets at which tokens of both end cut
them into groups; the tokens of a group are linked, each of one side with each of
the other.  In how many documents a pair of ids is linked is counted outside
memory: a task gathers pair-document records, sorts them side-major (by A's id,
then B's) and cuts them by a radix of A's id into zstd runs.  What is shuffled
to be counted is each run's pairs with their number of documents; the runs of a
radix are merged by a heap, k at a time, which adds up the numbers of equal pairs,
and since the pairs come side-major the greatest number of each A id is known when
its last pair has passed.  The runs are then read again against these
counts and give each document its contributions back.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.bpe_count import byte_symbols
from docspark.llm.frames import stored
from docspark.llm.tokens import ENCODED_TOGETHER, HASHER, Store, encoder, pieces
from docspark.llm.words import slices

#: Pair-document records of a block; its runs are sorted in memory.
BLOCK_RECORDS = 1_000_000
#: Radixes, by the lowest bits of A's id.
RADIXES = 256
#: Runs that one heap merges.
MERGED_TOGETHER = 64
#: Blocks whose runs of a radix are answered in one group.
BLOCKS_TOGETHER = 1_000
#: Distinct pieces of text whose alignment a worker remembers.
STORE_PIECES = 500_000
#: Pieces whose texts of groups are looked at together.
TOGETHER = 20_000
RUNS = "block bigint, radix int, codes binary, sizes binary, docs binary, links binary"


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as one zstd frame, the lowest bytes of all first."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8" if x.dtype.itemsize == 8 else "<u4")).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def unpack(data: bytes, kind: type = np.uint32) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def differences(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


class Side:
    """A tokenizer's tokens as bytes."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        upto = np.cumsum(size) - size
        return self.pool[np.repeat(self.at[ids] - upto, size) + np.arange(int(size.sum()))]


#: The decimal digits of each id below 100,000, right-aligned, and how many there are.
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(n)
    digits = np.stack([x // 10**k % 10 + 48 for k in (4, 3, 2, 1, 0)], axis=1).astype(np.uint8)
    return digits, np.where(x >= 10_000, 5, np.where(x >= 1000, 4, np.where(x >= 100, 3, np.where(x >= 10, 2, 1))))


class Aligner:
    """Aligns texts, remembering each distinct piece; one lives in each worker."""

    def __init__(self, byte_level: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte = {c: i for i, c in enumerate(byte_symbols())}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.left = Side([bytes(byte[c] for c in t) if all(c in byte for c in t) else b"" for t in names])
        self.many = self.b.vocab_size()
        tokens = [self.b.id_to_piece(i) for i in range(self.many)]
        self.right = Side([bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(tokens)])
        # A piece of text may begin with white space that stands in no token of B but at its begin.
        inner = {c for t in tokens for c in t.replace("▁", " ").lstrip(" ")}
        late = {c for t in tokens for c in t.replace("▁", " ")[1:]} - {" "}
        self.begins = np.zeros(256, bool)
        self.begins[[ord(c) for c in "\t\n\v\f\r" if c not in late] + [0x20] * (" " not in inner)] = True
        self.space = self.b.piece_to_id("▁")
        self.digits, self.n_digits = _digits(max(len(names), self.many))
        self.clear()

    def clear(self) -> None:
        #: Of each piece: tokens of A, of B, groups, whether both give its bytes, then its links' codes; and its groups as text.
        self.codes, self.texts = Store(np.uint32), Store(np.uint8)

    def right_ids(self, said: list[str]) -> list[list[int]]:
        """B's ids of pieces; the library puts a space before each."""
        found = self.b.encode([x[1:] if x[0] == " " else x for x in said], num_threads=1)
        for k, x in enumerate(said):
            if x[0] != " ":
                found[k] = found[k][1:] if found[k][:1] == [self.space] else [0]  # 0 has other bytes
            elif len(x) == 1:
                found[k] = [self.space]
        return found

    def learn(self, keys: np.ndarray, said: list[str]) -> None:
        runs = [x.ids for x in self.a.encode_batch_fast(said, add_special_tokens=False)], self.right_ids(said)
        data = [x.encode() for x in said]
        length = np.array([len(x) for x in data], np.int64)
        ok = np.ones(len(said), bool)
        for side, ids in zip((self.left, self.right), runs, strict=True):
            n = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
            made = np.bincount(np.repeat(np.arange(len(said)), n), side.size[flat], len(said)).astype(np.int64)
            ok &= made == length
        for side, ids in zip((self.left, self.right), runs, strict=True):
            # Bytes are compared where their number is right.
            some = np.flatnonzero(ok)
            flat = np.fromiter((i for k in some.tolist() for i in ids[k]), np.int64)
            same = side.bytes(flat) == np.frombuffer(b"".join(data[k] for k in some.tolist()), np.uint8)
            upto = np.concatenate([[0], np.cumsum(~same)])
            ends = np.cumsum(length[some])
            ok[some] = upto[ends] == upto[ends - length[some]]
        good = np.flatnonzero(ok).tolist()
        ids, ends, n = [], [], []
        for side, found in zip((self.left, self.right), runs, strict=True):
            n.append(np.array([len(found[k]) for k in good], np.int64))
            ids.append(np.fromiter((i for k in good for i in found[k]), np.int64, int(n[-1].sum())))
            ends.append(np.cumsum(side.size[ids[-1]]))
        cuts = np.intersect1d(ends[0], ends[1], assume_unique=True)  # no token is empty here
        group = [np.searchsorted(cuts, e, "left") for e in ends]
        sizes = [np.bincount(g, minlength=len(cuts)) for g in group]
        first = [np.cumsum(s) - s for s in sizes]
        piece = np.repeat(np.arange(len(good)), n[0])[first[0]] if len(cuts) else np.zeros(0, np.int64)
        # All pairs of a group: its A tokens one after the other, each with all its B tokens.
        each = sizes[1][group[0]]
        upto = np.cumsum(each) - each
        partner = np.repeat(first[1][group[0]] - upto, each) + np.arange(int(each.sum()))
        links = (np.repeat(ids[0], each) * self.many + ids[1][partner]).astype(np.uint32)
        n_groups = np.bincount(piece, minlength=len(good))
        n_links = np.bincount(piece, sizes[0] * sizes[1], len(good)).astype(np.int64)
        head = np.zeros((len(said), 4), np.uint32)
        head[good] = np.stack([n[0], n[1], n_groups, np.ones(len(good))], axis=1)
        count = np.zeros(len(said), np.int64)
        count[good] = n_links
        flat = np.zeros(4 * len(said) + len(links), np.uint32)
        at = np.cumsum(count + 4) - count - 4
        flat[at[:, None] + np.arange(4)] = head
        flat[np.repeat(at + 4 - (np.cumsum(count) - count), count) + np.arange(len(links))] = links
        self.codes.add_flat(keys, flat, count + 4)
        # The tokens of all groups in the order of the text, each with the sign that follows it.
        side = np.concatenate([np.zeros(len(ids[0]), np.int64), np.ones(len(ids[1]), np.int64)])
        where = np.concatenate(group)
        order = np.lexsort([side, where])
        token, side, where = np.concatenate(ids)[order], side[order], where[order]
        last = np.append(where[1:] != where[:-1], True) if len(where) else np.zeros(0, bool)
        turn = np.append(side[1:] != side[:-1], True) if len(where) else last
        sign = np.where(last, ord(";"), np.where(turn, ord("|"), ord(","))).astype(np.uint8)
        rows = np.concatenate([self.digits[token], sign[:, None]], axis=1)
        shown = np.concatenate([np.arange(5) >= 5 - self.n_digits[token][:, None], np.ones((len(token), 1), bool)], axis=1)
        chars = np.zeros(len(said), np.int64)
        chars[good] = np.bincount(piece[where], self.n_digits[token] + 1, len(good)).astype(np.int64) if len(token) else 0
        self.texts.add_flat(keys, rows[shown], chars)

    def __call__(self, texts: pa.Array) -> tuple[list[np.ndarray], list[str], np.ndarray]:
        """For each text n_a, n_b, n_groups, n_links; the hash of its groups; and its records, code << 32 | its number, with their links."""
        empty = pa.compute.equal(pa.compute.fill_null(pa.compute.binary_length(texts), 0), 0)
        spaced = pa.compute.if_else(empty, "", pa.compute.binary_join_element_wise(" ", texts.fill_null(""), ""))
        data, starts, ends, first = pieces(spaced, self.begins)
        many = len(texts)
        if not len(starts):
            return [np.zeros(many, np.int64)] * 4, [""] * many, np.zeros((2, 0), np.uint64)
        keys, one, back = np.unique(HASHER.ranges(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.codes) + len(keys) > STORE_PIECES:
            self.clear()
        new = np.flatnonzero(self.codes.find(keys)[0] < 0)
        for k in range(0, len(new), ENCODED_TOGETHER):
            some = new[k : k + ENCODED_TOGETHER]
            self.learn(keys[some], [data[a:b].tobytes().decode() for a, b in zip(starts[one[some]].tolist(), ends[one[some]].tolist(), strict=True)])
        at, size = self.codes.find(keys)
        head = self.codes.pool[at[:, None] + np.arange(4)].astype(np.int64)
        doc = np.repeat(np.arange(many), np.diff(first))
        bad = np.bincount(doc, head[back, 3] == 0, many) > 0
        sums = [np.where(bad, 0, np.bincount(doc, x[back], many)).astype(np.int64) for x in (head[:, 0], head[:, 1], head[:, 2], size - 4)]
        use = ~bad[doc]
        at, size, who = at[back][use] + 4, size[back][use].astype(np.int64) - 4, doc[use]
        upto = np.cumsum(size) - size
        codes = self.codes.pool[np.repeat(at - upto, size) + np.arange(int(size.sum()))].astype(np.uint64)
        records = np.unique(codes << np.uint64(32) | np.repeat(who, size).astype(np.uint64), return_counts=True)
        return sums, self._hashes(keys, back, doc, bad, first), np.stack([records[0], records[1].astype(np.uint64)])

    def _hashes(self, keys: np.ndarray, back: np.ndarray, doc: np.ndarray, bad: np.ndarray, first: np.ndarray) -> list[str]:
        at, size = self.texts.find(keys)
        made: dict[int, object] = {}
        for k in range(0, len(back), TOGETHER):
            part = back[k : k + TOGETHER]
            a, n = at[part], size[part].astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(n)])
            text = self.texts.pool[np.repeat(a - upto[:-1], n) + np.arange(upto[-1])]
            for d in range(int(doc[k]), int(doc[min(k + TOGETHER, len(back)) - 1]) + 1):
                i, j = max(int(first[d]), k) - k, min(int(first[d + 1]), k + TOGETHER) - k
                if i < j and not bad[d]:
                    ends = upto[j] - (int(first[d + 1]) == k + j)  # no sign after the last group
                    made.setdefault(d, hashlib.sha256()).update(text[upto[i] : ends])
        return [made[d].hexdigest() if d in made else "" for d in range(len(bad))]


def _runs(block: int, records: list[np.ndarray], many: int) -> Iterator[tuple]:
    """The records of a block as rows of RUNS, one for each radix."""
    keys, links = np.concatenate(records, axis=1) if records else np.zeros((2, 0), np.uint64)
    order = np.argsort(keys, kind="stable")
    codes, docs, links = (keys[order] >> np.uint64(32)).astype(np.uint32), keys[order].astype(np.uint32), links[order].astype(np.uint32)
    radix = (codes // np.uint32(many) % np.uint32(RADIXES)).astype(np.uint8)
    order = np.argsort(radix, kind="stable")
    codes, docs, links, radix = codes[order], docs[order], links[order], radix[order]
    bounds = np.searchsorted(radix, np.arange(RADIXES + 1))
    for r, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if i < j:
            starts = np.flatnonzero(np.append(True, codes[i + 1 : j] != codes[i : j - 1]))
            yield block, r, pack(differences(codes[i:j][starts])), pack(np.diff(np.append(starts, j - i)).astype(np.uint32)), pack(docs[i:j]), pack(links[i:j])


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of (ascending codes, counts) as one: a heap of the runs' next pairs gives equal ones together."""
    if len(runs) == 1:
        return runs[0]
    codes, counts, last = [], [], -1
    for code, n in heapq.merge(*(zip(c.tolist(), s.tolist(), strict=True) for c, s in runs)):
        if code == last:
            counts[-1] += n
        else:
            codes.append(code)
            counts.append(n)
            last = code
    return np.array(codes, np.uint32), np.array(counts, np.uint64)


def _grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Rows that come sorted by their first `by` columns, one group after the other, none held whole."""
    from itertools import groupby

    rows = (tuple(x) for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[:by])


def _counted(runs: DataFrame, many: int) -> DataFrame:
    """(radix, codes, counts, best): for each radix all pairs, their numbers of documents, and whether they are their A id's greatest.

    A radix has at most as many pairs as its A ids have partners, whatever the
    number of runs; of these, MERGED_TOGETHER a level wait to be merged.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix,), rows in _grouped(batches, 1):
            levels: list[list] = [[]]
            for _, codes, sizes in rows:
                levels[0].append((np.cumsum(unpack(codes), dtype=np.uint32), unpack(sizes).astype(np.uint64)))
                k = 0
                while len(levels[k]) == MERGED_TOGETHER:
                    if k + 1 == len(levels):
                        levels.append([])
                    levels[k + 1].append(_merged(levels[k]))
                    levels[k] = []
                    k += 1
            codes, counts = _merged([x for level in levels for x in level])
            starts = np.flatnonzero(np.append(True, np.diff(codes // np.uint32(many)) != 0))
            greatest = np.repeat(np.maximum.reduceat(counts, starts), np.diff(np.append(starts, len(codes))))
            made = [pack(differences(codes)), pack(counts), np.packbits(counts == greatest).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), *(pa.array([x], pa.binary()) for x in made)], names=["radix", "codes", "counts", "best"])

    dealt = runs.select("radix", "codes", "sizes").repartition("radix").sortWithinPartitions("radix")
    return dealt.mapInArrow(merge, "radix int, codes binary, counts binary, best binary")


def _answered(runs: DataFrame, counted: DataFrame, salts: int) -> DataFrame:
    """(block, docs, best, sums): what each run gives its block's documents; the runs of a radix are dealt over `salts` groups."""
    asks = runs.select("radix", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "block", "codes", "sizes", "docs", "links")
    known = counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    nothing = F.lit(None).cast("binary")
    known = known.select("radix", "salt", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("block"), "codes", F.col("counts").alias("sizes"), F.col("best").alias("docs"), nothing.alias("links"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 2):
            *_, codes, counts, best, _ = next(rows)  # the counts come before the runs
            codes, counts = np.cumsum(unpack(codes), dtype=np.uint32), unpack(counts, np.uint64)
            best = np.unpackbits(np.frombuffer(best, np.uint8), count=len(codes)).astype(bool)
            for *_, block, asked, sizes, docs, links in rows:
                at = np.repeat(np.searchsorted(codes, np.cumsum(unpack(asked), dtype=np.uint32)), unpack(sizes))
                docs, links = unpack(docs), unpack(links).astype(np.int64)
                many = int(docs.max()) + 1
                sums = np.zeros(many, np.int64)
                np.add.at(sums, docs, links * counts[at].astype(np.int64))
                hits = np.zeros(many, np.int64)
                np.add.at(hits, docs, links * best[at])
                some = np.flatnonzero(sums)
                made = [pack(some.astype(np.uint32)), pack(hits[some].astype(np.uint64)), pack(sums[some].astype(np.uint64))]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in made)], names=["block", "docs", "best", "sums"])

    dealt = asks.unionByName(known).repartition("radix", "salt").sortWithinPartitions("radix", "salt", "kind")
    return dealt.mapInArrow(answer, "block bigint, docs binary, best binary, sums binary")


class Alignment:
    """The alignment of a table of texts; see `align`."""

    def __init__(self, spark: SparkSession, rows: DataFrame, many: int, kind: T.DataType):
        self.runs, self.blocks = rows.filter("radix >= 0"), rows.filter("radix < 0").select("block", F.col("docs").alias("table"))
        self.many, self.kind = many, kind
        self.counted = stored(_counted(self.runs, many), "counted")

    def pairs(self) -> DataFrame:
        """(a, b, n_docs, best): every pair of ids that is linked in some document."""
        many = self.many

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for codes, counts, best in zip(*(b.column(n).to_pylist() for n in ("codes", "counts", "best")), strict=True):
                    codes = np.cumsum(unpack(codes), dtype=np.uint32)
                    columns = [pa.array((codes // many).astype(np.int32)), pa.array((codes % many).astype(np.int32)), pa.array(unpack(counts, np.uint64).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.unpackbits(np.frombuffer(best, np.uint8), count=len(codes)).astype(bool))], names=["a", "b", "n_docs", "best"])

        return self.counted.mapInArrow(spread, "a int, b int, n_docs bigint, best boolean")

    def documents(self) -> DataFrame:
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): a row for each text."""
        salts = 1 + self.blocks.count() // BLOCKS_TOGETHER
        answers = _answered(self.runs, self.counted, salts).withColumn("kind", F.lit(1)).withColumn("table", F.lit(None).cast("binary"))
        nothing = F.lit(None).cast("binary")
        blocks = self.blocks.withColumn("kind", F.lit(0)).withColumns({"docs": nothing, "best": nothing, "sums": nothing})
        names = ["block", "kind", "table", "docs", "best", "sums"]

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in _grouped(batches, 1):
                table = pa.ipc.open_stream(pa.py_buffer(next(rows)[2])).read_all()  # the block's documents come before what its runs give
                best, total = np.zeros((2, table.num_rows), np.int64)
                for *_, docs, hits, sums in rows:
                    docs = unpack(docs)
                    best[docs] += unpack(hits, np.uint64).astype(np.int64)
                    total[docs] += unpack(sums, np.uint64).astype(np.int64)
                table = table.add_column(5, "n_best", pa.array(best)).add_column(6, "count_sum", pa.array(total))
                yield from table.combine_chunks().to_batches()

        dealt = blocks.select(names).unionByName(answers.select(names)).repartition("block").sortWithinPartitions("block", "kind")
        fields = [T.StructField("doc_id", self.kind), *T.StructType.fromDDL("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string").fields]
        return dealt.mapInArrow(gather, T.StructType(fields))


def align(docs: DataFrame, byte_level: str, model: str, doc_id: str = "doc_id", text: str = "text") -> Alignment:
    """Aligns the tokens of both tokenizers over all texts.

    `byte_level` is the path of a byte-level vocabulary in the tokenizers' JSON
    format (side A, given a space and the text), `model` of a SentencePiece model
    (side B, which adds that space); both are read by the driver and sent to the
    tasks (a megabyte or two).  Special tokens' strings in texts are plain text.

    Null and empty texts, and texts that one of the sides doesn't give back byte
    by byte, have no tokens: zeros and an empty hash.  A text may be of any length; of
    repeated rows and ids each counts as a document and has a row; null ids stay;
    other columns are not carried; an empty table gives no row.
    """
    spark = docs.sparkSession
    with open(byte_level, encoding="utf-8") as f, open(model, "rb") as g:
        spec, proto = f.read(), g.read()
    import sentencepiece

    many = sentencepiece.SentencePieceProcessor(model_proto=proto).vocab_size()
    sent, mark = spark.sparkContext.broadcast((spec, proto)), (zlib.crc32(spec.encode()), zlib.crc32(proto))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = [x.split()[0] for x in RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = encoder(("align", mark), lambda: Aligner(*sent.value))
        block = TaskContext.get().partitionId() << 32
        tables, records, docs, held = [], [], 0, 0

        def full() -> Iterator[pa.RecordBatch]:
            out = io.BytesIO()
            table = pa.concat_tables(tables)
            with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                f.write_table(table)
            rows = [(block, -1, None, None, out.getvalue(), None), *_runs(block, records, many)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.binary()] * 4], strict=True)], names=names)

        for batch in batches:
            for part in slices(batch, "text"):
                sums, hashes, found = aligner(part.column(1))
                tables.append(pa.table([part.column(0), *map(pa.array, sums), pa.array(hashes, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]))
                found[0] += np.uint64(docs)
                records.append(found)
                docs, held = docs + part.num_rows, held + found.shape[1]
                if held >= BLOCK_RECORDS:
                    yield from full()
                    block += 1
                    tables, records, docs, held = [], [], 0, 0
        if tables:
            yield from full()

    made = stored(rows.mapInArrow(run, RUNS), "runs")
    return Alignment(spark, made, many, docs.schema[doc_id].dataType)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents()
