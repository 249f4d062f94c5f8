"""Blocks of documents, and lookups of their keys in an index over all blocks.

A block is some megabytes of documents in one row, compressed.  To ask which of
a block's keys occur elsewhere, each block sends its distinct keys, sorted, to
the index partitions (one row for each that has any), where the keys of all
blocks meet; the answer is one bit for each key.  A key that is in a third of
all documents is thus sent once for each block, not for each document, and no
partition holds more than its range of hash values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.frames import stored
from docspark.llm.tokens import forget
from docspark.llm.words import give_back, slices

BLOCK_BYTES = 1_000_000
#: A document's number is its block's number and its row in 16 bits.
BLOCK_ROWS = 1 << 16
KEYS = "part int, block bigint, keys binary, many binary, docs binary"
ANSWER = "part int, block bigint, found binary, docs binary"


def pack(docs: DataFrame, text: str, size: int = BLOCK_BYTES) -> DataFrame:
    """(block, rows): the documents in blocks of about `size` bytes of text, written to the shared folder.

    They are written once, so that every later step sees the same blocks under
    the same numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        waiting: list[pa.RecordBatch] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(waiting).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

        for batch in batches:
            for part in slices(batch, text, size):
                more = pa.compute.sum(pa.compute.binary_length(part.column(part.schema.get_field_index(text)))).as_py() or 0
                if waiting and (held + more > size or sum(x.num_rows for x in waiting) + part.num_rows > BLOCK_ROWS):
                    yield block()
                    waiting, held = [], 0
                waiting.append(part)
                held += more
        if waiting:
            yield block()

    return stored(docs.mapInArrow(run, "block bigint, rows binary"), "blocks", batch=1000)


def unpack(rows: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(rows).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The index partition of each key; it ascends with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(said: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(said, np.uint8), count=n).astype(bool)


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order: (first, second, how many of each, the number of each input pair's)."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return a[at], b[at], np.diff(np.append(at, len(a))), back


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the keys of each index partition begin, and the end."""
    return np.searchsorted(part_of(keys, parts), np.arange(parts + 1))


def messages(block: int, parts: int, first: np.ndarray, second: np.ndarray, many: np.ndarray, docs: dict[int, bytes] | None = None) -> pa.RecordBatch:
    """The rows that a block sends: its distinct keys (64 + 32 bits) and which it has more than once."""
    at, docs = cuts(first, parts), docs or {}
    rows = []
    for p in sorted({*np.flatnonzero(np.diff(at)).tolist(), *docs}):
        a, b = at[p], at[p + 1]
        rows.append((p, block, first[a:b].tobytes() + second[a:b].tobytes(), bits(many[a:b]), docs.get(p, b"")))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "block", "keys", "many", "docs"])


def copied(rows: list[tuple]) -> list[bytes]:
    """For each digest of a text: 0 in one block only, 1 in several of which this is the first, 2 in another one."""
    owner: dict[bytes, int] = {}
    times: dict[bytes, int] = {}
    split = [[r[4][k : k + 16] for k in range(0, len(r[4]), 16)] for r in rows]
    for r, digests in zip(rows, split, strict=True):
        for d in digests:
            owner[d] = min(owner.get(d, r[1]), r[1])
            times[d] = times.get(d, 0) + 1
    return [bytes(0 if times[d] == 1 else 1 if owner[d] == r[1] else 2 for d in digests) for r, digests in zip(rows, split, strict=True)]


def _meet(rows: list[tuple]) -> pa.RecordBatch:
    """One index partition: which keys occur in two blocks, or twice in one."""
    sizes = [len(r[2]) // 12 for r in rows]
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    first = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[2], "<u8", n) for r, n in zip(rows, sizes, strict=True))])
    second = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r[2], "<u4", n, 8 * n) for r, n in zip(rows, sizes, strict=True))])
    many = np.concatenate([np.zeros(0, bool), *(flags(r[3], n) for r, n in zip(rows, sizes, strict=True))])
    *_, count, back = distinct(first, second)
    often = count > 1
    np.logical_or.at(often, back[many], True)
    found = often[back]
    docs = copied(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([bits(found[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)], pa.binary()), pa.array(docs, pa.binary())],
        names=["part", "block", "found", "docs"],
    )


def ask(sent: DataFrame, parts: int, meet: Callable[[list[tuple]], pa.RecordBatch] = _meet, answer: str = ANSWER) -> DataFrame:
    """(block, answers): for each block, what the index says of its keys, a struct for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            yield meet(rows)

    answers = sent.repartitionById(parts, "part").mapInArrow(run, answer)
    return answers.groupBy("block").agg(F.collect_list(F.struct(*(c for c in answers.columns if c != "block"))).alias("answers"))


def answered(answers: list[dict], keys: np.ndarray, parts: int) -> np.ndarray:
    """The answers' bits for the block's distinct keys, in order."""
    out, at = np.zeros(len(keys), bool), cuts(keys, parts)
    for x in answers or []:
        a, b = at[x["part"]], at[x["part"] + 1]
        out[a:b] = flags(x["found"], b - a)
    return out


def each_block(blocks: DataFrame, make: Callable[[dict], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """Applies `make` to every block, a dict of its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            give_back()
            for k in range(batch.num_rows):
                yield from make({n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)})

    return blocks.mapInArrow(run, schema)
