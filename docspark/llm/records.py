"""Length-delimited binary records of token ids, with an offset index.

A record is framed as: its length (8 bytes), the masked checksum of these 8
bytes (4), the payload, the masked checksum of the payload (4); numbers are
little-endian.  The checksum is CRC-32 as in zlib, masked by a rotation and a
constant so that a checksum stored inside data is not its own checksum.

A payload is: one byte (2 or 4: bytes per id; 128 is added for a null document
id), the document id (8), the ids.  Beside each data file lies `<file>.index`
with the offset of every record (8 bytes each), for reads in any order.

A folder of records is named by a manifest: a row per data file with its place
in the order, its documents and its ids.  Each attempt of a task writes files
of its own and only successful attempts are in the manifest, so that lost
executors leave at most files that nobody reads.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.frames import local_uri, shared_folder
from docspark.llm.tokens import Encoder, encoder, forget
from docspark.llm.words import slices

MANIFEST = "part int, file string, documents bigint, ids bigint"
#: Fixed value: the constant of the usual mask for record checksums.
MASK = 0xA282EAD8
READ_BYTES = 4_000_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


class Damaged(ValueError):
    """A record whose length or checksum is wrong."""


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at this offset and the offset of the next one."""
    if at + 12 > len(data):
        raise Damaged("the file ends within a record")
    size = bytes(data[at : at + 8])
    if struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(size):
        raise Damaged("the checksum of a length is wrong")
    end = at + 12 + struct.unpack("<Q", size)[0]
    if end + 4 > len(data):
        raise Damaged("the file ends within a record")
    payload = data[at + 12 : end]
    if struct.unpack("<I", data[end : end + 4])[0] != masked(payload):
        raise Damaged("the checksum of a payload is wrong")
    return payload, end + 4


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = ids.dtype.itemsize
    return struct.pack("<Bq", width | (128 if doc_id is None else 0), doc_id or 0) + ids.tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    kind, doc_id = struct.unpack("<Bq", payload[:9])
    return None if kind & 128 else doc_id, np.frombuffer(payload[9:], "<u2" if kind & 127 == 2 else "<u4")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(local_uri(uri))


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Encodes documents and writes them in ascending order of doc_id; returns the manifest.

    The rows are range-partitioned by doc_id (ties by a hash of the text, so
    that a frequent id is divided), sorted, and each partition writes one data
    file and its index while it encodes.  `end_id` follows each document.

    A null text is empty and gives just `end_id`; null ids come first; rows of
    the same id stand in an order fixed by their texts; special strings in texts
    become what the tokenizer's default makes of them; an empty table writes no
    file and gives an empty manifest; further columns are not written.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    sent, mark = spark.sparkContext.broadcast(spec), zlib.crc32(spec.encode())
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def fresh() -> Encoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(sent.value)
        kind = np.uint16 if library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.uint32
        return Encoder(lambda said: [x.ids for x in library.encode_batch_fast(said, add_special_tokens=False)], kind)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}-{uuid.uuid4().hex}.records"
        system, top = _open(folder)
        encode = encoder(("ids", mark, end_id), fresh)
        out, offsets, at, ids = None, [], 0, 0
        for batch in batches:
            for piece in slices(batch, "text"):
                if out is None:
                    system.create_dir(top, recursive=True)
                    out = system.open_output_stream(f"{top}/{name}")
                values, first = encode(piece.column(1))
                ends = np.insert(values, first[1:], end_id)  # after each document's ids
                first = first + np.arange(len(first))
                frames = [frame(pack(key, ends[a:b])) for key, a, b in zip(piece.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
                offsets.append(at + np.concatenate([[0], np.cumsum([len(x) for x in frames[:-1]], dtype=np.int64)]).astype("<i8"))
                at += sum(map(len, frames))
                ids += int(first[-1])
                out.write(b"".join(frames))
        if out is not None:
            out.close()
            index = np.concatenate(offsets)
            with system.open_output_stream(f"{top}/{name}.index") as f:
                f.write(index.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([ids], pa.int64())], names=["part", "file", "documents", "ids"])

    tie = F.xxhash64("text")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    # The manifest has a row per file; it is collected so that the files are written once.
    files = sorted(tuple(r) for r in rows.mapInArrow(write, MANIFEST).collect())
    return spark.createDataFrame(files, MANIFEST)


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids): the records of a folder, checked; start counts the ids of all documents before."""
    spark = manifest.sparkSession
    files, before = [], 0
    for part, name, _, ids in sorted(tuple(r) for r in manifest.collect()):
        files.append((len(files), name, before))
        before += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        system, top = _open(folder)
        for batch in batches:
            for name, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with system.open_input_stream(f"{top}/{name}") as f:
                    rest = b""
                    while True:
                        block = f.read(READ_BYTES)
                        data, at = memoryview(rest + block), 0
                        keys, runs = [], []
                        while at + 12 <= len(data):
                            if at + 16 + struct.unpack("<Q", data[at : at + 8])[0] > len(data) and block:
                                if struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(bytes(data[at : at + 8])):
                                    raise Damaged("the checksum of a length is wrong")
                                break  # the record goes on in the next block
                            payload, at = unframe(data, at)
                            key, ids = unpack(payload)
                            keys.append(key)
                            runs.append(ids)
                        if keys:
                            yield _rows(keys, runs, start)
                            start += sum(map(len, runs))
                        rest = bytes(data[at:])
                        if not block:
                            if rest:
                                raise Damaged("the file ends within a record")
                            break

    rows = spark.createDataFrame(files, "part int, file string, start bigint").repartitionById(max(1, len(files)), "part")
    return rows.mapInArrow(read, "doc_id bigint, start bigint, ids array<int>")


def read_shuffled(manifest: DataFrame, folder: str, seed: int) -> DataFrame:
    """(doc_id, ids) of all records in an order that `seed` fixes, by seeks through the index files."""
    spark = manifest.sparkSession

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{top}/{name}.index") as f:
                    offsets = np.frombuffer(f.read(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(offsets), pa.string()), pa.array(offsets, pa.int64())], names=["file", "offset"])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(folder)
        for batch in batches:
            found: list = [None] * batch.num_rows
            names, offsets = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in dict.fromkeys(names):
                with system.open_input_file(f"{top}/{name}") as f:
                    for i in (i for i, x in enumerate(names) if x == name):
                        f.seek(offsets[i])
                        head = f.read(12)
                        size = struct.unpack("<Q", head[:8])[0] if len(head) == 12 else 0
                        found[i] = unpack(unframe(memoryview(head + f.read(size + 4)), 0)[0])
            yield _rows([k for k, _ in found], [ids for _, ids in found], 0).drop_columns(["start"])

    where = manifest.select("file").mapInArrow(index, "file string, offset bigint")
    mixed = where.withColumn("place", F.xxhash64("file", "offset", F.lit(seed))).orderBy("place", "file", "offset")
    return mixed.select("file", "offset").mapInArrow(seek, "doc_id bigint, ids array<int>")


def _rows(keys: list, runs: list[np.ndarray], start: int) -> pa.RecordBatch:
    upto = np.concatenate([[0], np.cumsum([len(x) for x in runs], dtype=np.int64)])
    ids = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *runs]).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start + upto[:-1], pa.int64()), ids], names=["doc_id", "start", "ids"])


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = shared_folder(spark, "records")
    manifest = write_records(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            values, offsets = batch.column(2).values.to_numpy().astype("<u4"), batch.column(2).offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_records(manifest, folder).mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
