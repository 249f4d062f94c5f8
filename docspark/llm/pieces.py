"""SentencePiece encoding and decoding: best-scoring pieces by a max-plus scan.

A text's best segmentation maximises the sum of its pieces' scores.  In the
(max, +) algebra the step from one position to the next is a matrix product, and
products can be grouped at will.  A giant text is cut into chunks; between two
chunks the state is by how many characters the last piece reaches over the
boundary.  Each chunk gives the matrix of best scores from every state at its
beginning to every state at its end; a scan over these matrices gives the exact
scores at every boundary; with them each chunk knows for each state at its end
its best state at its beginning; a scan over these maps from the right gives the
states on the best path; and each chunk traces its own pieces.

Of equal scores the piece that begins first (the longest) wins, at every
position, so that all ways of cutting give the same pieces.

Other texts need no chunks: where no piece of the vocabulary has a space mark
after another character, every run of spaces begins a new piece.  The best
pieces of each distinct word are found once per worker and put together.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.frames import add_columns, free_name, stored
from docspark.llm.tokens import VOCABULARIES, Encoder, encoder
from docspark.llm.words import give_back, slices, utf8

#: Texts of more characters are cut into chunks.
GIANT = 50_000
CHUNK = 8_192
#: Rows of text that Spark hands to Python at once.
HELD_ROWS = 500
MARK = "▁"
NONE = -np.inf


class Vocabulary:
    """Pieces, scores and ids of a SentencePiece model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(library.get_piece_size())
        self.pieces = [library.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i) or library.is_byte(i))]
        self.id = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: library.get_score(i) for i in plain}
        self.byte = {int(self.pieces[i][1:-1], 16): i for i in ids if library.is_byte(i)}
        self.unknown = library.unk_id()
        #: Fixed value: an unknown character scores 10 below the least piece.
        self.unknown_score = min(self.score.values()) - 10
        self.longest = max(map(len, self.id))
        #: Scores of the pieces, and None for what only begins one.
        self.begins = {p[:k]: None for p in self.score for k in range(1, len(p))} | self.score
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        probe = "  Ab éＡ\t\n c "
        if library.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only models that leave texts as they are, but for a space before them, can be encoded")
        self.bytes = [bytes([int(p[1:-1], 16)]) if library.is_byte(i) else b"" if library.is_control(i) else p.encode() for i, p in enumerate(self.pieces)]

    def forward(self, text: str, size: int, entry: list[float]) -> tuple[list[float], list[int]]:
        """Best scores and the piece before each position; entry[s] is the score of beginning at s.

        Pieces begin before `size`; text may go on behind it.  The piece before
        is -1 where the path enters.
        """
        best = [NONE] * (max(len(text), len(entry)) + 1)
        back = [-1] * len(best)
        best[: len(entry)] = entry
        begins, n = self.begins, len(text)
        for i in range(size):
            here = best[i]
            if here == NONE:
                continue
            if begins.get(text[i]) is None and here + self.unknown_score > best[i + 1]:  # a character that is no piece
                best[i + 1], back[i + 1] = here + self.unknown_score, i
            for j in range(i + 1, n + 1):
                s = begins.get(text[i:j], 0)
                if s is None:
                    continue
                if s == 0 and text[i:j] not in begins:
                    break
                if here + s > best[j]:
                    best[j], back[j] = here + s, i
        return best, back

    def trace(self, text: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids of the pieces up to a position, and where the path entered."""
        found: list[int] = []
        while back[end] >= 0:
            begin = back[end]
            piece = text[begin:end]
            one = self.id.get(piece)
            if one is not None:
                found.append(one)
            else:
                found += [self.byte.get(b, self.unknown) for b in reversed(piece.encode())] if self.byte else [self.unknown]
            end = begin
        return found[::-1], end

    def encode(self, text: str) -> list[int]:
        """Ids of a marked text (spaces are marks, one stands before it)."""
        _, back = self.forward(text, len(text), [0.0])
        return self.trace(text, back, len(text))[0]

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Best scores from state s at the beginning of a chunk to state t at its end."""
        n = self.longest
        out = np.full((n, n), NONE)
        if self.splits and (m := re.compile(f"(?<!{MARK}){MARK}").search(text, n, size)):
            # Every path passes the beginning of this word: scores up to it and from it on add up.
            c = m.start()
            upto = [self.forward(text[:c], c, [NONE] * s + [0.0])[0][c] for s in range(n)]
            best = self.forward(text[c:], size - c, [0.0])[0][size - c : size - c + n]
            out[:, : len(best)] = np.add.outer(upto, best)
            return out
        for s in range(n):
            if s >= size:  # the piece reaches over the whole chunk
                if s - size < n:
                    out[s, s - size] = 0
                continue
            entry = [NONE] * s + [0.0]
            best, _ = self.forward(text, size, entry)
            for t, x in enumerate(best[size : size + n]):
                out[s, t] = x
        return out

    def decode(self, ids: np.ndarray) -> str:
        said = b"".join([self.bytes[i] for i in ids]).decode(errors="replace").replace(MARK, " ")
        return said[1:] if said[:1] == " " else said


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two matrices with max for + and + for x."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: np.ndarray) -> np.ndarray:
    """The products of the first 1, 2, ... matrices, by doubling: each round joins runs of twice the length."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = np.stack([max_plus(a, b) for a, b in zip(out[:-step], out[step:], strict=True)])
        step *= 2
    return out


def compose(maps: np.ndarray) -> np.ndarray:
    """For each chunk, its state at the end on the best path; maps[k][t] is chunk k's state at the beginning for t at its end."""
    out, step = maps.copy(), 1
    while step < len(out):  # out[k] maps the state at the end of k + step - 1 to the one at the beginning of k
        out[:-step] = np.take_along_axis(out[:-step], out[step:], 1)
        step *= 2
    return np.append(out[1:, 0], 0)


def space_cuts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As tokens.pieces(), cut before each run of spaces."""
    data, offsets = utf8(texts)
    if not len(data):
        return data, *(np.zeros(0, np.int64),) * 2, np.zeros(len(offsets), np.int64)
    space = data == 0x20
    starts = np.union1d(np.flatnonzero(space[1:] & ~space[:-1]) + 1, offsets[:-1][np.diff(offsets) > 0])
    return data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets, "left")


def _before(texts: pa.Array) -> pa.Array:
    """A space before each text that isn't empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return pa.compute.if_else(pa.compute.equal(texts, nothing), texts, pa.compute.binary_join_element_wise(space, texts, nothing))


def vocabulary(mark: int, model: bytes) -> Vocabulary:
    if mark not in VOCABULARIES:
        VOCABULARIES.clear()
        VOCABULARIES[mark] = Vocabulary(model)
    return VOCABULARIES[mark]


def encode_by_merges(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Adds ids as the library gives them for models of merges, whose order of merging is not a sum of scores.

    For vocabularies whose pieces never go on over a space; nulls, empty tables
    and repeated rows as in encode().
    """
    with open(model, "rb") as f:
        proto = f.read()
    mark, sent = zlib.crc32(proto), docs.sparkSession.sparkContext.broadcast(proto)
    if not Vocabulary(proto).splits:
        raise ValueError("a piece of this vocabulary goes on over a space")

    def fresh() -> Encoder:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=sent.value)
        return Encoder(lambda said: library.encode([x[1:] for x in said], num_threads=1), np.uint32, space_cuts)  # it puts a space before each

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        values, first = encoder(("merges", mark), fresh)(_before(part.column(part.schema.get_field_index(text))))
        return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.astype(np.int32)))]

    return add_columns(docs.drop("ids"), text, "ids array<int>", make)


def encode(docs: DataFrame, model: str, text: str = "text", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """Adds ids (array of int): the best-scoring pieces of each whole text.

    `model` is the path of a SentencePiece model file, read by the driver and
    sent to the tasks.  Characters without a piece become their bytes' pieces.
    A null or empty text has no ids; repeated rows are encoded each; a column
    called ids is replaced; an empty table gives an empty result.
    """
    with open(model, "rb") as f:
        proto = f.read()
    mark, sent = zlib.crc32(proto), docs.sparkSession.sparkContext.broadcast(proto)
    known = Vocabulary(proto)
    if not known.splits:
        giant = min(giant, chunk)
    docs = docs.drop("ids")
    size = F.coalesce(F.length(text), F.lit(0))
    best = _best(mark, sent)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        values, first = best(part.column(part.schema.get_field_index(text)))
        return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.astype(np.int32)))]

    short = add_columns(docs.filter(size <= giant), text, "ids array<int>", make)
    return short.unionByName(_giants(docs.filter(size > giant), mark, sent, known.longest, text, chunk))


def _best(mark: int, sent):
    """A function from an Arrow array of texts to (values, first): the best pieces of text k are values[first[k]:first[k+1]]."""

    def best(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        v, texts = vocabulary(mark, sent.value), _before(texts)
        if v.splits:
            kind = np.uint16 if len(v.pieces) <= 1 << 16 else np.uint32
            fresh = lambda: Encoder(lambda said: [v.encode(x.replace(" ", MARK)) for x in said], kind, space_cuts)
            return encoder(("pieces", mark), fresh)(texts)
        runs = [v.encode(x.replace(" ", MARK)) for x in texts.to_pylist()]
        return np.array([i for r in runs for i in r], np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in runs])])

    return best


def _giants(docs: DataFrame, mark: int, sent, longest: int, text: str, chunk: int) -> DataFrame:
    """The ids of giant texts by the scan; equal texts are encoded once."""
    if chunk < longest:
        raise ValueError("a chunk is at least as long as the longest piece")
    own, told = free_name(docs, "_key"), free_name(docs, "ids")
    keyed = docs.withColumn(own, F.sha2(text, 256))
    texts = keyed.select(F.col(own).alias("_key"), F.col(text).alias("said")).groupBy("_key").agg(F.first("said").alias("said"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                said = MARK + said.replace(" ", MARK)
                starts = range(0, len(said), chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(starts)), pa.array(range(len(starts)), pa.int32()), pa.array([min(chunk, len(said) - a) for a in starts], pa.int32()), pa.array([said[a : a + chunk + longest - 1] for a in starts])],
                    names=["_key", "k", "size", "said"],
                )

    chunks = stored(texts.mapInArrow(cut, "_key string, k int, size int, said string"), "chunks", batch=HELD_ROWS).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key", "k")

    def each(run, name: str, kind: str, source: DataFrame) -> DataFrame:
        """A new column from every chunk."""

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = {"binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
            for batch in batches:
                give_back()
                for part in slices(batch, "said"):
                    rows = [run(vocabulary(mark, sent.value), *r) for r in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, kinds[kind])], names=["_key", "k", name])

        return source.mapInArrow(apply, f"_key string, k int, {name} {kind}")

    n = longest

    def entries(pdf):
        pdf = pdf.sort_values("k")
        done = scan(np.stack([np.frombuffer(x, "<f8").reshape(n, n) for x in pdf.pop("matrix")]))
        start = np.concatenate([[np.where(np.arange(n) == 0, 0.0, NONE)], done[:-1, 0, :]])
        return pdf.assign(entry=[x.tobytes() for x in start])

    def exits(pdf):
        pdf = pdf.sort_values("k")
        maps = np.stack([np.frombuffer(x, "<i4").reshape(n) for x in pdf.pop("states")]).astype(np.int64)
        return pdf.assign(state=compose(maps).astype(np.int32))

    def states(v: Vocabulary, size: int, said: str, entry: bytes) -> bytes:
        _, back = v.forward(said, size, np.frombuffer(entry, "<f8").tolist())
        out = []
        for t in range(n):
            end = size + t
            while end < len(back) and back[end] >= 0:
                end = back[end]
            out.append(min(end, n - 1))
        return np.array(out, "<i4").tobytes()

    def traced(v: Vocabulary, size: int, said: str, entry: bytes, state: int) -> list[int]:
        _, back = v.forward(said, size, np.frombuffer(entry, "<f8").tolist())
        return v.trace(said, back, size + state)[0]

    columns = ["_key", "k", "size", "said"]
    matrices = each(lambda v, size, said: v.matrix(said, size).astype("<f8").tobytes(), "matrix", "binary", chunks)
    entry = matrices.groupBy("_key").applyInPandas(entries, "_key string, k int, entry binary")
    begun = stored(chunks.join(entry, ["_key", "k"]).select(*columns, "entry"), "begun", batch=HELD_ROWS)
    found = each(states, "states", "binary", begun)
    state = found.groupBy("_key").applyInPandas(exits, "_key string, k int, state int")
    ids = each(traced, "part", "array<int>", begun.join(state, ["_key", "k"]).select(*columns, "entry", "state"))
    whole = ids.groupBy("_key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "part"))), lambda x: x["part"])).alias("ids"))
    whole = whole.withColumnsRenamed({"_key": own, "ids": told})
    return keyed.join(whole, own).select(*docs.columns, F.col(told).alias("ids"))


def decode(encoded: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids; null ids give a null text, no ids an empty one."""
    with open(model, "rb") as f:
        proto = f.read()
    mark, sent = zlib.crc32(proto), encoded.sparkSession.sparkContext.broadcast(proto)
    encoded = encoded.drop(name)
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, column = vocabulary(mark, sent.value), batch.column(batch.schema.get_field_index(ids))
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            said = [None if null else v.decode(values[a:b].tolist()) for a, b, null in zip(offsets[:-1], offsets[1:], column.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_ids, ids_sha256, decoded_sha256, round_trip) of documents with doc_id and text.

    The ids are digested and decoded where they are made, so that they need not
    be moved; ids_sha256 is that of the ids as little-endian 32-bit numbers.
    A null or empty text has no ids and decodes to the empty text; repeated rows
    are encoded each; other columns are not returned.
    """
    with open(model, "rb") as f:
        proto = f.read()
    mark, sent = zlib.crc32(proto), docs.sparkSession.sparkContext.broadcast(proto)
    known = Vocabulary(proto)
    giant = giant if known.splits else min(giant, chunk)
    best = _best(mark, sent)
    schema = "doc_id bigint, n_ids bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def digest(doc_id: pa.Array, texts: list, values: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        v, hashed, decoded, same = vocabulary(mark, sent.value), [], [], []
        for text, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist(), strict=True):
            ids = values[a:b]
            said = v.decode(ids.tolist())
            hashed.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            decoded.append(hashlib.sha256(said.encode()).hexdigest())
            same.append(said == (text or ""))
        columns = [doc_id, pa.array(np.diff(first), pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids_sha256", "decoded_sha256", "round_trip"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for part in slices(batch, "text"):
                yield digest(part.column(0), part.column(1).to_pylist(), *best(part.column(1)))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            for part in slices(batch, "text"):
                ids = part.column(2)
                yield digest(part.column(0), part.column(1).to_pylist(), ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False))]))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    giants = _giants(rows.filter(size > giant), mark, sent, known.longest, "text", chunk)
    # Written here, as few rows of text are handed to Python at once; what is written is small.
    return stored(rows.filter(size <= giant).mapInArrow(short, schema).unionByName(giants.mapInArrow(long, schema)), "digests", batch=HELD_ROWS)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
