"""Embedders: functions from texts to vectors, applied in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import text as X

Embed = Callable[[list[str]], np.ndarray]


def hashed_words(dimension: int = 64, unit: bool = True) -> Embed:
    """A deterministic bag of words: each word adds 1 or -1 at a place that its hash gives; length one if `unit`."""

    codes: dict[str, int] = {}

    def code(word: str) -> int:
        if len(codes) >= STORE_WORDS:
            codes.clear()
        h = zlib.crc32(word.encode())
        codes[word] = c = ((h >> 1) % dimension << 1 | h & 1) + 1  # never 0
        return c

    def embed(texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        said = np.array([codes.get(w) or code(w) for ws in words for w in ws], np.int64) - 1
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        out = np.bincount(row * dimension + (said >> 1), 1.0 - 2 * (said & 1), len(texts) * dimension).reshape(len(texts), dimension).astype(np.float32)
        return scaled(out) if unit else out

    return embed


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; zero vectors stay."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size == 0, 1, size)


#: Distinct words whose hashes an embedder remembers.
STORE_WORDS = 500_000

#: Models by name: how to make one, and its dimension.
EMBEDDERS: dict[str, tuple[Callable[[], Embed], int]] = {"hashed-64": (lambda: hashed_words(64), 64), "hashed-256": (lambda: hashed_words(256), 256), "counted-64": (lambda: hashed_words(64, unit=False), 64)}
DEFAULT = "hashed-64"


def resolve(name: str | None) -> str:
    """The name of a known model; the default one for others."""
    return name if name in EMBEDDERS else DEFAULT


def embed_column(text: Column | str, model: str | None = None, batch: int = 16) -> Column:
    """array<float>: the model is made once for each task, and fed `batch` texts at a time; only those leave Arrow's memory."""
    make, dimension = EMBEDDERS[resolve(model)]
    made: list[Embed] = []

    # Not over an iterator: columns of that kind would each have a worker of their own.
    @F.arrow_udf("array<float>")
    def run(part: pa.Array) -> pa.Array:
        if not made:
            made.append(make())
        vectors = np.empty((len(part), dimension), np.float32)
        for k in range(0, len(part), batch):
            vectors[k : k + batch] = made[0]([t or "" for t in part.slice(k, batch).to_pylist()])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dimension, pa.int32()), pa.array(vectors.ravel(), pa.float32()))

    return run(text)


def embed(df: DataFrame, text: str = "text", model: str | None = None, limit: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Rows with (vector, model, dimension), texts cut to `limit` characters; and the rows whose text is empty."""
    name = resolve(model)
    full = X.strip(F.coalesce(F.col(text), F.lit(""))) != ""
    good = df.filter(full).withColumns({"vector": embed_column(X.truncate(text, limit), name), "model": F.lit(name), "dimension": F.lit(EMBEDDERS[name][1])})
    return good, df.filter(~full)


def _in_batches(embed: Embed, texts: list[str], batch: int, dimension: int) -> np.ndarray:
    rows = [embed(texts[k : k + batch]) for k in range(0, len(texts), batch)]
    found = np.concatenate(rows).astype(np.float32) if rows else np.zeros((0, dimension), np.float32)
    if found.shape != (len(texts), dimension):
        raise ValueError(f"the model gave vectors of shape {found.shape} for {len(texts)} texts of dimension {dimension}")
    return found


def embed_batches(df: DataFrame, texts: str = "texts", metadata: str | None = None, model: str | None = None, normalise: bool = False, batch: int = 16, limit: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Rows with a list of texts, and `report` on each; and the rows that are refused.

    The report is {model, count, dimension, normalised, text_lengths, items}; an item is
    {index, embedding, dimension, model, metadata}.  `metadata` names a list of maps
    beside the texts; items beyond its end have none.  One pass over Arrow batches:
    the texts of all rows at hand are put after one another and given to the model
    `batch` at a time, cut to `limit` characters; text_lengths are those of the whole
    texts.

    An unknown model gives the default one.  A row is refused whose list is null or
    empty or has a null or blank text.  A column `report` is replaced.
    """
    name = resolve(model)
    make, dimension = EMBEDDERS[name]
    blank = F.exists(texts, lambda t: X.strip(F.coalesce(t, F.lit(""))) == "")
    good = F.coalesce(F.size(F.coalesce(F.col(texts), F.array().cast("array<string>"))) > 0, F.lit(False)) & ~F.coalesce(blank, F.lit(False))
    kind = df.schema[metadata].dataType.elementType if metadata else T.MapType(T.StringType(), T.StringType())
    item = T.StructType.fromDDL("index int, embedding array<float>, dimension int, model string").add("metadata", kind)
    report = T.StructType.fromDDL("model string, count int, dimension int, normalised boolean, text_lengths array<int>").add("items", T.ArrayType(item))
    rows = df.filter(good).drop("report")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = make()
        for b in batches:
            lists = b.column(b.schema.get_field_index(texts))
            flat, many = lists.flatten(), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(many)])
            vectors = _in_batches(embed, pa.compute.utf8_slice_codeunits(flat, 0, limit).to_pylist(), batch, dimension)
            vectors = scaled(vectors).astype(np.float32) if normalise else vectors
            index = np.arange(upto[-1]) - np.repeat(upto[:-1], many)
            if metadata:
                given = b.column(b.schema.get_field_index(metadata)).to_pylist()
                notes = [x[i] if x is not None and i < len(x) else None for x, n in zip(given, many.tolist(), strict=True) for i in range(n)]
                notes = pa.array(notes, b.schema.field(metadata).type.value_type)
            else:
                notes = pa.nulls(int(upto[-1]), pa.map_(pa.string(), pa.string()))
            same = lambda x, t, n: pa.array([x] * n, t)
            embeddings = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * dimension, pa.int32()), pa.array(vectors.ravel(), pa.float32()))
            items = pa.StructArray.from_arrays([pa.array(index, pa.int32()), embeddings, same(dimension, pa.int32(), len(index)), same(name, pa.string(), len(index)), notes], names=item.names)
            offsets, n = pa.array(upto, pa.int32()), b.num_rows
            lengths = pa.ListArray.from_arrays(offsets, pa.compute.utf8_length(flat).cast(pa.int32()))
            fields = [same(name, pa.string(), n), pa.array(many, pa.int32()), same(dimension, pa.int32(), n), same(normalise, pa.bool_(), n), lengths, pa.ListArray.from_arrays(offsets, items)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(fields, names=report.names)], names=[*b.schema.names, "report"])

    made = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("report", report)]))
    return made, df.filter(~good)


def embed_with_metadata(df: DataFrame, text: str = "text", metadata: str | None = None, model: str | None = None, normalise: bool = False, limit: int = 8192) -> DataFrame:
    """Adds `record`, {embedding, dimension, model, metadata}, to rows with a text that is not blank; other rows go."""
    one = df.withColumns({"_texts": F.array(text)} | ({"_notes": F.array(metadata)} if metadata else {}))
    made, _ = embed_batches(one, "_texts", "_notes" if metadata else None, model, normalise, limit=limit)
    first = F.col("report.items")[0]
    return made.withColumn("record", F.struct(*(first[n].alias(n) for n in ("embedding", "dimension", "model", "metadata")))).drop("_texts", "_notes", "report")
