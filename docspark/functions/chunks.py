"""Cutting texts into chunks: one row in, one row for each chunk out.

Tokens are what white space separates; a sentence ends after `.`, `!`, `?` or
their CJK forms followed by white space (after CJK forms, by anything).
Sentence and paragraph chunks count tokens as `functions.text.estimate_tokens`
does, so that scripts without spaces and very long words have a size too.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.functions.packing import packed_chunks

SIZE, OVERLAP = 1000, 200
KINDS = ("sentence", "token", "paragraph", "semantic", "hierarchical")


def check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("a chunk's size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and less than the size")


def window_count(n: Column, size: int, overlap: int) -> Column:
    """Windows over n tokens; 0 without tokens."""
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - overlap) / (size - overlap)))).cast("int")


def token_chunks(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """(…, index, begin, text): windows of `size` tokens that share `overlap` with the one before."""
    check(size, overlap)
    kept = [c for c in df.columns if c != text]
    tokens = df.select(*kept, X.words(text).alias("_tokens")).filter(F.size("_tokens") > 0)
    windows = window_count(F.size("_tokens"), size, overlap)
    index = F.explode(F.sequence(F.lit(0), windows - 1)).alias("index")
    cut = tokens.select(*kept, "_tokens", index).withColumn("begin", F.col("index") * (size - overlap))
    return cut.select(*kept, "index", "begin", F.array_join(F.slice("_tokens", F.col("begin") + 1, F.lit(size)), " ").alias(text))


def sentence_chunks(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """(…, index, text): sentences put together while they fit in `size` tokens; a chunk begins with the last ones of the chunk before that fit in `overlap`.

    A sentence that doesn't fit is cut into clauses, these into words, and a
    word into runs of characters, so that no chunk has more than `size` tokens.
    """
    check(size, overlap)
    return packed_chunks(df, "sentence", size, overlap, text)


def paragraph_chunks(df: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """The same for paragraphs, which are cut into sentences where they don't fit."""
    check(size, overlap)
    return packed_chunks(df, "paragraph", size, overlap, text)


def _windows(begin: Column, n: Column, width: int, overlap: int, index: Column) -> Column:
    """Windows over n tokens from `begin` on, as an array of structs."""
    step = width - overlap
    return F.transform(
        F.sequence(F.lit(0), window_count(n, width, overlap) - 1),
        lambda i: F.struct((begin + i * step).alias("begin"), F.least(F.lit(width), n - i * step).alias("n"), index.alias("parent_index")),
    )


def hierarchical_chunks(df: DataFrame, size: int = SIZE, overlap: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, level, index, parent_index, begin, end, text): token windows of size, size/2 and size/4 that overlap.

    The windows of a level lie within those of the level above, their parents; a
    window's tokens are begin to end - 1 of the text.
    """
    check(max(1, size >> 2), overlap)
    tokens = df.select(key, X.words(text).alias("_tokens")).filter(F.size("_tokens") > 0)
    none = F.lit(None).cast("int")
    tokens = tokens.withColumn("_level0", _windows(F.lit(0), F.size("_tokens"), size, overlap, none))
    for level in (1, 2):
        width = max(1, size >> level)
        within = partial(_windows, width=width, overlap=overlap)
        below = F.transform(f"_level{level - 1}", lambda w, i: within(w["begin"], w["n"], index=i))  # noqa: B023
        tokens = tokens.withColumn(f"_level{level}", F.flatten(below))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"_level{k}").alias("windows")) for k in range(3)))
    rows = tokens.select(key, "_tokens", F.explode(levels).alias("_l")).select(key, "_tokens", "_l.level", F.posexplode("_l.windows").alias("index", "_w"))
    cut = F.array_join(F.slice("_tokens", F.col("_w.begin") + 1, F.col("_w.n")), " ")
    return rows.select(key, "level", "index", "_w.parent_index", "_w.begin", (F.col("_w.begin") + F.col("_w.n")).alias("end"), cut.alias(text))


def chunk(df: DataFrame, kind: str = "sentence", size: int = SIZE, overlap: int = OVERLAP, text: str = "text", key: str = "doc_id", model: str | None = None) -> DataFrame:
    """By the name of the kind; an unknown one is cut by paragraphs, as are a semantic cut without a model and a hierarchical one whose overlap fills its smallest windows."""
    if kind == "token":
        return token_chunks(df, size, overlap, text)
    if kind == "sentence":
        return sentence_chunks(df, size, overlap, text)
    if kind == "hierarchical" and overlap < max(1, size >> 2):
        return hierarchical_chunks(df, size, overlap, key, text)
    if kind == "semantic" and model is not None:
        from docspark.operators.semantic import semantic_chunks

        return semantic_chunks(df, model, text)
    return paragraph_chunks(df, size, overlap, text)


def statistics(df: DataFrame, kind: str, text: str = "text") -> DataFrame:
    return df.withColumns({"chars": X.raw_length(text), "words": X.count_words(text), "chunk_type": F.lit(kind)})


def estimate(length: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    step = max(1, size - overlap)
    return F.when(F.coalesce(length, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(length / step))).cast("bigint")


def for_embedding(text: Column, index: Column, metadata: Column) -> Column:
    """The chunk with defaults: empty text, index -1, and chars and words where the metadata lacks them."""
    t, m = F.coalesce(text, F.lit("")), F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    counts = F.create_map(F.lit("chars"), X.count_chars(t).cast("string"), F.lit("words"), X.count_words(t).cast("string"))
    missing = F.map_filter(counts, lambda k, v: ~F.map_contains_key(m, k))
    return F.struct(t.alias("text"), F.coalesce(index, F.lit(-1)).alias("index"), F.map_concat(m, missing).alias("metadata"))


def chunk_id(file_id: Column, index: Column) -> Column:
    return F.concat_ws("_", file_id, index.cast("string"))
