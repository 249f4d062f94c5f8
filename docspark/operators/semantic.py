"""Semantic chunks: cuts where neighbouring groups of sentences are far apart."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import vector as V
from docspark.functions.packing import chunked, sentences
from docspark.operators.embed import EMBEDDERS, Embed, resolve


def breakpoints(df: DataFrame, key: str, position: str, vector: str, percent: float = 0.95) -> DataFrame:
    """Adds distance (to the row before) and chunk (a number that grows where the distance is above the key's percentile)."""
    w = Window.partitionBy(key).orderBy(position)
    rows = df.withColumn("_before", F.lag(vector).over(w))
    rows = rows.withColumn("distance", F.when(F.col("_before").isNotNull(), F.round(V.cosine_distance(F.col(vector), F.col("_before")), 6))).drop("_before")
    limit = rows.groupBy(key).agg(F.percentile("distance", F.lit(percent)).alias("_limit"))
    rows = rows.join(limit, key)
    far = F.when(F.col("distance") > F.col("_limit"), 1).otherwise(0)
    return rows.withColumn("chunk", F.sum(far).over(w).cast("bigint")).drop("_limit")


def _cut_text(text: str, embed: Embed, buffer: int, percent: float, together: int) -> list[str]:
    said = sentences(text)
    if len(said) < 2:
        return said
    groups = [" ".join(said[max(0, k - buffer) : k + buffer + 1]) for k in range(len(said))]
    v = np.concatenate([embed(groups[k : k + together]) for k in range(0, len(groups), together)]).astype(np.float64)
    size = np.linalg.norm(v, axis=1)
    size = size[1:] * size[:-1]
    near = np.where(size == 0, 0, np.einsum("ij,ij->i", v[1:], v[:-1]) / np.where(size == 0, 1, size))
    distance = np.round(1 - np.clip(near, -1, 1), 6)
    cuts = [0, *(np.flatnonzero(distance > np.quantile(distance, percent)) + 1).tolist(), len(said)]
    return [" ".join(said[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def semantic_chunks(df: DataFrame, model: str | None = None, text: str = "text", buffer: int = 1, percent: float = 0.95, together: int = 256) -> DataFrame:
    """(…, index, text): texts cut between neighbouring groups of sentences whose vectors are farther apart than `percent` of the text's neighbours are.

    Each sentence is embedded by the model of that name with `buffer` neighbours on
    each side, `together` at a time.  One pass in Arrow batches without a shuffle; the work
    grows with the number of sentences.  A text of one sentence is one chunk; one
    without a sentence, empty or null has none; other columns stay.
    """
    make = EMBEDDERS[resolve(model)][0]
    return chunked(df, text, lambda: partial(_cut_text, embed=make(), buffer=buffer, percent=percent, together=together))
