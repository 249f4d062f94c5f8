"""Column functions on vectors (arrays of numbers); sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("cosine", "dot", "l2")
#: Fixed value: a norm under this is that of a zero vector.
TINY = 1e-10


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero; what is below zero keeps its sign, also where -0.0 is left, as in SQL on doubles."""
    return F.when(x == 0, x).when(x < 0, -F.round(-x, digits)).otherwise(F.round(x, digits))


def normalise(v: Column, zero_below: float = TINY) -> Column:
    """Length one; a vector shorter than `zero_below` becomes zeros."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n < zero_below, 0.0).otherwise(x / n))


def normalise_or_keep(v: Column) -> Column:
    """Length one; a zero vector stays."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n == 0, x).otherwise(x / n))


def cosine(a: Column, b: Column, low: float) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(low), dot(a, b) / n)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the similarity within -1 and 1; 1 if either is a zero vector."""
    return 1 - cosine(a, b, -1.0)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Within 0 and 1; 0 if either is a zero vector."""
    return cosine(a, b, 0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def distance(a: Column, b: Column, kind: str = "cosine") -> Column:
    """The distance of this kind; an error for vectors of different lengths."""
    if kind not in KINDS:
        raise ValueError(f"unknown distance {kind!r}; known are {', '.join(KINDS)}")
    value = {"cosine": cosine_distance, "dot": dot, "l2": euclidean}[kind](a, b)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different lengths")))


def score(d: Column, kind: str = "cosine") -> Column:
    """A distance as a score: the greater the nearer."""
    if kind not in KINDS:
        raise ValueError(f"unknown distance {kind!r}; known are {', '.join(KINDS)}")
    if kind == "cosine":
        return 1 - d
    if kind == "dot":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d + 1) / 2))
    return F.when(d > 10, 0.0001).otherwise(F.exp(-d))


def fault(v: Column, dimension: int) -> Column:
    """Why a vector can't be stored; null if it can."""
    odd = F.exists(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.coalesce(F.size(v), F.lit(-1)) <= 0, "empty").when(F.size(v) != dimension, "dimension").when(odd, "not finite")
