"""The relative Lempel-Ziv parse: factors, sources and boundaries, over many small blocks."""

import random
from collections import Counter
from functools import partial

import pytest

from docspark.llm import substrings
from docspark.llm.blocks import pack, unpack
from docspark.llm.words import white_words


def covered(texts, n):
    """Words in windows that occur twice anywhere."""
    words = [(t or "").split() for t in texts]
    times = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    return [sorted({i + k for i in range(len(w) - n + 1) if times[tuple(w[i : i + n])] > 1 for k in range(n)}) for w in words]


def passages(seed, n):
    """Texts of fresh words with shared passages: alone, after one another, cut short, overlapping, within one text."""
    rng = random.Random(seed)
    fresh = iter(range(10**6))
    new = lambda k: [f"u{next(fresh)}" for _ in range(k)]
    shared = [new(rng.randint(n - 6, 3 * n)) for _ in range(12)]
    texts = []
    for _ in range(160):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += new(rng.choice([0, 1, 5, 30]))
            p = rng.choice(shared)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            parts += rng.choice([p, p[a:], p[:b], p[a:b], p + p])
        texts.append(" ".join(parts))
    return texts + [texts[3], texts[3], None, "", " ".join(["same"] * (3 * n)), "x " * (n + 1)]


@pytest.mark.parametrize("n", [35, 12, 20])
@pytest.mark.parametrize("size", [1_000, 6_000, 10**6])
def test_words_of_factors_and_boundaries(spark, monkeypatch, n, size):
    monkeypatch.setattr(substrings, "pack", partial(pack, size=size))
    texts = passages(n, n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [i for a, b in zip(r.spans[::2], r.spans[1::2], strict=True) for i in range(a, b)] for r in substrings.duplicate_spans(docs, n=n).collect()}
    want = covered(texts, n)
    assert [got[i] for i in range(len(texts))] == want


def test_factors_name_their_sources(spark, monkeypatch):
    n = 20
    monkeypatch.setattr(substrings, "pack", partial(pack, size=2_000))
    texts = passages(5, n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    blocks, found = substrings.factors(docs, n=n)
    words = {r.block: white_words(unpack(r.rows).column(1)) for r in blocks.collect()}
    said = {k: w.text(0, len(w.starts)) for k, w in words.items()}
    bounds = {k: set(w.first.tolist()) for k, w in words.items()}
    rows = found.collect()
    assert len(words) > 10 and len(rows) > 50
    for r in rows:
        size = r.end - r.begin
        assert size >= n and (r.block, r.begin) != (r.source, r["at"])
        assert said[r.block][r.begin : r.end] == said[r.source][r["at"] : r["at"] + size]
        for k, begin in ((r.block, r.begin), (r.source, r["at"])):  # each side lies in one text
            assert not bounds[k] & set(range(begin + 1, begin + size))
    # A passage that all blocks have is read in each of them about as often as it is factored there: no source is asked by all.
    asked = Counter((r.source, r["at"]) for r in rows)
    assert max(asked.values()) <= 12
    # Most repeated words lie in factors; the rest are found at the boundaries.
    inside = {(r.block, i) for r in rows for i in range(r.begin, r.end)}
    total = sum(map(len, covered(texts, n)))
    assert len(inside) > 0.5 * total
