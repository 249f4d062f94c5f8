"""Chunks against plain versions: packing, dispatch, and semantic cuts."""

import random
import re
import time

import numpy as np
import pytest

from docspark.functions import chunks as C
from docspark.functions import packing as P
from docspark.operators.embed import hashed_words
from docspark.operators.semantic import semantic_chunks

PIECES = ["word ", "a. ", "b! ", "。", "中文", "，", "\n\n", "\n", "long" * 9, ", ", " ", "x", "? ", "\t", "　", "é"]


def packed(text, kind, size, overlap):
    """Greedy by whole sums at every step."""
    inner = text.strip()
    parts = P.parts(inner, P.LEVELS[kind], size)
    fits = lambda a, b, most: P.tokens(sum(w for *_, w in parts[a:b]), sum(e - s for s, e, _ in parts[a:b])) <= most
    out, i = [], 0
    while i < len(parts):
        j = i + 1
        while j < len(parts) and fits(i, j + 1, size):
            j += 1
        out.append(inner[parts[i][0] : parts[j - 1][1]].strip())
        if j == len(parts):
            break
        k = i + 1
        while k < j and not (fits(k, j, overlap) and fits(k, j + 1, size)):
            k += 1
        i = k
    return [x for x in out if x]


def test_packing_is_greedy_and_bounded():
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 70)))
        size = rng.randint(1, 12)
        overlap = rng.randrange(size)
        for kind, levels in P.LEVELS.items():
            got = [text[a:b] for a, b in P.pack(text, kind, size, overlap)]
            assert got == packed(text, kind, size, overlap)
            assert all(P.tokens(len(c.split()), len(c)) <= size for c in got)
            inner = text.strip()
            spans = P.parts(inner, levels, size)
            assert "".join(inner[b:e] for b, e, _ in spans) == inner  # nothing is lost or moved


def test_parts_of_a_plain_text():
    text = "One. Two three! Four"
    assert [text[b:e] for b, e, _ in P.parts(text, P.LEVELS["sentence"], 10)] == ["One. ", "Two three! ", "Four"]
    assert [text[b:e] for b, e, _ in P.parts(text, P.LEVELS["sentence"], 1)] == ["One. ", "Two ", "three! ", "Four"]
    para = "a b\n\nc, d e"
    assert [para[b:e] for b, e, _ in P.parts(para, P.LEVELS["paragraph"], 3)] == ["a b\n\n", "c, d e"]
    assert [para[b:e] for b, e, _ in P.parts(para, P.LEVELS["paragraph"], 2)] == ["a b\n\n", "c, ", "d e"]


def test_no_chunk_is_over_its_size(spark):
    texts = ["x" * 50_000, "word " * 20_000, "汉字" * 9000, "一句。" * 5000, "", None, " \n "]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id int, text string, index string").withColumnRenamed("index", "more")
    for kind in ("sentence", "paragraph"):
        rows = C.chunk(df, kind, 1000, 200).collect()
        assert {r.doc_id for r in rows} == {0, 1, 2, 3} and {r.more for r in rows} == {"kept"}
        assert all(P.tokens(len(r.text.split()), len(r.text)) <= 1000 for r in rows)
        for i in range(4):
            assert sorted(r["index"] for r in rows if r.doc_id == i) == list(range(sum(r.doc_id == i for r in rows)))
    assert not C.sentence_chunks(df.limit(0)).collect()


def test_packing_grows_with_the_text():
    def took(n):
        text = "A sentence of some words here. " * n
        begin = time.perf_counter()
        P.pack(text, "sentence", 1000, 200)
        return time.perf_counter() - begin

    took(1000)
    assert took(64_000) < 16 * max(took(16_000), 0.02)


def test_dispatch(spark):
    text = "One two. Three four five.\n\nSix seven eight nine. " * 20
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    one = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert one(C.chunk(df, "token", 9, 2)) == one(C.token_chunks(df, 9, 2))
    assert one(C.chunk(df, "sentence", 9, 2)) == one(C.sentence_chunks(df, 9, 2))
    assert one(C.chunk(df, "hierarchical", 16, 2)) == one(C.hierarchical_chunks(df, 16, 2))
    for kind, overlap in (("paragraph", 2), ("no such kind", 2), ("semantic", 2), ("hierarchical", 4)):
        assert one(C.chunk(df, kind, 16, overlap)) == one(C.paragraph_chunks(df, 16, overlap))
    assert one(C.chunk(df, "semantic", model="hashed-64")) == one(semantic_chunks(df))
    with pytest.raises(ValueError):
        C.hierarchical_chunks(df, 16, 4)


def test_semantic_chunks(spark):
    """Neighbouring groups of three sentences, cut where their distance is above the 95th percentile."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(" ".join(rng.choices(words[20 * t : 20 * t + 20], k=6)).capitalize() + "." for t in [0] * 9 + [1] * 8 + [2] * 11) for _ in range(3)] + ["Only one.", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = []
    for i, text in enumerate(texts):
        said = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]
        groups = [" ".join(said[max(0, k - 1) : k + 2]) for k in range(len(said))]
        v = hashed_words(64)(groups).astype(float) if groups else np.zeros((0, 64))
        far = [round(1 - float(np.clip(a @ b / np.linalg.norm(a) / np.linalg.norm(b), -1, 1)), 6) for a, b in zip(v, v[1:], strict=False)]
        chunk, parts = 0, {}
        for k, s in enumerate(said):
            chunk += bool(k and far[k - 1] > np.quantile(far, 0.95))
            parts.setdefault(chunk, []).append(s)
        want += [(i, k, " ".join(x)) for k, x in parts.items()]
    assert sorted(tuple(r) for r in semantic_chunks(df).collect()) == sorted(want)


def test_semantic_chunks_of_many_sentences(spark):
    df = spark.createDataFrame([(1, "Some words stand here. " * 16_000)], "doc_id int, text string")
    begin = time.perf_counter()
    rows = semantic_chunks(df).collect()
    assert sum(len(r.text.split(". ")) for r in rows) == 16_000
    assert time.perf_counter() - begin < 60
