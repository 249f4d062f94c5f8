"""What leaves a pair of blocks, and how much is held there."""

import numpy as np

from docspark.operators import search as S


def best(q_ids, c_ids, scores, k, digits, least):
    rows = []
    for q, row in zip(q_ids, np.round(scores, digits), strict=True):
        found = sorted((-s, c) for s, c in zip(row, c_ids, strict=True) if s >= least)
        rows += [(q, c, -s) for s, c in (found[:k] if k > 0 else found)]
    return rows


def test_found():
    rng = np.random.default_rng(3)
    c_ids = rng.permutation(40)
    for digits in (1, 6):  # with one digit nearly all are ties
        scores = rng.uniform(-1, 1, (7, 40))
        for k in (0, 1, 5, 39, 40, 60):
            for least in (-1.0, 0.0, 0.5, 2.0):
                got = S._found(np.arange(7), c_ids, scores, k, digits, least).to_pydict()
                assert list(zip(got["question_id"], got["id"], got["score"], strict=True)) == best(range(7), c_ids, scores, k, digits, least)
    scores[2, 3] = np.nan
    assert c_ids[3] not in S._found(np.arange(2, 3), c_ids, scores[2:3], 0, 6, -1.0).to_pydict()["id"]


def test_scores_at_a_time(monkeypatch):
    parts = list(S._few(4096, 4096))
    assert max(len(range(4096)[p]) for p in parts) * 4096 <= S.SCORES and sum(len(range(4096)[p]) for p in parts) == 4096
    assert [len(range(3)[p]) for p in S._few(3, 10 * S.SCORES)] == [1, 1, 1] and not list(S._few(0, 5))


def vectors(spark, n, copies=0):
    rng = np.random.default_rng(n)
    m = rng.standard_normal((n, 8)).astype(np.float32)
    m[:copies] = m[0]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vector array<float>"), m.astype(float)


def test_hyperplanes(spark, monkeypatch):
    """The best of all pairs with a key in common, without a row for each pair; blocks smaller than the buckets."""
    monkeypatch.setattr(S, "BLOCK", 16)
    chunks, m = vectors(spark, 300, copies=60)
    found = S.lsh_neighbours(chunks.repartition(3), chunks.filter("id % 10 = 0"), k=4, bits=4, tables=3)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    planes = np.random.Generator(np.random.PCG64(7)).standard_normal((8, 12))
    signs = (unit @ planes > 0).reshape(300, 3, 4)
    want = []
    for q in range(0, 300, 10):
        near = np.flatnonzero(((signs != signs[q]).sum(2) <= 1).any(1))
        ranked = sorted((-round(float(unit[q] @ unit[c]), 6), c) for c in near)[:4]
        want += [(q, int(c), -s, r + 1) for r, (s, c) in enumerate(ranked)]
    assert sorted((r.question_id, r.id, r.score, r["rank"]) for r in found.collect()) == sorted(want)


def test_inverted_lists_in_blocks(spark, monkeypatch):
    """No row for a question and a list; the same however the blocks are cut and met."""
    chunks, _ = vectors(spark, 300, copies=60)
    search = lambda: S.inverted_lists(chunks, chunks.filter("id % 10 = 0"), k=4)
    assert "Generate" not in search()._jdf.queryExecution().executedPlan().toString()
    whole = sorted(map(tuple, search().collect()))
    for name, value in (("BLOCK", 16), ("SCORES", 64), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(S, name, value)
    assert sorted(map(tuple, search().collect())) == whole and len(whole) == 120
