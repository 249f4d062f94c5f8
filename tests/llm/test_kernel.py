"""The blended-spectrum presence kernel and its ridge regression, by sets and dense algebra."""

import re

import numpy as np

from docspark.llm import langid

TEXTS = {
    "de": ["Der Hund läuft über die Straße.", "Ein kleines Haus am See", "Wir fahren morgen nach Köln!"],
    "en": ["The dog runs across the street.", "A small house by the lake", "We go to Cologne tomorrow!"],
    "fr": ["Le chien court à travers la rue.", "Une petite maison au bord du lac"],
}
ASKED = ["The house by the street", "Die Straße am See", "la rue du chien", "", "12 34", "zzz qqq xxx", "Ω≈ç", "The The The The", "a"]


def spectrum(text):
    """All different byte n-grams, n = 1 to 4, of the folded text between spaces."""
    folded = re.sub(rb"[^a-z\x80-\xff]", b" ", text.lower().encode())
    line = re.sub(rb" +", b" ", b" " + folded + b" ")
    return {line[i : i + n] for n in range(1, 5) for i in range(len(line) - n + 1)}


def kernel(a, b):
    a, b = spectrum(a), spectrum(b)
    return len(a & b) / np.sqrt(len(a) * len(b))


def test_kernel_and_regression(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in TEXTS.items() for t in ts)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(TEXTS)
    # The landmarks are all training texts; their order is found by their kernel with each text.
    said, sizes, _ = model.presence([t for _, t, _ in rows])
    ours = said @ model.landmarks.T / np.sqrt(sizes)[:, None]
    order = ours.argmax(0)
    assert sorted(order) == list(range(len(rows))) and np.allclose(ours.max(0), 1)
    texts, label = [rows[i][1] for i in order], np.array([model.languages.index(rows[i][2]) for i in order])
    found, sizes, _ = model.presence(ASKED)
    assert [int(n) for n in sizes] == [len(spectrum(t)) for t in ASKED]
    want = np.array([[kernel(a, t) for t in texts] for a in ASKED])
    assert np.allclose(found @ model.landmarks.T / np.sqrt(np.maximum(sizes, 1))[:, None], want, atol=1e-6)
    # With every text a landmark the regression is plain weighted kernel ridge regression.
    k = np.array([[kernel(a, b) for b in texts] for a in texts])
    values, vectors = np.linalg.eigh(k)
    mapped = k @ (vectors / np.sqrt(values))
    target = np.where(label[:, None] == np.arange(3), 1.0, -1.0)
    weight = (1 / np.bincount(label))[label][:, None]
    solved = np.linalg.solve(mapped.T @ (weight * mapped) + 3 * langid.RIDGE * np.eye(len(texts)), mapped.T @ (weight * target))
    assert np.allclose(model.scores(ASKED)[0], want @ (vectors / np.sqrt(values)) @ solved, atol=1e-3)


def test_tables_of_features_find_all():
    rng = np.random.Generator(np.random.PCG64(3))
    grams = np.unique(rng.integers(0, 2**32, 60_000, dtype=np.uint32))
    features = langid.Features(grams[::2])
    assert len(features.tables) > 1
    assert (features.find(grams[::2]) == np.arange(len(grams[::2]))).all()
    assert (features.find(grams[1::2]) == -1).all()
    assert (langid.Features(grams[:0]).find(grams[:9]) == -1).all()
