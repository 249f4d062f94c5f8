"""What a Python worker keeps from task to task is bounded, and its results don't depend on it."""

import numpy as np
import pyarrow as pa

from docspark.llm import pieces, tokens
from docspark.llm.tokens import Encoder, Store
from docspark.llm.words import Hasher, white_words


def test_store_finds_every_run_in_whatever_order_keys_come():
    rng = np.random.default_rng(1)
    keys = rng.permutation(np.unique(rng.integers(0, 2**63, 90_000).astype(np.uint64)))
    store = Store(np.uint16)
    for some in np.array_split(keys, 13):
        some = np.sort(some)
        store.add(some, [[int(k % 65_521)] * int(k % 4) for k in some])
    at, size = store.find(keys)
    assert len(store) == len(keys) and (size == keys % 4).all()
    assert (store.pool[at[size > 0]] == keys[size > 0] % 65_521).all()
    assert (store.find(np.setdiff1d(keys + np.uint64(1), keys))[0] == -1).all()


def test_pieces_with_long_runs_do_not_fill_the_memory(monkeypatch):
    monkeypatch.setattr(tokens, "STORE_BYTES", 1_000_000)
    encoder, held = Encoder(lambda said: [[len(x)] * 10_000 for x in said]), []
    for k in range(100):
        said = [f"a{k} b{k}", f"a{k} c"]
        values, first = encoder(pa.array(said))
        want = [len(x) for text in said for x in (text.split()[0], " " + text.split()[1])]
        assert values[::10_000].tolist() == want and first.tolist() == [0, 20_000, 40_000]
        held.append(encoder.store.nbytes)
    assert max(held) < 2_000_000  # 300 pieces of 40,000 bytes


def test_two_hashers_at_most_keep_their_powers():
    hashers, words = [Hasher(k) for k in range(5)], white_words(pa.array(["a b a", "b"]))
    before = [h.ranges(words.data, words.starts, words.ends) for h in hashers]
    assert sum(len(h.powers) > 1 for h in hashers) == 2
    again = [h.ranges(words.data, words.starts, words.ends) for h in hashers]
    assert all((x == y).all() for x, y in zip(before, again, strict=True))
    assert before[0][0] == before[0][2] != before[0][1] == before[0][3]


def test_vocabularies_go_with_the_encoders():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    kept = pieces.vocabulary(1, model)
    assert pieces.vocabulary(1, model) is kept
    tokens.forget()
    assert pieces.vocabulary(1, model) is not kept


def test_the_driver_holds_a_part_of_the_sample_at_a_time(spark):
    """The matrix of the training sample is several times the landmarks'; only these are whole on the driver."""
    import tracemalloc

    from docspark.llm import langid

    rng = np.random.default_rng(2)
    rows = [(k, lang, " ".join("".join(rng.choice(list(letters), 6)) for _ in range(60))) for lang, letters in (("a", "abcdefghij"), ("b", "klmnopqrst")) for k in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    tracemalloc.start()
    model = langid.train(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tables = sum(x.nbytes + y.nbytes for _, x, y in model.features.tables)
    assert model.landmarks.shape[0] == 100
    assert peak - tables < 8 * model.landmarks.shape[1] * 500  # a row of 8-byte numbers for each of 500 texts
