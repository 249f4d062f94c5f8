"""Quality rules, the prefix trie and the tokenizer alignment, each against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from docspark.llm import align, prefix_trie, rules
from docspark.llm.bpe_count import byte_symbols

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a\nb\na\n", "x y z x y z x y z x y z", "été # 中文 $$\n \n# a\n# a", "a\x00b \x1c c d", "same line\nsame line\r\nsame line\r\n", "one two " * 400, "é" * 3000]


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_statistics_of_odd_texts(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "\n", "# ", "é", "\t"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r[n] for n in rules.NAMES) for r in rules.rule_statistics(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [statistics(t) for t in texts]


def test_paths_of_a_forest():
    rng = np.random.Generator(np.random.PCG64(1))
    x = rng.normal(size=(500, 3))
    forest = rules.grow(x, trees=7, tree_rows=64)
    some = np.concatenate([x[:40], [[9.0, 9, 9], [0, 0, 0]]])

    def path(t, row):
        node = 1
        for _ in range(forest.depth):
            node = 2 * node + int(row[forest.feature[t, node]] >= forest.cut[t, node])
        return forest.path[t, node]

    harmonic = lambda n: sum(1 / k for k in range(1, n + 1))
    usual = 2 * harmonic(63) - 2 * 63 / 64
    assert rules.usual_path(64) == pytest.approx(usual, abs=0.02)
    want = [2 ** (-sum(path(t, r) for t in range(7)) / 7 / rules.usual_path(64)) for r in some]
    assert np.allclose(forest.scores(some), want)
    assert forest.scores(some)[40] > max(0.6, np.median(want))  # far from all others
    assert np.allclose(rules.grow(np.zeros((5, 2))).scores(np.zeros((1, 2))), 0.5)  # equal rows can't be told apart


def test_quality_verdicts(spark):
    df = rules.op11_quality_rules(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in df) == sorted(texts)
    for r in df:
        n, chars, symbols, _, dup, repeat = statistics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (r["base_failed"] and r["kept"])


def test_quality_finds_junk_and_keeps_the_rest(spark):
    """Learned on even ids of a larger table, judged on the odd ones."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = rules.rule_statistics(docs).drop("text")
    model = rules.fit(held, labels.filter("doc_id % 2 = 0"))
    judged = rules.judge(held, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r["kept"] for r in judged if r["quality"] == 1 and not r["base_failed"]], [r["kept"] for r in judged if r["quality"] == 0]
    assert np.mean(good) >= 0.98
    assert np.mean(bad) <= 0.1


def test_quality_odd_tables(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(None, words), (1, None), (1, words), (2, words + " " + "# " * 40), (2, "")]
    docs = spark.createDataFrame([(*r, i, 0.5) for i, r in enumerate(rows)], "doc_id bigint, text string, kept int, n_words double")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 0), (7, 1)], "doc_id bigint, quality int")
    for given in (none, labels.filter("quality = 1"), labels):
        kept = rules.keep_good(docs, given)
        assert kept.columns == docs.columns
        assert {0, 2} <= {r["kept"] for r in kept.collect()} <= {0, 2, 3}
    assert not rules.keep_good(docs.limit(0), labels).collect()


def plain_trie(rows):
    """Rows of (conv_id, turn, role, text) to nodes, by dictionaries."""
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            given[c].append(((turn is not None, turn or 0, digest), (role, text)))
    turns = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in given.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(x[: len(q)] == q and len(x) == len(q) + 1 for x in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        text = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children), leaves, saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(7.0, *r) for r in rows], "depth double, conv_id bigint, turn bigint, role string, text string")


@pytest.mark.parametrize(("bits", "block"), [(24, 65_536), (4, 2)])
def test_trie_of_odd_conversations(spark, monkeypatch, bits, block):
    """Nulls, ties, repeated rows, absent first conversations, negative ids; also with a full sketch and small blocks."""
    monkeypatch.setattr(prefix_trie, "LEAST_BITS", min(bits, prefix_trie.LEAST_BITS))
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", block)
    monkeypatch.setattr(prefix_trie, "IDS_TOGETHER", 3)
    rng = random.Random(bits)
    rows = []
    for c in [*range(-25, 70), 400, 401, 10**12]:
        if c % 20 or c in (0, 20, -20):
            for t in range(rng.randint(1, 6)):
                rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "user", None, ""]), rng.choice(["a b", "a b", "c", None, "d  e f"])))
    rows += [(60 + k, t, "user", "the same words") for k in range(1, 19) for t in range(3)]
    rows += [(None, 1, "user", "nobody's"), (5, 1, "user", "twice"), (5, 1, "user", "twice")]
    got = prefix_trie.trie(*prefix_trie.rebuilt(conversations(spark, rows)), most_bits=bits)
    assert sorted((tuple(r) for r in got.select(prefix_trie.COLUMNS).collect()), key=str) == plain_trie(rows)


def test_trie_of_few_conversations(spark):
    for rows in ([], [(3, None, None, None)], [(0, 1, "user", "x")], [(None, 1, "user", "x")], [(21, 1, "u", "x"), (22, 1, "u", "x")]):
        got = prefix_trie.trie(*prefix_trie.rebuilt(conversations(spark, rows)))
        assert sorted((tuple(r) for r in got.select(prefix_trie.COLUMNS).collect()), key=str) == plain_trie(rows)


def test_trie_query_and_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in prefix_trie.op12_prefix_trie(spark, SF).select(prefix_trie.COLUMNS).collect()), key=str)
    assert got == plain_trie(rows)
    assert got == sorted(con.execute(prefix_trie.OP12_SQL).fetchall(), key=str)


def test_sketch_never_takes_shared_for_alone(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    keys = rng.integers(-(2**63), 2**63, (3000, 2))
    rows = [tuple(map(int, keys[i])) for i in [*range(3000), *range(0, 3000, 7)]]
    for bits in (6, 12, 16):
        sketch = prefix_trie.sketched(spark.createDataFrame(rows, "a bigint, b bigint"), "a", "b", bits)
        alone = sketch.alone(keys[:, 0].copy(), keys[:, 1].copy())
        assert not alone[::7].any()
        assert alone.mean() > (0.84 if bits == 16 else 0.0 if bits == 6 else 0.1) - 1e-9


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = {c: i for i, c in enumerate(byte_symbols())}
    out = []
    for text in texts:
        groups, links, n_a, n_b = [], Counter(), 0, 0
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            left = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
            right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(left) == b"".join(right) == (" " + text).encode():
                n_a, n_b = len(ids_a), len(ids_b)
                i = j = x = y = 0
                part_a, part_b = [], []
                while i < n_a or j < n_b:  # the side that is behind takes its next token
                    if x <= y:
                        part_a.append(ids_a[i])
                        x, i = x + len(left[i]), i + 1
                    else:
                        part_b.append(ids_b[j])
                        y, j = y + len(right[j]), j + 1
                    if x == y:
                        groups.append(",".join(map(str, part_a)) + "|" + ",".join(map(str, part_b)))
                        links.update((p, q) for p in part_a for q in part_b)
                        part_a, part_b = [], []
        out.append((n_a, n_b, groups, links))
    docs = Counter(pair for *_, links in out for pair in links)
    most = Counter()
    for (p, _), n in docs.items():
        most[p] = max(most[p], n)
    rows = [
        (n_a, n_b, len(g), sum(links.values()), sum(n for k, n in links.items() if docs[k] == most[k[0]]), sum(n * docs[k] for k, n in links.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for n_a, n_b, g, links in out
    ]
    return rows, sorted((p, q, n, n == most[p]) for (p, q), n in docs.items())


def aligned(docs):
    return align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def test_alignment_of_odd_texts(spark, monkeypatch):
    """Special strings, characters without a token, odd white space; small blocks and heaps, several groups a radix."""
    rng = random.Random(1)
    parts = ["a", "b", "The", "é", "漢字", " ", "  ", "\n", "\t", "\r", "\r\n", " ", "▁", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x0A>", "\x00", "　", "{", "}", ";", "23", "'s", "\U0001f600", "\x1c", "\x85"]
    texts = [None, "", " ", "\n", "  x", "\r", "x\r\n", " \r\n {\r\n}\r\n", "long word " * 3000, "x" * 5000]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_a int")
    rows, pairs = plain_alignment(texts)
    monkeypatch.setattr(align, "BLOCKS_TOGETHER", 2)
    found = aligned(docs.repartition(6))
    assert [tuple(r)[1:] for r in sorted(found.documents().collect())] == rows
    assert sorted(tuple(r) for r in found.pairs().collect()) == pairs


def test_alignment_repeated_rows_and_empty_table(spark):
    texts = ["one two three", "one two three", None, "one", ""]
    docs = spark.createDataFrame(list(zip([1, 1, None, None, 2], texts, strict=True)), "doc_id bigint, text string")
    rows, _ = plain_alignment(texts)
    got = [tuple(r)[1:] for r in aligned(docs).documents().collect()]
    assert sorted(got) == sorted(rows)
    assert not aligned(docs.limit(0)).documents().collect()
    assert not aligned(docs.limit(0)).pairs().collect()


def test_alignment_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows, _ = plain_alignment([texts[k] for k in sorted(texts)])
    assert [tuple(r)[1:] for r in sorted(align.op13_tokenizer_alignment(spark, SF).collect())] == rows


def test_heap_merge_and_runs():
    rng = np.random.Generator(np.random.PCG64(2))
    total, runs = Counter(), []
    for _ in range(70):
        codes = np.unique(rng.integers(0, 500, 60)).astype(np.uint32)
        counts = rng.integers(1, 9, len(codes)).astype(np.uint64)
        runs.append((codes, counts))
        total.update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
    codes, counts = align._merged(runs)
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == dict(total)
    assert (np.diff(codes.astype(np.int64)) > 0).all()
    for x in (np.zeros(0, np.uint32), np.array([1, 2**32 - 1], np.uint32)):
        assert (align.unpack(align.pack(x)) == x).all()
    big = np.array([2**63, 5], np.uint64)
    assert (align.unpack(align.pack(big), np.uint64) == big).all()
