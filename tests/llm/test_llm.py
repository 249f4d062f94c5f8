"""The operators against brute force, exact round trips, held-out accuracy, and odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from docspark.llm import bpe_count, components, decontaminate, html_text, langid, minhash, pieces, records, simhash, substrings, urls
from docspark.llm.blocks import flags
from docspark.llm.words import alnum_words, white_words

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, n_words string, extra int"


def said(n, seed, words=40):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(words)}" for _ in range(rng.randrange(0, 90))) for _ in range(n)]


def odd(spark):
    """Nulls, empties, ties, repeated rows, a very long text, clashing names."""
    rows = [(None, "a b c", "x", 1), (1, None, None, None), (1, "", "y", 2), (2, "same text here", "z", 3), (2, "same text here", "z", 3), (3, "word " * 60_000, "", 4), (4, "é中 \U0001f642 !!", "", 5)]
    return spark.createDataFrame(rows, ODD)


def test_words():
    texts = ["a b  c", "", None, "x", "yz é w q\n", " ", "end", "A1-b"]
    w = white_words(pa.array(texts))
    got = [[x.decode() for x in w.text(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [["a", "b", "c"], [], [], ["x"], ["yz", "é w", "q"], [], ["end"], ["A1-b"]]
    w = alnum_words(pa.array(texts))
    assert [x.decode() for x in w.text(w.first[-2], w.first[-1])] == ["a1", "b"]


# 1


def test_html():
    page = (
        "<html><head><title>T</title></head><body><div class='site-header'>My Site</div><ul class='menu'><li>Home</li></ul><div id='content'><h1>Title</h1>"
        "<p>First para, long enough to be text.<p>Second; with <a href=x>link</a>&nbsp;&amp; text.</p><ul><li>item one.</li><li>item two</ul></div>"
        "<div class='comments'><p>Nice post, thanks a lot for it.</p></div><div id='cookie-notice'>We use cookies.</div><form>f</form></body></html>"
    )
    assert html_text.main_text(page) == "Title\n\nFirst para, long enough to be text.\n\nSecond; with link & text.\n\nitem one.\n\nitem two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<article><p>x, y.<br>z</p>tail <scr") == "x, y. z\n\ntail"
    assert len(html_text.main_text("<div>" * 20_000 + "x, y." + "<p>a" * 5000)) > 5000


def test_html_keeps_whole_articles():
    para = lambda word, n: " ".join(f"{word} says this, and then that." for _ in range(n))
    intro, body, end = para("intro", 2), para("body", 24), para("end", 1)
    page = f"<body><h1>The title</h1><div class=intro><p>{intro}</p></div><div class=text><p>{body}</p></div><p>{end}</p><div><ul>{'<li><a href=/>Home</a></li>' * 9}</ul></div></body>"
    assert html_text.main_text(page) == f"The title\n\n{intro}\n\n{body}\n\n{end}"
    for tag in ("article", "div class=story"):
        page = f"<body><{tag}><p>{para('one', 11)}</p></{tag[:7].split()[0]}><{tag}><p>{para('two', 9)}</p></{tag[:7].split()[0]}></body>"
        assert html_text.main_text(page) == f"{para('one', 11)}\n\n{para('two', 9)}"
    page = (
        f"<article><h2 id=discussion>Discussion</h2><p class=notice>{intro}</p><section id=related-work><h2 class='search'>Related work</h2><p>{body}</p></section>"
        f"<section id=discussion><p>{end} See <span class=tags>tags</span>.</p></section></article><div class=related><ul><li>More</li></ul></div><div class='comments-list'><p>{body}</p></div>"
    )
    assert html_text.main_text(page) == f"Discussion\n\n{intro}\n\nRelated work\n\n{body}\n\n{end} See tags."


def test_html_query(spark):
    pages = spark.createDataFrame([(1, None, "t"), (2, "<p>a, b.", "u"), (2, "<p>a, b.", "u")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [(1, "", 0), (2, "a, b.", 5), (2, "a, b.", 5)]
    assert html_text.extract(pages.limit(0)).count() == 0


# 2


def test_urls(spark):
    given = ["http://a.NET/x", "https://m.example.net/en/1?q", "http://example.net/fr/", "http://example.com/de/a#b", "http://x.org/fr/", "http://anet/", "no scheme", None, "http://net", "http://a.net?x/", "://net/"]
    rows = spark.createDataFrame([(i, u, "old") for i, u in enumerate(given)], "page_id int, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(rows, urls.rule_table(spark, urls.RULES)).collect()}
    assert got == {
        0: ("a.net", "/x", "net/", "block"), 1: ("m.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/fr/", "net/", "block"),
        3: ("example.com", "/de/a", "example.com/de/", "block"), 4: ("x.org", "/fr/", "org/fr/", "allow"), 5: ("anet", "/", None, "allow"), 6: ("", "", None, "allow"),
        7: ("", "", None, "allow"), 8: ("net", "", None, "allow"), 9: ("a.net", "", None, "allow"), 10: ("net", "/", "net/", "block"),
    }
    assert urls.judge(rows.limit(0), urls.rule_table(spark, urls.RULES)).count() == 0


# 3


def test_simhash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in simhash.compare_with_edits(docs, 3).collect()}
    texts = [t for _, t in rows]
    fp = simhash.fingerprints(pa.array(texts))
    for k, (doc_id, text) in enumerate(rows):
        changed = simhash.edited(text, texts[(k + 1) % len(texts)])
        assert got[doc_id].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[doc_id].fingerprint == fp[k].tobytes().hex() and got[doc_id].n_chars == len(text)
    assert np.mean([r.near_edited for r in got.values()]) > 0.7 > 0.6 > np.mean([r.near_next for r in got.values()])


def test_simhash_odd(spark):
    assert simhash.compare_with_edits(odd(spark), 3).count() == 7
    assert [r.near_next for r in simhash.compare_with_edits(odd(spark).limit(1), 2).collect()] == [1.0]
    assert simhash.compare_with_edits(odd(spark).limit(0), 2).count() == 0


def test_block_tables_find_all(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (30, 16), np.uint8)
    near = base.repeat(6, 0)
    for k in range(len(near)):
        for b in rng.integers(0, 128, rng.integers(0, 7)):
            near[k, b // 8] ^= 1 << (b % 8)
    names = [x.tobytes().hex() for x in near]
    df = spark.createDataFrame([(x,) for x in [*names, names[0], None]], "fingerprint string")
    got = {(r[0], r[1]): r[2] for r in simhash.find_within(df, df).collect()}
    want = {(a, b): int(np.bitwise_count(near[i] ^ near[j]).sum()) for i, a in enumerate(names) for j, b in enumerate(names)}
    assert got == {k: d for k, d in want.items() if d <= simhash.RADIUS}


# 4


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    judged = langid.predict(docs.filter(langid.held_out(F.col("doc_id"))), model)
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    got = {(r.doc_id, r.text): r.lang_pred for r in langid.predict(odd(spark), model).collect()}
    assert got[(1, None)] == got[(1, "")] == "und" and got[(3, "word " * 60_000)] in model.languages
    assert langid.train(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(odd(spark), None).collect()} == {"und"}


def test_language_sample_is_bounded(spark, monkeypatch):
    cut = spark.sparkContext.accumulator(0)
    ngrams = langid.ngrams

    def counted(texts):
        cut.add(len(texts))
        return ngrams(texts)

    monkeypatch.setattr(langid, "TRAIN_PER_LANGUAGE", 20)
    words = {"en": said(120, 1), "de": [t.replace("w", "ß") for t in said(120, 2)]}
    # null ids, one id for many rows, and one row many times
    rows = [((None, 7, i)[i % 3], t, lang) for lang, texts in words.items() for i, t in enumerate(texts)] + [(None, "w1 w2 w3", "en")] * 60
    models = []
    for order in (1, -1):
        docs = spark.createDataFrame(rows[::order], "doc_id long, text string, lang string").repartition(3)
        with monkeypatch.context() as m:
            m.setattr(langid, "ngrams", counted)
            before = cut.value
            models.append(langid.train(docs))
        assert 0 < cut.value - before <= 2 * 20
    assert all(np.array_equal(getattr(models[0], x), getattr(models[1], x)) for x in ("familiar", "landmarks", "coefficients", "bars"))


def test_language_stage(spark):
    rng = random.Random(3)
    letters = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(n))
    go = ["Это обычный русский текст, который ни на что не похож.", "这是一个中文文本，与任何已学习的语言都不相似。", "هذا نص عربي لا يشبه أي لغة", "Αυτό είναι ένα ελληνικό κείμενο.", letters(1), letters(8), letters(400), "%x" % rng.getrandbits(400)]
    stay = ["That it.", "Von.", "The", "Of the that.", "De la queen.", "THE!! AND!! OF!! THAT!!", "Que de los."]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(go + stay)], docs.schema)
    kept = {r.doc_id: r.text for r in corpus_pipeline.language_id(spark, docs.union(more), SF).collect()}
    assert sorted(t for i, t in kept.items() if i < 0) == sorted(stay)
    assert len(kept) == docs.filter(F.col("text").rlike(r"\p{L}")).count() + len(stay)
    # one labelled text of a language says little of others: its bar is low, that of the other languages is not
    lone = spark.createDataFrame([(-100, "Zwykły tekst po polsku.", "pl")], docs.schema)
    bars = langid.train(docs.union(lone))
    assert dict(zip(bars.languages, bars.bars, strict=True))["pl"] < 0.2 < 0.44 < min(b for x, b in zip(bars.languages, bars.bars, strict=True) if x != "pl")


# 5


def repeated(texts, n):
    words = [t.split() if t else [] for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), []).append((d, i))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + n))
    return gone


@pytest.mark.parametrize("n", [5, 17, 20, 35])
def test_substrings(spark, n):
    rng = random.Random(n)
    passages = [" ".join(f"p{rng.randrange(900)}" for _ in range(n + 9)) for _ in range(4)]
    texts = said(40, n, 5000)
    texts = [f"{t} {rng.choice(passages)} {u}" if k % 3 == 0 else t for k, (t, u) in enumerate(zip(texts, reversed(texts), strict=True))]
    texts += [texts[3], texts[3], "z " * (n + 5), None, "", "q r", " ".join(passages[:2])]
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id int, text string, spans string").repartition(3)
    got = {r.doc_id: r.spans for r in substrings.duplicate_spans(docs, n=n).collect()}
    want = repeated(texts, n)
    for k in range(len(texts)):
        assert {i for a, b in zip(got[k][::2], got[k][1::2], strict=True) for i in range(a, b)} == want[k], k
    kept = {r.doc_id: r.text for r in substrings.remove_repeats(docs.drop("spans"), n=n).collect()}
    for k, t in enumerate(texts):
        assert kept[k] == t if not want[k] else kept[k].split() == [w for i, w in enumerate(t.split()) if i not in want[k]]


def test_substrings_odd(spark):
    got = {r.doc_id: (r.n_words, r.spans) for r in substrings.duplicate_spans(odd(spark)).filter("doc_id = 3").collect()}
    assert got == {3: (60_000, [0, 60_000])}
    assert substrings.duplicate_spans(odd(spark).limit(0)).count() == 0


# 6


def serial(v, text):
    best, back = [0.0] + [-1e30] * len(text), [0] * (len(text) + 1)
    for i in range(len(text)):
        edges = [(i + 1, v.unknown_score)] if text[i] not in v.score else []
        edges += [(j, v.score[text[i:j]]) for j in range(i + 1, len(text) + 1) if text[i:j] in v.score]
        for j, s in edges:
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, i
    out, end = [], len(text)
    while end:
        piece = text[back[end] : end]
        out = ([v.id[piece]] if piece in v.id else [v.byte[b] for b in piece.encode()]) + out
        end = back[end]
    return out


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_max_plus_scan():
    v = pieces.Vocabulary(open(MODEL, "rb").read())
    n, rng = v.longest, random.Random(6)
    letters = list("the in er on and ") + ["th", "é", "▁", "日本", "\U0001f642", "\n", " ", "therein"]
    for _ in range(60):
        text = pieces.MARK + "".join(rng.choices(letters, k=rng.randrange(0, 120))).replace(" ", pieces.MARK)
        want, size = serial(v, text), rng.choice([16, 17, 23, 40])
        assert v.encode(text) == want
        cut = [(min(size, len(text) - a), text[a : a + size + n - 1]) for a in range(0, len(text), size)]
        done = pieces.scan(np.stack([v.matrix(t, z) for z, t in cut]))
        entry = np.concatenate([[np.where(np.arange(n) == 0, 0.0, pieces.NONE)], done[:-1, 0, :]])
        backs, maps = [v.forward(t, z, e.tolist())[1] for (z, t), e in zip(cut, entry, strict=True)], []
        for (z, _), back in zip(cut, backs, strict=True):
            row = []
            for t in range(n):
                end = z + t
                while end < len(back) and back[end] >= 0:
                    end = back[end]
                row.append(min(end, n - 1))
            maps.append(row)
        state = pieces.compose(np.array(maps))
        assert [i for (z, t), back, s in zip(cut, backs, state, strict=True) for i in v.trace(t, back, z + int(s))[0]] == want


def test_pieces(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).unionByName(odd(spark).filter("coalesce(doc_id, 0) <> 3"), allowMissingColumns=True).select("doc_id", "text")
    whole = {(r.doc_id, r.text): r.ids for r in pieces.encode(docs, MODEL).collect()}
    cut = {(r.doc_id, r.text): r.ids for r in pieces.encode(docs, MODEL, giant=1500, chunk=400).collect()}
    assert whole == cut and len(whole) >= 60
    v = pieces.Vocabulary(open(MODEL, "rb").read())
    assert all(ids == (serial(v, pieces.MARK + t.replace(" ", pieces.MARK)) if t else []) for (_, t), ids in list(whole.items())[:8] if not t or len(t) < 4000)
    back = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert back.filter(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(r.ids == library.encode(r.text or "") for r in pieces.encode_by_merges(docs, MODEL).collect())
    assert pieces.digests(docs, MODEL, giant=1500, chunk=400).filter("not round_trip").count() == 0
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


# 7, 8


def test_counts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(7)
    letters = [*"aB'sTdllve 1²٣éßİΣςﬁ́   \x1c\x85\n\t!?…中\U0001f642​ǅ", "<|endoftext|>", "<|startoftext|>", "'re", "hello", " "]
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(3000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").unionByName(odd(spark), allowMissingColumns=True)
    got = bpe_count.count_tokens(docs, path).select("doc_id", "text", "n_bytes", "n_tokens", "over_limit").collect()
    assert len(got) == 3007
    for r in got:
        text = r.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048), text[:80]


def test_records(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    manifest = records.write_records(docs, f"file://{tmp_path}/a", path, 2).cache()
    rows = records.read_records(manifest, f"file://{tmp_path}/a").collect()
    want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
    plain = lambda x: sorted((-1 if k is None else k, ids) for k, ids in x)
    assert plain((r.doc_id, r.ids) for r in rows) == plain(want)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids)
    assert [r.doc_id or 0 for r in sorted(rows, key=lambda r: r.start)] == sorted(k or 0 for k, _ in want)
    mixed = records.read_shuffled(manifest, f"file://{tmp_path}/a", 5).collect()
    assert plain((r.doc_id, r.ids) for r in mixed) == plain(want) and [r.doc_id for r in mixed] != [r.doc_id for r in rows]
    empty = records.write_records(docs.limit(0), f"file://{tmp_path}/b", path, 2)
    assert records.read_records(empty, f"file://{tmp_path}/b").count() == 0


def test_damaged_records():
    data = bytearray(records.frame(records.pack(7, np.array([1, 2, 3], "<u2"))))
    key, ids = records.unpack(records.unframe(memoryview(data), 0)[0])
    assert (key, ids.tolist()) == (7, [1, 2, 3])
    for k in range(len(data)):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(records.Damaged):
            records.unframe(memoryview(bad), 0)
    assert records.masked(b"x") == (((zlib.crc32(b"x") >> 15 | zlib.crc32(b"x") << 17) + 0xA282EAD8) & 0xFFFFFFFF)


# 9


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(9)
    shingles = np.sort(rng.integers(0, 2**64, 400, dtype=np.uint64))
    a, b = rng.random(400) + 0.5, rng.random(400) + 0.5
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    s = minhash.signatures(np.concatenate([shingles, shingles]), np.concatenate([a, b]), np.array([0, 400, 800]))
    assert abs((s[0] == s[1]).mean() - true) < 0.2
    same = minhash.signatures(np.concatenate([shingles, shingles]), np.concatenate([a, a]), np.array([0, 400, 800]))
    assert (same[0] == same[1]).all()


def test_near_dedup(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(3000)}" for _ in range(200)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:6]:
        for _ in range(8):  # edits of one text, some far from each other
            c = list(b)
            for _ in range(rng.choice([1, 2, 3])):
                c[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(c))
    texts += [texts[0], texts[0], None, "", "x", "x y z", "x y z"]
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id int, text string, class_id string").repartition(3)
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.classes(docs).collect()}
    shingles, weights, first = minhash.weighted(pa.array(texts))
    sets = [(shingles[a:b], weights[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or minhash.jaccard(sets[i], sets[j]) >= 0.8:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min(k for k in range(len(texts)) if label[k] == x) for x in set(label)}
    assert {k: v[0] for k, v in got.items()} == {k: least[label[k]] for k in range(len(texts))}
    assert {k for k, v in got.items() if v[1]} == set(least.values())
    cells = minhash.classes(docs, cell_bytes=6000)  # groups of several cells
    assert {r.doc_id: (r.class_id, r.kept) for r in cells.collect()} == got
    stay = minhash.drop_near_duplicates(docs)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == set(least.values())


def test_cells_lose_no_link():
    rng = np.random.default_rng(19)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = []
    for _ in range(150):  # edits of one set, alike by 0.5 to 1
        s = base.copy()
        n = int(rng.integers(0, 26))
        s[rng.permutation(60)[:n]] = rng.integers(0, 2**63, n)
        s = np.unique(s)
        sets.append((s, (1 + (s % np.uint64(3)).astype(np.float64) / 4).astype(np.float32)))

    def connected(links):
        label = list(range(150))
        for a, b in links:
            label = [label[b] if x == label[a] else x for x in label]
        return {frozenset(k for k in range(150) if label[k] == x) for x in label}

    def members(ks, label):
        first = np.concatenate([[0], np.cumsum([len(sets[k][0]) for k in ks])])
        return minhash.Members(np.array(ks), np.array([label[k] for k in ks]), np.concatenate([sets[k][0] for k in ks]), np.concatenate([sets[k][1] for k in ks]), first)

    true = []
    for i in range(150):
        for j in range(i):
            a, b = dict(zip(*map(list, sets[i]), strict=True)), dict(zip(*map(list, sets[j]), strict=True))
            low = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
            if low / (sum(a.values()) + sum(b.values()) - low) >= 0.8:
                true.append((i, j))
    assert len(connected(true)) > 1
    own = list(range(150))
    assert connected(minhash.forest([members(own, own)], 0.8)) == connected(true)
    parts = [list(range(k, 150, 3)) for k in range(3)]
    inner = [x for p in parts for x in minhash.forest([members(p, own)], 0.8)]
    groups = connected(inner)
    label = [min(next(g for g in groups if k in g)) for k in range(150)]
    across = [x for i in range(3) for j in range(i) for x in minhash.forest([members(parts[j], label), members(parts[i], label)], 0.8)]
    assert connected(inner + across) == connected(true)


def test_near_dedup_odd(spark):
    rows = minhash.classes(odd(spark)).collect()
    assert len(rows) == 7 and sum(r.kept for r in rows) == 5
    assert minhash.classes(odd(spark).limit(0)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 200), (200, 300), (7, 7), (101, 100), (100, 101)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 200: 100, 300: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10


@pytest.mark.parametrize("most", [10**6, 7])
def test_decontaminate(spark, most):
    rng = random.Random(10)
    items = [(k, " ".join(f"b{rng.randrange(50)}" for _ in range(rng.choice([0, 3, 12, 13, 14, 30])))) for k in range(12)] + [(12, None), (13, "B1, b2!")]
    texts = said(30, 10)
    texts = [f"{t} {items[k % 12][1]}, {t[:20]}" if k % 2 else t for k, t in enumerate(texts)] + [None, "", "b1-B2 b1"]
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id int, text string, hit_items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked = decontaminate.judge(decontaminate.mark(docs, bench, max_windows=most))
    got = {r.doc_id: (r.n_words, r.n_hit, r.hit_items, r.contaminated) for r in marked.collect()}
    norm = lambda t: [x.decode() for x in alnum_words(pa.array([t])).text(0, 10**9)] if t else []
    for k, t in enumerate(texts):
        w, hit, names = norm(t), set(), set()
        for name, item in items:
            x = norm(item)
            size = min(13, len(x))
            windows = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if x else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    names.add(str(name))
        assert got[k] == (len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w))
    kept = decontaminate.decontaminate(docs, bench, max_windows=most)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if not v[3]}
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, "spans", max_windows=most).collect()}
    assert all(len(norm(spans[k])) == v[0] - v[1] for k, v in got.items())
    assert decontaminate.mark(docs.limit(0), bench).count() == 0 and decontaminate.mark(docs, bench.limit(0)).filter("size(hit_words) > 0").count() == 0


def test_flags():
    rng = np.random.default_rng(0)
    x = rng.random(77) > 0.5
    assert (flags(np.packbits(x).tobytes(), 77) == x).all()


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", 7), (2, None, 8)], "page_id int, url string, best int")
    rows = urls.judge(pages, urls.rule_table(spark, urls.RULES)).select("page_id", "best", "verdict").orderBy("page_id").collect()
    assert [tuple(r) for r in rows] == [(1, 7, "block"), (2, 8, "allow")]
    words = " ".join(f"w{k}" for k in range(20))
    names = ("n_words", "hit_words", "hit_items", "n_hit", "contaminated")
    docs = spark.createDataFrame([(1, "a b c", -7, -6, -5, -4, -3), (2, words, 1, 2, 3, 4, 5)], "doc_id int, text string, " + ", ".join(f"{n} int" for n in names))
    items = spark.createDataFrame([("i", words)], "item_id string, text string")
    assert [tuple(r) for r in decontaminate.decontaminate(docs, items).collect()] == [(1, "a b c", -7, -6, -5, -4, -3)]
    cut = decontaminate.decontaminate(docs, items, remove="spans").orderBy("doc_id").collect()
    assert [tuple(r) for r in cut] == [(1, "a b c", -7, -6, -5, -4, -3), (2, "", 1, 2, 3, 4, 5)]


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    said = ["the cat and the dog went out into the rain", "der hund und die katze gehen in den regen hinaus"]
    rng = random.Random(5)
    rows = [(k, " ".join(rng.sample(said[k % 2].split(), 9)) + f" {said[k % 2].split()[k % 9]}", ["en", "de"][k % 2]) for k in range(40)]
    item = " ".join(f"item{k}" for k in range(13))
    rows += [(90, None, None), (91, "", "en"), (92, "12 34", None), (93, item, "en"), (94, said[0], "en"), (94, said[0], "en"), (None, said[1] + " " + said[1], None), (95, " ".join(f"{said[0]} {k}" for k in range(7000)), "en")]
    clashing = ("lang_pred", "score", "resembles", "n_hit", "contaminated", "block", "row", "ref", "band", "label", "_key", "n_words")
    docs = spark.createDataFrame([(*r, *range(len(clashing))) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in clashing)).repartition(2)
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, stage(spark, now, str(tmp_path))
            if name != "sentencepiece":
                assert now.columns == docs.columns
                assert now.count() <= before.count()
                if table is docs:
                    assert all(tuple(r) == tuple(range(len(clashing))) for r in now.select(*clashing).collect())
        out = now.collect()
        assert all(r.round_trip for r in out)
        if table is docs:
            assert 95 in {r.doc_id for r in out} and not {90, 91, 92, 93} & {r.doc_id for r in out}
            assert sum(r.doc_id == 94 for r in out) == 1


def test_shared_folder_in_the_default_file_system(spark):
    from docspark.llm.frames import local_uri, shared_folder

    top = spark.conf.get("spark.checkpoint.dir")
    assert "://" not in top
    assert local_uri(shared_folder(spark, "x")).startswith(f"file://{top}/x-")
