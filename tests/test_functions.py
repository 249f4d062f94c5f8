"""Column functions against plain Python and known values."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docspark.functions import chunks as C
from docspark.functions import dates as D
from docspark.functions import text as X
from docspark.functions import vector as V


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")


def values(df, c):
    return [r.v for r in df.select("i", c.alias("v")).orderBy("i").collect()]


def clean(t):
    t = re.sub(r"\n{3,}", "\n\n", t or "")
    t = re.sub(r"[\x00-\x09\x0b\x0c\x0e-\x1f\x7f]", "", t)
    t = re.sub(" {2,}", " ", t)
    return "\n".join(x.strip() for x in t.splitlines()).strip()


def test_text_against_python(spark):
    rng = random.Random(1)
    letters = list("ab  \n\n\t\r\x01\x1f\x85  　é.") + ["\r\n", "word"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 25))) for _ in range(1500)] + [None, ""]
    df = column(spark, texts)
    assert values(df, X.clean_text("t")) == [clean(t) for t in texts]
    assert values(df, X.count_words("t")) == [len((t or "").split()) for t in texts]
    assert values(df, X.count_chars("t")) == [sum(not c.isspace() for c in t or "") for t in texts]
    assert values(df, X.estimate_tokens("t")) == [max(len((t or "").split()), len(t or "") // 4) for t in texts]


def test_known_texts(spark):
    df = column(spark, ["这是一行文本。  \n\n\n\n这是第二行。   \n   第三行。", "这是文本\x01\x02带有控制字符\x1f。"])
    assert values(df, X.clean_text("t")) == ["这是一行文本。\n\n这是第二行。\n第三行。", "这是文本带有控制字符。"]
    assert values(column(spark, ["Hello world. This is a test."]), X.count_chars("t")) == [23]
    titles = column(spark, ["这是标题\n这是内容第一段。", "", "12\n2024-01-01\nReal title", "x\n" * 9])
    assert values(titles, X.title_from_lines("t", F.lit("document.pdf"))) == ["这是标题", "document", "Real title", "document"]
    assert values(column(spark, [""]), X.title_from_lines("t", F.lit(None).cast("string"))) == ["Untitled Document"]
    said = column(spark, ["short", "x" * 40, "twelve chars then a word that is long", "a" * 30 + " b"])
    assert values(said, X.chat_title("t")) == ["short", "x" * 30 + "...", "twelve chars then a word that...", "a" * 30 + "..."]
    assert values(column(spark, ["Hi", "hey yo", "hello there", "你好", None]), X.is_greeting("t")) == [True, True, False, True, False]
    assert values(column(spark, ["a.pdf", "b.TXT", "c", "d/e.tar.docx"]), X.mime_type(F.col("t"))) == [X.STORED_MIME["pdf"], "text/plain", X.UNKNOWN_MIME, X.STORED_MIME["docx"]]
    assert values(column(spark, [0, 1536, 10, 3 * 1024**3, None], "bigint"), X.format_bytes(F.col("t"))) == ["0 Bytes", "1.5 KB", "10 Bytes", "3 GB", "0 Bytes"]
    assert values(column(spark, [0.0, 12.34, 62.0, 3780.0, None], "double"), X.format_seconds(F.col("t"))) == ["0s", "12.3s", "1m 2s", "1h 3m", "0s"]
    assert values(column(spark, [3.0, 2.5, None], "double"), X.number_display(F.col("t"))) == ["3", "2.50", "0"]
    assert values(column(spark, ["the cat of the house", "le chat de la maison et des", "xyz"]), X.guess_language("t")) == ["en", "fr", "en"]


def test_vectors(spark):
    rng = random.Random(2)
    rows = [([rng.uniform(-1, 1) for _ in range(6)], [rng.uniform(-1, 1) for _ in range(6)]) for _ in range(100)] + [([0.0] * 6, [1.0] * 6)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<double>, b array<double>")
    dot = [sum(x * y for x, y in zip(a, b, strict=True)) for a, b in rows]
    size = [math.hypot(*a) * math.hypot(*b) for a, b in rows]
    cos = [d / s if s else 0.0 for d, s in zip(dot, size, strict=True)]
    a, b = F.col("a"), F.col("b")
    for got, want in (
        (V.distance(a, b, "dot"), dot),
        (V.distance(a, b, "cosine"), [1 - c for c in cos]),
        (V.cosine_similarity(a, b), [max(0, c) for c in cos]),
        (V.distance(a, b, "l2"), [math.dist(x, y) for x, y in rows]),
        (V.score(V.distance(a, b, "dot"), "dot"), [min(1, max(0, (d + 1) / 2)) for d in dot]),
        (V.norm(V.normalise(a)), [1.0] * 100 + [0.0]),
    ):
        assert values(df, got) == pytest.approx(want)
    with pytest.raises(ValueError):
        V.distance(a, b, "hamming")
    with pytest.raises(Exception, match="different lengths"):
        df.select(V.distance(F.slice(a, 1, 2), b)).collect()


def test_language_guess(spark):
    said = ["Nichts als ein kleiner Schritt für uns", "Esta canción es de una niña", "L'eau est très fraîche à côté", "The weather was lovely this morning", "", None, "12 345 !!", "xyz", "Straßenbahn über Brücken", "ñandú"]
    assert values(column(spark, said), X.guess_language("t")) == ["de", "es", "fr", "en", "en", "en", "en", "en", "de", "es"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL")
    assert docs.agg(F.avg((X.guess_language("text") == F.col("lang")).cast("int")).alias("same")).first().same > 0.99


def test_chunks(spark):
    text = "One two three. Four five! " * 30 + "\n\nNew paragraph here."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    tokens = text.split()
    got = [r.text for r in C.token_chunks(df, 20, 5).orderBy("index").collect()]
    assert got == [" ".join(tokens[i : i + 20]) for i in range(0, max(1, len(tokens) - 5), 15)]
    parts = C.sentence_chunks(df, 20, 6).orderBy("index").collect()
    assert all(max(len(r.text.split()), len(r.text) // 4) <= 20 for r in parts) and {r.doc_id for r in parts} == {1}
    assert set(" ".join(r.text for r in parts).split()) == set(tokens)
    assert [r.text for r in C.paragraph_chunks(df, 30, 0).collect()][-1].endswith("\n\nNew paragraph here.")
    levels = C.hierarchical_chunks(df, 40, 4).collect()
    by_level = {(r.level, r["index"]): r for r in levels}
    assert {r.level for r in levels} == {0, 1, 2}
    for r in levels:
        assert r.text == " ".join(tokens[r.begin : r.end]) and r.end - r.begin <= 40 >> r.level
        if r.level:
            above = by_level[r.level - 1, r.parent_index]
            assert above.begin <= r.begin < r.end <= above.end
    for level in range(3):
        assert {i for r in levels if r.level == level for i in range(r.begin, r.end)} == set(range(len(tokens)))
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            C.token_chunks(df, size, overlap)
    one = df.select(F.col("doc_id").alias("i"), C.for_embedding(F.col("text"), F.lit(None).cast("int"), F.lit(None).cast("map<string,string>")).alias("c")).filter("i = 2").first()["c"]
    assert (one["text"], one["index"], one["metadata"]) == ("", -1, {"chars": "0", "words": "0"})


def test_times(spark):
    now = F.lit("2024-05-02 12:00:00").cast("timestamp")
    df = column(spark, ["2024-05-02T10:00:00", "2024-05-01 09:30:00", "2024/04/30 00:00:00", "2024-05-02T10:00:00+02:00", "bad"])
    at = D.parse_time(F.col("t"), now)
    assert values(df, D.rfc3339(at)) == ["2024-05-02T10:00:00Z", "2024-05-01T09:30:00Z", "2024-04-30T00:00:00Z", "2024-05-02T08:00:00Z", "2024-05-02T12:00:00Z"]
    assert values(df, D.day_label(at, now)) == ["Today, 10:00", "Yesterday, 09:30", "2024-04-30", "Today, 08:00", "Today, 12:00"]
    assert values(df, D.with_zone(F.col("t")))[0] == "2024-05-02T10:00:00Z" and values(df, D.with_zone(F.col("t")))[3].endswith("+02:00")
