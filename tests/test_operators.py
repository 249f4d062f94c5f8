"""Operators on small tables with known results."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import chat as H
from docspark.operators import rag as G
from docspark.operators import registry as R
from docspark.operators import search as S
from docspark.operators import tasks as K
from docspark.operators.embed import embed, resolve
from docspark.operators.metadata import merge_metadata
from docspark.sources import files


def test_registry(spark):
    rows = [("4", "doc1.txt", "uploaded", "important,report", "2024-01-01 10:00:00"), ("5", "doc2.txt", "processing", "report", "2024-01-01 11:00:00"), ("6", "doc3.TXT", "completed", "memo", "2024-01-01 12:00:00")]
    df = spark.createDataFrame(rows, "id string, file_name string, status string, tags string, uploaded_at string").withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp"))
    assert [r.id for r in R.page(df, "uploaded_at", 1, 2).collect()] == ["6", "5"]
    assert [r.id for r in R.page(df, "uploaded_at", 2, 2).collect()] == ["4"]
    assert R.page_bounds(None, None) == (0, 10) and R.page_bounds(3, 1000) == (200, 100) and R.page_bounds(-1, 0) == (0, 10)
    assert df.filter(R.conditions(tag="report")).count() == 2 and df.filter(R.conditions(status="processing")).first().id == "5"
    assert df.filter(R.conditions(name="%")).count() == 0 and df.filter(R.conditions()).count() == 3
    assert R.status_metrics(df.limit(0)).first().asDict() == {"total": 0, "uploaded": 0, "processing": 0, "completed": 0, "failed": 0}
    assert {r.status: r.n for r in R.status_distribution(df).collect()} == {"uploaded": 1, "processing": 1, "completed": 1, "failed": 0}
    assert [r.id for r in R.accepted(df)[1].collect()] == ["6"]
    with pytest.raises(LookupError):
        R.lookup(df, "7")
    assert {r.id for r in R.without(df, df.filter("id = '4'"), "id").collect()} == {"5", "6"}
    changed = R.update(df, spark.createDataFrame([("4", "new")], "id string, tags string"), "id")
    assert {r.id: r.tags for r in changed.collect()} == {"4": "new", "5": "report", "6": "memo"}
    allowed = [("uploaded", "processing"), ("processing", "completed"), ("processing", "failed"), ("failed", "processing")]
    moves = spark.createDataFrame([*allowed, ("completed", "processing"), ("completed", "failed"), ("failed", "completed")], "a string, b string")
    assert [r.ok for r in moves.select(R.allowed_change(F.col("a"), F.col("b")).alias("ok")).collect()] == [True] * 4 + [False] * 3


def test_metadata(spark):
    rows = [(1, 1, {"title": "标题", "pages": "5"}), (1, 2, {"title": "完整标题", "pages": "10"}), (2, 1, {"title": ""}), (2, 2, {"title": "x"})]
    df = spark.createDataFrame(rows, "k int, o int, m map<string,string>")
    assert {r.k: json.loads(r.m) for r in merge_metadata(df, "k", "o", "m").collect()} == {1: {"title": "完整标题", "pages": "5"}, 2: {"title": "x"}}


def test_search_filters(spark):
    rows = [(1, "file1", [0.1, 0.2, 0.3, 0.4], {"category": "tech"}), (2, "file1", [0.5, 0.6, 0.7, 0.8], {"category": "tech"}), (3, "file2", [0.9, 0.8, 0.7, 0.6], {"category": "science"})]
    df = spark.createDataFrame(rows, "id long, file_id string, vector array<float>, metadata map<string,string>")
    assert S.filter_chunks(df, ["file1"]).count() == 2 and S.filter_chunks(df, None, {"category": "tech"}).count() == 2
    assert S.filter_chunks(df, None, {"category": "^=sci"}).count() == 1 and S.filter_chunks(df, None, {"other": "x"}).count() == 0
    assert S.search_one(df, [0.15, 0.25, 0.35, 0.45], 1).first().id == 1
    good, bad = S.split_valid(df.withColumn("vector", F.when(F.col("id") == 2, F.array(F.lit(float("nan")))).otherwise(F.col("vector"))), 4)
    assert good.count() == 2 and bad.first().reason == "dimension"


@pytest.mark.parametrize("kind", ["cosine", "dot", "l2"])
def test_search_against_numpy(spark, kind):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((60, 8))
    m[7] = m[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vector array<double>").repartition(3)
    got = {}
    for r in S.top_k(df, df.filter("id < 5"), 4, kind, min_score=-1.0).collect():
        got.setdefault(r.question_id, []).append((r.rank, r.id))
    for q in range(5):
        s = np.round(S._scores(m[q : q + 1], m, kind)[0], 6)
        want = sorted(range(60), key=lambda i: (-s[i], i))[:4]
        assert [i for _, i in sorted(got[q])] == want
    assert S.top_k(df.limit(0), df).count() == 0


def test_approximate_recall(spark):
    chunks = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = chunks.filter("id % 50 = 0")
    exact = S.top_k(chunks, asked, min_score=-1.0)
    assert S.recall(S.lsh_neighbours(chunks, asked), exact).first().recall >= 0.9
    assert S.recall(S.inverted_lists(chunks, asked), exact).first().recall >= 0.9


def test_approximate_search_in_scopes(spark):
    chunks = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("label") % 4).cast("string").alias("file_id"))
    asked = chunks.filter("id % 50 = 0").withColumn("file_id", F.when(F.col("id") % 100 == 0, F.col("file_id")))
    exact = S.top_k(chunks, asked, min_score=-1.0, chunk_scope="file_id", question_scope="file_id").cache()
    found = S.inverted_lists(chunks, asked, chunk_scope="file_id", question_scope="file_id")
    assert S.recall(found, exact).first().recall >= 0.9
    scope = {r.id: r.file_id for r in chunks.collect()}
    own = {r.id: r.file_id for r in asked.collect()}
    rows = found.collect()
    assert all(own[r.question_id] in (None, scope[r.id]) for r in rows)
    right = {(r.question_id, r.id): r.score for r in exact.collect()}
    assert all(right.get((r.question_id, r.id), r.score) == pytest.approx(r.score, abs=1e-6) for r in rows)
    # No more than 40 of 2,000 chunks are scored by their whole vectors for a question.
    assert S.list_count(2000) == 179 and S.list_count(10**12) == S.MOST_LISTS and S.list_count(0) == 4


def test_questions_in_a_grid(spark, monkeypatch):
    """Questions too large to broadcast meet every chunk once."""
    chunks = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("file_id"))
    asked = chunks.withColumn("file_id", F.when(F.col("id") % 3 == 0, F.col("file_id")))
    search = lambda: S.top_k(chunks.repartition(5), asked.repartition(3), 4, chunk_scope="file_id", question_scope="file_id")
    few = sorted(map(tuple, search().collect()))
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    many = search()
    assert sorted(map(tuple, many.collect())) == few
    plan = many._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unsound_and_ragged_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 2.0]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    for search in (S.top_k, S.lsh_neighbours, S.inverted_lists):
        assert {(r.question_id, r.id) for r in search(df, df).collect()} >= {(1, 1), (6, 6)}
        assert {r.question_id for r in search(df, df).collect()} == {1, 6}
        assert not search(df.limit(0), df).collect() and not search(df, df.limit(0)).collect()
        ragged = df.unionByName(spark.createDataFrame([(8, [1.0, 2.0, 3.0])], df.schema)).coalesce(1)
        with pytest.raises(Exception, match="different lengths: 2, 3"):
            search(ragged, ragged).collect()
    with pytest.raises(Exception, match="of length 3, chunks of length 2"):
        S.top_k(df, spark.createDataFrame([(8, [1.0, 2.0, 3.0])], df.schema)).collect()


def test_contexts(spark):
    hits = spark.createDataFrame([(1, 1, "a", 0.95), (1, 2, "b", 0.9), (1, 3, "a", 0.85), (2, 1, "c", 0.1)], "question_id int, rank int, text string, score double")
    asked = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "question_id int, question string")
    got = {r.question_id: r.context for r in G.contexts(asked, hits, sources=True).collect()}
    assert got == {1: "[SOURCE_1] a\n\n[SOURCE_2] b", 2: "", 3: G.NO_CONTEXT}
    said = {r.question_id: r.prompt for r in G.prompts(asked, G.contexts(asked, hits)).collect()}
    assert "- a\n\n- b" in said[1] and "q1" in said[1]


def test_chat(spark):
    rows = [(1, 0, "user", "q one"), (1, 1, "assistant", "a one"), (1, 2, "user", "q two"), (2, 0, "user", "q one")]
    m = spark.createDataFrame(rows, "session_id int, turn int, role string, content string").withColumn("created_at", (F.col("session_id") * 100 + F.col("turn")).cast("timestamp"))
    assert [r.question for r in H.recent_questions(m, 5).collect()] == ["q one", "q two"]
    assert {(r.question, r.answer) for r in H.pairs(m).collect()} == {("q one", "a one"), ("q two", None), ("q one", None)}
    turns = spark.createDataFrame([(1, 0, "q", "a", None), (1, 1, "r", None, "down")], "session_id int, turn int, question string, answer string, error string")
    assert [r.content for r in H.append_turns(turns).orderBy("turn").collect()] == ["q", "a", "r", H.APOLOGY + "down"]


def test_task_state_does_not_depend_on_order(spark):
    rng = random.Random(4)
    rows = [(i, f"t{rng.randrange(5)}", "d1", "parse", rng.choice(K.STATUSES), f"2024-01-01 00:{rng.randrange(60):02}:00", f"r{i}" if rng.random() < 0.5 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "event_id long, task_id string, document_id string, type string, status string, ts string, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    a = sorted(map(str, K.state(df).collect()))
    assert a == sorted(map(str, K.state(df.repartition(5).orderBy(F.rand(1))).collect()))
    assert K.eligible(K.state(df), 1000).filter("status <> 'failed'").count() == 0


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "c b a"), (3, " "), (4, None)], "doc_id int, text string")
    good, empty = embed(df, model="no such model")
    v = {r.doc_id: r.vector for r in good.collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[1]) - 1) < 1e-5 and len(v[1]) == 64 and empty.count() == 2 and resolve(None) == "hashed-64"


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one\ntwo")
    (tmp_path / "y.md").write_text("# T")
    got = {(r.id, r.name, r.size, r.mime) for r in files.list_files(spark, str(tmp_path)).collect()}
    assert got == {("x", "x.txt", 7, "text/plain"), ("y", "y.md", 3, "text/markdown")}
    assert {r.text for r in files.read_texts(spark, str(tmp_path)).collect()} == {"one\ntwo", "# T"}
    df = spark.createDataFrame([("a.md", "# Head\n\nsome **bold** [link](u)"), ("b.html", "<p>x &amp; y</p><script>no</script>z"), ("c.pdf", "?")], "file_name string, content string")
    yes, no = files.parse(df)
    assert {r.file_name: r.text for r in yes.collect()} == {"a.md": "Head\n\nsome bold link", "b.html": "x & y\n\nz"} and no.first().file_name == "c.pdf"


def test_search_without_some_vectors(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, vector array<double>")
    questions = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "id long, vector array<double>")
    found = S.top_k(chunks, questions, 5).collect()
    assert [(r.question_id, r.id) for r in sorted(found, key=lambda r: r["rank"])] == [(7, 1), (7, 3)]


def test_write_by_date_divides_large_days(spark, tmp_path):
    rows = [(i, "1996-03-01 08:00:00") for i in range(40)] + [(40, "1997-12-31 23:59:59"), (41, None), (41, None)]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("at", F.col("t").cast("timestamp"))
    files.write_by_date(df, str(tmp_path / "days"), "at", file_rows=10)
    got = spark.read.parquet(str(tmp_path / "days"))
    assert sorted((r.id, r.t or "") for r in got.collect()) == sorted((i, t or "") for i, t in rows)
    assert set(got.columns) == {"id", "t", "at", "year", "month", "day"}
    assert got.filter("year = 1996 AND month = 3 AND day = 1").count() == 40
    assert len(list((tmp_path / "days" / "year=1996").rglob("*.parquet"))) > 1
