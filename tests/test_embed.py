"""Embedding records and reports against a plain version."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import embed as E


def counted(text, dimension=64):
    v = np.zeros(dimension)
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        v[(h >> 1) % dimension] += 1 - 2 * (h & 1)
    return v


def test_reports(spark):
    requests = [(1, ["one two", "Two  three é", "x" * 9000 + " y"], [{"a": "1"}, None]), (2, ["solo"], None), (3, [], None), (4, None, None), (5, ["fine", " \n"], []), (6, [None], []), (7, ["a"] * 40, [{"k": str(i)} for i in range(50)])]
    df = spark.createDataFrame(requests, "id int, texts array<string>, notes array<map<string,string>>").withColumn("report", F.lit("replaced"))
    for model, normalise in (("counted-64", False), ("counted-64", True), ("hashed-64", False)):
        made, refused = E.embed_batches(df, "texts", "notes", model, normalise)
        assert made.columns == ["id", "texts", "notes", "report"] and sorted(r.id for r in refused.collect()) == [3, 4, 5, 6]
        got = {r.id: r.report for r in made.collect()}
        assert sorted(got) == [1, 2, 7]
        for i, texts, notes in requests:
            if i in got:
                r = got[i]
                assert (r.model, r["count"], r.dimension, r.normalised) == (model, len(texts), 64, normalise)
                assert r.text_lengths == [len(t) for t in texts]
                assert [x["index"] for x in r["items"]] == list(range(len(texts)))
                for k, (x, text) in enumerate(zip(r["items"], texts, strict=True)):
                    want = counted(text[:8192])
                    want = want / np.linalg.norm(want) if normalise or model == "hashed-64" else want
                    assert np.allclose(x["embedding"], want, atol=1e-6)
                    assert (x["dimension"], x["model"], x["metadata"]) == (64, model, notes[k] if notes and k < len(notes) else None)
    assert not E.embed_batches(df.limit(0))[0].collect()


def test_unknown_model_and_no_metadata(spark):
    df = spark.createDataFrame([(["a b"],)], "texts array<string>")
    r = E.embed_batches(df, model="no such")[0].first().report
    assert (r.model, r["items"][0]["metadata"], r.dimension) == (E.DEFAULT, None, 64)


def test_one_text_with_metadata(spark):
    df = spark.createDataFrame([(1, "a b", {"k": 1}), (2, "  ", {"k": 2}), (3, None, None), (4, "c", None)], "id int, text string, more map<string,int>")
    got = {r.id: r.record for r in E.embed_with_metadata(df, metadata="more", model="counted-64").collect()}
    assert sorted(got) == [1, 4] and got[1]["metadata"] == {"k": 1} and got[4]["metadata"] is None
    assert np.array_equal(got[1]["embedding"], counted("a b")) and got[1]["dimension"] == 64


def test_a_model_of_the_wrong_shape(spark, monkeypatch):
    with pytest.raises(ValueError, match="shape"):
        E._in_batches(lambda texts: np.zeros((len(texts), 3)), ["a"] * 20, 16, 64)
    calls = []
    E._in_batches(lambda texts: calls.append(len(texts)) or np.zeros((len(texts), 2)), ["a"] * 37, 16, 2)
    assert calls == [16, 16, 5]


def test_columns_share_a_worker(spark):
    """Two embedded columns are one step; null and blank texts give zeros."""
    df = spark.createDataFrame([(i, f"word{i} " * (i % 5), None if i % 3 else "two  words") for i in range(50)], "id int, a string, b string")
    both = df.select("id", E.embed_column("a", "counted-64").alias("a"), E.embed_column("b", "counted-64").alias("b"))
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for r, given in zip(both.orderBy("id").collect(), df.orderBy("id").collect(), strict=True):
        assert np.array_equal(r.a, counted(given.a)) and np.array_equal(r.b, counted(given.b or ""))
