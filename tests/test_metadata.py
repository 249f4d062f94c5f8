"""Merging of nested metadata."""

import json
import random
from functools import reduce

from docspark.operators.metadata import merge_into, merge_metadata


def test_known_results():
    merged = lambda *rows: reduce(merge_into, rows, {})
    assert merged({"title": "标题1", "pages": 5}, {"title": "标题2", "pages": 10}) == {"title": "标题1", "pages": 5}
    assert merged({"title": "标题"}, {"title": "完整标题"}) == {"title": "完整标题"}
    assert merged({"tags": ["标签1", "标签2"]}, {"tags": ["标签2", "标签3"]}) == {"tags": ["标签1", "标签2", "标签3"]}
    nested = merged({"a": {"b": {"x": "1", "l": [1]}, "c": ""}}, {"a": {"b": {"x": "12", "l": [1, {"k": 2}]}, "c": None, "d": 0}}, {"a": {"c": 3, "d": 4, "b": "no object"}})
    assert nested == {"a": {"b": {"x": "12", "l": [1, {"k": 2}]}, "c": 3, "d": 4}}
    # Empty values are kept until there is another; kinds that differ leave the first.
    assert merged({"a": [], "b": "", "c": {}}, {"a": "x", "b": None, "c": 0}) == {"a": "x", "b": "", "c": {}}
    assert merged({"a": [1, True, 1.0]}, {"a": [1, "1"]}) == {"a": [1, True, 1.0, "1"]}
    assert merged({"a": 1}, {"a": [2]}, {"a": "3"}) == {"a": 1}


def test_rows_in_order(spark):
    rng = random.Random(2)
    value = lambda d: rng.choice(["", "x", "xy", "xyz", None, 0, 7, [], [1], [2, 1], ["a"]] + ([{k: value(d - 1) for k in "pqr" if rng.random() < 0.6}] * 4 if d else []))
    rows = [(rng.randrange(12), i, json.dumps({k: value(3) for k in "abcd" if rng.random() < 0.7})) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, o int, m string").repartition(5)
    got = {r.k: json.loads(r.m) for r in merge_metadata(df, "k", "o", "m").collect()}
    want = {}
    for k, _, m in rows:
        want[k] = merge_into(want.get(k, {}), json.loads(m))
    assert got == want


def test_odd_rows(spark):
    rows = [(None, 1, '{"a": 1}'), (None, 2, '{"b": 2}'), (1, 1, None), (1, 2, "{broken"), (1, 3, "[1]"), (2, None, '{"a": "z"}'), (2, 1, '{"a": "zz"}'), (2, 1, '{"c": "later text"}'), (2, 1, '{"c": "text"}')]
    df = spark.createDataFrame(rows, "k int, o int, m string")
    got = {r.k: json.loads(r.m) for r in merge_metadata(df, "k", "o", "m").collect()}
    assert got == {None: {"a": 1, "b": 2}, 1: {}, 2: {"a": "zz", "c": "later text"}}
    assert not merge_metadata(df.limit(0), "k", "o", "m").collect()


def test_other_kinds_and_a_large_key(spark):
    df = spark.range(30_000).selectExpr("id % 3 as k", "id as o", "parse_json(concat('{\"n\": [', id % 50, '], \"s\": {\"last\": \"\"}}')) as m")
    for rows in (df, df.selectExpr("k", "o", "named_struct('n', array(o % 50), 's', named_struct('last', '')) as m")):
        got = {r.k: json.loads(r.m) for r in merge_metadata(rows.selectExpr("0 as k", "o", "m"), "k", "o", "m").collect()}
        assert got == {0: {"n": list(range(50)), "s": {"last": ""}}}
