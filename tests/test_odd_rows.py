"""Queries on odd rows give what their SQL gives."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from docspark.plans import catalog


def both(spark, folder, name, **tables):
    """The rows of the query and of its SQL, sorted, as text: a zero's sign counts."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    return sorted(str([r[c] for c in names]) for r in df.collect()), sorted(str(list(r)) for r in cur.fetchall())


def test_words_that_cancel(spark, tmp_path):
    """Texts whose vector is zero are embedded all the same."""
    import zlib

    seen, pair = {}, None
    for i in range(100_000):
        h = zlib.crc32(f"w{i}".encode())
        if (other := seen.setdefault((h >> 1) % 64, (h & 1, i)))[0] != h & 1:
            pair = f"w{other[1]} w{i}"
            break
    texts = [pair, " " * 9000 + "word", "one two", " ", None]
    documents = pa.table({"doc_id": pa.array(range(5), pa.int64()), "text": pa.array(texts, pa.string())})
    got, want = both(spark, tmp_path, "udf6_model_fallback", documents=documents)
    assert got == want and len(got) == 3


def test_small_values_below_zero(spark, tmp_path):
    """What rounds to zero from below is -0.0."""
    vectors = [[1.0, -3e-7, 3e-7, -2.5], [-4e-8, 0.0, 0.5, -0.0], [0.0] * 4]
    embeddings = pa.table({"vec_id": pa.array([0, 1, 2], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0, 0, 1], pa.int32())})
    for name in ("vec3_vec4_normalise", "vec1_vec9_distances"):
        got, want = both(spark, tmp_path, name, embeddings=embeddings)
        if name.startswith("vec1"):  # the cosine with a zero vector is no number in its SQL
            got, want = got[:2], want[:2]
        assert got == want, name


def test_state_of_events_without_a_time():
    """The fold takes the earliest and latest times that are there, and few steps for a task of few events."""
    import cProfile
    import pstats

    import pandas as pd

    from docspark.streaming.tasks import Task

    at = lambda s: pd.Timestamp(f"2024-01-01 00:00:0{s}")
    rows = pd.DataFrame({"event_id": [1, 2, 3, 4], "ts": [at(1), at(2), at(3), pd.NaT], "status": ["processing", "failed", "completed", "processing"], "props": [None, "a", None, None]})
    task = Task()
    with cProfile.Profile() as p:
        task.add(rows.iloc[:3])
    assert (task.status, task.started, task.ended, task.result, task.failures, task.events) == ("completed", at(1), at(3), "a", 1, 3)
    assert pstats.Stats(p).total_calls < 1500
    late = Task()
    late.add(rows)
    assert (late.started, late.ended, late.events) == (at(1), at(3), 4) and late.stored()[4] is pd.NaT
