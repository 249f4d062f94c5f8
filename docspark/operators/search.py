"""Vector search over whole tables of questions.

Both sides are packed into blocks (one row holds some thousand vectors as one
binary), blocks of questions are joined to the blocks of chunks that they may see, and a matrix
product scores the pair; only the best k of each question leave the pair.  So
neither side passes through the driver or is broadcast whole, and no row is made
for a pair of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import vector as V

BLOCK = 4096
#: Questions whose vectors have at most so many bytes together are broadcast; others meet the chunks in a grid.
BROADCAST_BYTES = 16_000_000
GRID = 8
#: Scores that a task holds at a time; a few arrays of this length are made.
SCORES = 1 << 20
#: Lists of an index at most; the centres are sent to all tasks.
MOST_LISTS = 16_384


def match_metadata(metadata: Column, wanted: dict[str, str]) -> Column:
    """All keys are there and fit: `^=p` a prefix, `$=s` a suffix (in values longer than 2), else the same value."""
    ok = F.lit(True)
    for key, value in wanted.items():
        said = F.try_element_at(metadata, F.lit(key))
        if len(value) > 2 and value.startswith("^="):
            fits = F.startswith(said, F.lit(value[2:]))
        elif len(value) > 2 and value.startswith("$="):
            fits = F.endswith(said, F.lit(value[2:]))
        else:
            fits = said == value
        ok = ok & F.coalesce(fits, F.lit(False))
    return ok


def filter_chunks(chunks: DataFrame, file_ids: list[str] | DataFrame | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """Chunks of these files (a list, or a frame with file_id for many) that match the metadata."""
    if isinstance(file_ids, DataFrame):
        chunks = chunks.join(file_ids.select("file_id").distinct(), "file_id", "left_semi")
    elif file_ids:
        chunks = chunks.filter(F.col("file_id").isin(*file_ids))
    return chunks.filter(match_metadata(F.col("metadata"), metadata)) if metadata else chunks


def split_valid(chunks: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Chunks whose vectors can be stored, and the others with the reason."""
    judged = chunks.withColumn("reason", V.fault(F.col("vector"), dimension))
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def _sound(df: DataFrame, id_column: str, scope: str | None = None) -> DataFrame:
    """(id, scope, vector): rows whose vectors can be compared; null and empty ones and those with a value that is no number are like nothing."""
    v = V.doubles(F.col("vector"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(~odd)
    return rows.select(F.col(id_column).cast("bigint").alias("id"), (F.col(scope) if scope else F.lit(None)).cast("string").alias("scope"), v.alias("vector"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows; ragged ones are an error."""
    sizes = pa.compute.unique(pa.compute.list_value_length(vectors)).to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {', '.join(map(str, sorted(sizes)))}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; those shorter than V.TINY become zeros."""
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(size < V.TINY, 0, m / np.where(size < V.TINY, 1, size))


def _same_length(q: np.ndarray, c: np.ndarray) -> None:
    if q.shape[1] != c.shape[1]:
        raise ValueError(f"questions have vectors of length {q.shape[1]}, chunks of length {c.shape[1]}")


def _blocks(rows: DataFrame, names: str) -> DataFrame:
    """(key, ids, vectors) for up to BLOCK rows of the same key that follow each other in a partition; no row moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                for at in range(begin, end, BLOCK):
                    part = batch.slice(at, min(BLOCK, end - at))
                    columns = [pa.array([keys[at]], pa.string()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([_matrix(part.column(2)).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", f"{names}_ids", f"{names}_vectors"])

    return rows.mapInArrow(run, f"key string, {names}_ids array<bigint>, {names}_vectors binary")


def _met(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Blocks of chunks beside blocks of questions with the same key."""
    size = questions.agg(F.coalesce(F.sum(8 * F.size("vector")), F.lit(0))).first()[0]
    return _beside(_blocks(chunks, "c"), _blocks(questions, "q"), size)


def _beside(c: DataFrame, q: DataFrame, size: int) -> DataFrame:
    """Both sides' blocks joined by their key.

    The questions are broadcast if there are so few that they have at most
    BROADCAST_BYTES (their `size`); otherwise both sides are shuffled by their key, which is
    divided into a grid so that one key is met by many tasks.
    """
    if size <= BROADCAST_BYTES:
        return c.join(F.broadcast(q), "key")
    side = F.sequence(F.lit(0), F.lit(GRID - 1))
    mine = lambda ids: F.pmod(F.xxhash64(ids), F.lit(GRID)).cast("int")
    c = c.withColumn("row", mine("c_ids")).withColumn("column", F.explode(side))
    q = q.withColumn("column", mine("q_ids")).withColumn("row", F.explode(side))
    return c.join(q, ["key", "row", "column"]).drop("row", "column")


def _scores(q: np.ndarray, c: np.ndarray, kind: str) -> np.ndarray:
    """Scores of all questions (rows) with all chunks (columns)."""
    if kind == "l2":
        d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * q @ c.T, 0))
        return np.where(d > 10, 0.0001, np.exp(-d))
    if kind == "dot":
        return np.clip((q @ c.T + 1) / 2, 0, 1)
    nq, nc = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    size = np.outer(nq, nc)
    return np.where(size == 0, 0, np.clip(q @ c.T / np.where(size == 0, 1, size), -1, 1))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, of which only one at a time is copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _few(questions: int, chunks: int) -> Iterator[slice]:
    """So many questions at a time that they make at most SCORES scores with the chunks."""
    step = max(1, SCORES // max(1, chunks))
    return (slice(at, at + step) for at in range(0, questions, step))


def _found(q_ids: np.ndarray, c_ids: np.ndarray, scores: np.ndarray, k: int, digits: int, min_score: float) -> pa.RecordBatch:
    """(question_id, id, score): the best k of each row of scores, rounded first, ties by id; all of at least `min_score` for k of 0 or less."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    least = np.full(len(scores), min_score)
    if 0 < k < scores.shape[1]:
        least = np.maximum(np.partition(scores, -k, axis=1)[:, -k], min_score)
    row, at = np.nonzero(scores >= least[:, None] - 10.0**-digits)
    value = np.round(scores[row, at], digits)
    order = np.lexsort((c_ids[at], -value, row))
    row, at, value = row[order], at[order], value[order]
    ok = (value >= min_score) & (value > -np.inf)
    if k > 0:
        ok &= np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.RecordBatch.from_arrays([pa.array(q_ids[row[ok]], pa.int64()), pa.array(c_ids[at[ok]], pa.int64()), pa.array(value[ok], pa.float64())], names=["question_id", "id", "score"])


def top_k(
    chunks: DataFrame, questions: DataFrame, k: int = 5, kind: str = "cosine", min_score: float = 0.0, chunk_id: str = "id", question_id: str = "id",
    chunk_scope: str | None = None, question_scope: str | None = None, digits: int = 6,
) -> DataFrame:
    """(question_id, id, score, rank): the best k chunks of each question, ties by id.

    With scopes, a question that has one meets only the blocks of chunks of the same
    scope; a question without one meets all.
    Filters come first, so k chunks are found wherever k match; k of 0 or less
    returns all.  Scores are rounded to `digits` before they are ranked, so
    that the order does not depend on how sums were grouped.

    Rows without a sound vector (null, empty, not finite) are left out on both sides; vectors
    of different lengths are an error that names them.
    """
    if kind not in V.KINDS:
        raise ValueError(f"unknown distance {kind!r}; known are {', '.join(V.KINDS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q = np.frombuffer(row["q_vectors"], "<f8").reshape(len(row["q_ids"]), -1)
            c = np.frombuffer(row["c_vectors"], "<f8").reshape(len(row["c_ids"]), -1)
            _same_length(q, c)
            q_ids, c_ids = np.array(row["q_ids"]), np.array(row["c_ids"])
            for at in _few(len(q), len(c)):
                yield _found(q_ids[at], c_ids, _scores(q[at], c, kind), k, digits, min_score)

    scoped = bool(question_scope and chunk_scope)
    c, q = _sound(chunks, chunk_id, chunk_scope if scoped else None), _sound(questions, question_id, question_scope if scoped else None)
    everywhere = lambda rows: rows.withColumn("scope", F.lit("*"))
    blocks = _met(everywhere(c), everywhere(q.filter("scope IS NULL")))
    if scoped:
        of_scope = lambda rows: rows.filter("scope IS NOT NULL").sortWithinPartitions("scope")
        blocks = blocks.unionByName(_met(of_scope(c), of_scope(q)))
    best = blocks.mapInArrow(run, "question_id bigint, id bigint, score double")
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("id").asc())
    ranked = best.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k) if k > 0 else ranked


def search_one(chunks: DataFrame, vector: list[float], k: int = 5, kind: str = "cosine", min_score: float = 0.0) -> DataFrame:
    """One question, as expressions alone: TakeOrderedAndProject after the filter."""
    asked = F.array(*map(F.lit, map(float, vector)))
    d = V.distance(F.col("vector"), asked, kind)
    scored = chunks.withColumn("distance", d).withColumn("score", F.round(V.score(F.col("distance"), kind), 6)).filter(F.col("score") >= min_score)
    ordered = scored.orderBy(F.col("score").desc(), F.col("id").asc())
    return ordered.limit(k) if k > 0 else ordered


def _buckets(rows: DataFrame, names: str, signs: Callable[[np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """(key, ids, vectors): blocks of the vectors that share a key; `signs` gives the keys of a matrix's rows, one column at a time."""
    schema, value = f"key bigint, {names}_ids binary, {names}_vectors binary", np.dtype(kind)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's rows by key: a small block for each key that is there."""
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            for key in signs(m):
                order = np.argsort(key, kind="stable")
                found, begin = np.unique(key[order], return_index=True)
                offsets = np.append(begin, len(key))
                packed = lambda x: pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer((offsets * (x.nbytes // len(x))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x[order]))])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), packed(ids), packed(m.astype(value))], names=["key", f"{names}_ids", f"{names}_vectors"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small blocks of a key that follow each other as blocks of about BLOCK rows at most."""
        key, ids, vectors, n = None, [], [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([b"".join(ids)], pa.binary()), pa.array([b"".join(vectors)], pa.binary())], names=["key", f"{names}_ids", f"{names}_vectors"])
        for row in _rows(batches):
            more = len(row[f"{names}_ids"]) // 8
            if ids and (row["key"] != key or n + more > BLOCK):
                yield done()
                ids, vectors, n = [], [], 0
            key, n = row["key"], n + more
            ids.append(row[f"{names}_ids"])
            vectors.append(row[f"{names}_vectors"])
        if ids:
            yield done()

    small = rows.mapInArrow(split, schema)
    return small.repartition("key").sortWithinPartitions("key").mapInArrow(merge, schema)


def lsh_neighbours(chunks: DataFrame, questions: DataFrame, k: int = 5, bits: int = 8, tables: int = 40, seed: int = 7, probes: int = 1) -> DataFrame:
    """Approximate (question_id, id, score, rank) by random hyperplanes: an equi-join on (table, signs), scored exactly.

    Questions also probe the keys that differ in one sign (`probes` = 1).  Every
    chunk is indexed; the planes are fixed by the seed.  What shares a key is packed
    into blocks, and a pair of blocks is scored by matrix products, of which only
    the best k of a question leave: no row is made for a pair of vectors.  On vectors without
    clusters most pairs share a key in some table, so scores still grow with questions times chunks.
    """
    single = all(s.schema["vector"].dataType.elementType.simpleString() == "float" for s in (chunks, questions))
    flips = [0, *(1 << b for b in range(bits))] if probes else [0]

    def keys(m: np.ndarray, flips: list[int]) -> Iterator[np.ndarray]:
        unit = _unit(m)
        planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((m.shape[1], tables * bits))
        signs = (unit @ planes > 0).reshape(len(m), tables, bits)
        key = (signs << np.arange(bits)).sum(2) + (np.arange(tables) << bits)
        return (key[:, t] ^ f for t in range(tables) for f in flips)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
            q, c = (_unit(np.frombuffer(row[f"{x}_vectors"], kind).astype(np.float64).reshape(len(ids), -1)) for x, ids in (("q", q_ids), ("c", c_ids)))
            _same_length(q, c)
            for at in _few(len(q), len(c)):
                yield _found(q_ids[at], c_ids, q[at] @ c.T, k, 6, -np.inf)

    kind = "<f4" if single else "<f8"
    c = _buckets(_sound(chunks, "id").select("id", "vector"), "c", lambda m: keys(m, [0]), kind)
    q = _buckets(_sound(questions, "id").select("id", "vector"), "q", lambda m: keys(m, flips), kind)
    near = c.join(q, "key").mapInArrow(score, "question_id bigint, id bigint, score double")
    scored = near.groupBy("question_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def list_count(n: int) -> int:
    """Lists for n vectors: four times the root, so that both finding the lists and looking into them grow slower than n."""
    return int(min(MOST_LISTS, max(4, round(4 * n**0.5))))


def inverted_lists(
    chunks: DataFrame, questions: DataFrame, k: int = 5, lists: int | None = None, share: float = 0.35, scoped_share: float = 0.75, again: int = 8, sample: int = 20_000, seed: int = 7,
    chunk_scope: str | None = None, question_scope: str | None = None,
) -> DataFrame:
    """Approximate (question_id, id, score, rank) by cosine: each question looks into the `share` of the lists that is nearest to it.

    Centres are fitted on a sample of at most `sample` rows (those with the least
    hashes of their ids); every chunk belongs to the list of its nearest centre.
    The number of lists follows the number of chunks.  A list's vectors are kept
    as one byte a value in blocks by list and scope; a block meets the blocks of
    questions, each of its lists is scored by one matrix product against those that look into
    it, and only the best `again` * k of each leave the pair.  The best of these are scored again by their whole
    vectors, so that no more than `again` * k pairs of a question are rows.

    Scopes as in `top_k`; where there are scopes, `scoped_share` of the lists is
    looked into, as a scope's nearest are farther and its blocks fewer.  Rows without a sound
    vector are left out; vectors of different lengths are an error.
    """
    scoped = bool(question_scope and chunk_scope)
    rows, asked = _sound(chunks, "id", chunk_scope if scoped else None), _sound(questions, "id", question_scope if scoped else None)
    lists = lists or list_count(rows.count())
    unit = V.normalise(F.col("vector")).alias("vector")
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(unit).toArrow()
    centres = _kmeans(_matrix(picked.column(0).combine_chunks()), lists, seed) if picked.num_rows else np.zeros((1, 1))
    probes, keep = max(1, math.ceil((scoped_share if scoped else share) * len(centres))), again * k

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with their list, one byte a value, and what a unit of it stands for."""
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(2))
                _same_length(m, centres)
                most = np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-12)
                codes = np.round(m / most * 127).astype(np.int8)
                columns = [*batch.columns[:2], pa.array((m @ centres.T).argmax(1), pa.int32()), pa.array(most[:, 0] / 127, pa.float64()), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "scope", "list", "scale", "code"])

    stored = rows.select("id", "scope", unit).mapInArrow(placed, "id bigint, scope string, list int, scale double, code binary")

    def chunk_blocks(key: Column) -> DataFrame:
        """(key, ids, lists, scales, codes): chunks of a key by their lists."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                for begin, end in zip(cuts, cuts[1:], strict=False):
                    for at in range(begin, end, BLOCK):
                        part = batch.slice(at, min(BLOCK, end - at))
                        lists, ids, scales = (part.column(i).to_numpy(zero_copy_only=False).tobytes() for i in (1, 2, 3))
                        columns = [[keys[at]], [ids], [lists], [scales], [b"".join(part.column(4).to_pylist())]]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 0 else pa.binary()) for i, x in enumerate(columns)], names=["key", "c_ids", "c_lists", "c_scales", "c_codes"])

        given = stored.select(key.alias("key"), "list", "id", "scale", "code").filter("key IS NOT NULL")
        # A list that holds much is dealt over some tasks.
        given = given.repartition("list", F.pmod(F.xxhash64("id"), F.lit(GRID))).sortWithinPartitions("key", "list", "id")
        return given.mapInArrow(run, "key string, c_ids binary, c_lists binary, c_scales binary, c_codes binary")

    def question_blocks(key: Column) -> DataFrame:
        """(key, ids, vectors, looks): a bit for each question and list, set where the question looks into the list."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
                for begin, end in zip(cuts, cuts[1:], strict=False):
                    for at in range(begin, end, BLOCK):
                        part = batch.slice(at, min(BLOCK, end - at))
                        m = _matrix(part.column(2))
                        _same_length(m, centres)
                        looks = np.zeros((len(m), len(centres)), bool)
                        np.put_along_axis(looks, np.argpartition(-(m @ centres.T), probes - 1, axis=1)[:, :probes], True, axis=1)
                        columns = [[keys[at]], [part.column(1).to_numpy(zero_copy_only=False).tobytes()], [m.astype(np.float32).tobytes()], [np.packbits(looks, axis=1).tobytes()]]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 0 else pa.binary()) for i, x in enumerate(columns)], names=["key", "q_ids", "q_vectors", "q_looks"])

        given = asked.select(key.alias("key"), "id", unit).filter("key IS NOT NULL").sortWithinPartitions("key", "id")
        return given.mapInArrow(run, "key string, q_ids binary, q_vectors binary, q_looks binary")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
            q, c = np.frombuffer(row["q_vectors"], np.float32).reshape(len(q_ids), -1), np.frombuffer(row["c_codes"], np.int8).reshape(len(c_ids), -1).astype(np.float32)
            scales, lists = np.frombuffer(row["c_scales"], np.float64).astype(np.float32), np.frombuffer(row["c_lists"], np.int32)
            looks = np.unpackbits(np.frombuffer(row["q_looks"], np.uint8).reshape(len(q_ids), -1), axis=1, count=len(centres))
            begins = np.flatnonzero(np.diff(lists, prepend=-1))
            n = min(keep, len(c))
            for at in _few(len(q), len(c)):
                near = np.full((len(q[at]), len(c)), -np.inf, np.float32)
                for begin, end in zip(begins, [*begins[1:], len(c)], strict=True):
                    who = np.flatnonzero(looks[at, lists[begin]])
                    near[who, begin:end] = q[at][who] @ c[begin:end].T * scales[begin:end]
                best = np.argpartition(-near, n - 1, axis=1)[:, :n]
                value = np.take_along_axis(near, best, 1)
                ok = value > -np.inf
                found = [pa.array(np.repeat(q_ids[at], n).reshape(value.shape)[ok], pa.int64()), pa.array(c_ids[best][ok], pa.int64()), pa.array(value[ok].astype(np.float64))]
                yield pa.RecordBatch.from_arrays(found, names=["question_id", "id", "near"])

    # A row for each pair of blocks; questions and lists are bits, so nothing grows with the lists that a question looks into.
    size = asked.agg(F.coalesce(F.sum(4 * F.size("vector") + len(centres) // 8 + 8), F.lit(0))).first()[0]
    everywhere = F.lit("*")
    met = _beside(chunk_blocks(everywhere), question_blocks(F.when(F.col("scope").isNull(), everywhere) if scoped else everywhere), size)
    if scoped:
        met = met.unionByName(_beside(chunk_blocks(F.col("scope")), question_blocks(F.col("scope")), size))
    found = met.mapInArrow(score, "question_id bigint, id bigint, near double")
    closest = Window.partitionBy("question_id").orderBy(F.col("near").desc(), "id")
    found = found.withColumn("_n", F.row_number().over(closest)).filter(F.col("_n") <= keep).select("question_id", "id")
    q, c = asked.select(F.col("id").alias("question_id"), unit.alias("q_vector")), rows.select("id", unit.alias("c_vector"))
    scored = found.join(q, "question_id").join(c, "id").select("question_id", "id", F.round(V.dot(F.col("q_vector"), F.col("c_vector")), 6).alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        at = (points @ centres.T).argmax(1)
        sums = np.stack([points[at == j].sum(0) if (at == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact neighbours that were found."""
    hit = exact.select("question_id", "id").join(found.select("question_id", "id").withColumn("hit", F.lit(1)), ["question_id", "id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))
