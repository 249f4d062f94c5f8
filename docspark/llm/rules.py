"""Quality rules: statistics of each text, and an isolation forest that tells anomalous ones.

A tree cuts a small sample of labelled rows at random places until each row is
alone or the tree is deep enough.  Rows that differ from the others are alone
after few cuts, so the mean path length over many trees, as a score between 0
and 1, says how odd a row is.  Several forests look at different statistics, since
one that sees all of them takes a good text with a repeated notice for as odd as
junk.  From which score on a row goes is calibrated for one forest after the
other on all labelled rows that the former ones leave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.frames import add_columns, set_aside, stored
from docspark.llm.words import Hasher, inside, utf8, white_words

#: Labelled rows that the trees may see, rows of each tree, and trees.
SAMPLE_ROWS, TREE_ROWS, TREES = 8192, 256, 128
#: Scores are counted in so many bins to find the cut.
BINS = 4096
#: A good labelled row that a cut loses counts as much as so many bad ones that it finds.
PRICE = 4
#: Words of usual length and without symbols that are added to each text, as rates of short texts scatter.
ADDED_WORDS = 20
#: The columns of _features that each forest sees; they are calibrated in this order.
VIEWS = {"symbols": [1], "form": [0, 1], "repeats": [2, 3], "all": [0, 1, 2, 3]}
STATISTICS = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"
NAMES = [x.split()[0] for x in STATISTICS.split(", ")]
VERDICTS = ["scores", "base_failed", "odd_for", "kept"]
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
HASHER = Hasher(11)


def _per_text(hits: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of these ascending positions lie in each range bounds[k]:bounds[k+1]."""
    return np.diff(np.searchsorted(hits, bounds, "left"))


def _repeated(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that are equal in all keys: a mask of those that occur twice or more, and of all but the first."""
    order = np.lexsort(keys[::-1])
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    twice, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return twice, later


def _statistics(texts: pa.Array) -> list[np.ndarray]:
    data, offsets = utf8(texts)
    words = white_words(texts)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # a code point begins at each byte that continues none
    upto = np.concatenate([[0], np.cumsum(chars[words.ends] - chars[words.starts])])
    # A line is what lies between two \n of one text; it counts if a word begins in it.
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.unique(np.concatenate([breaks + 1, offsets[:-1]]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[has], ends[has]
    ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == 0x0A))
    doc = np.searchsorted(offsets, starts, "right") - 1
    later = _repeated([doc, HASHER.ranges(data, starts, ends), ends - starts])[1]
    # Five-word windows that occur twice in a text; two are equal if their five words are.
    each = HASHER.ranges(data, words.starts, words.ends)
    at = inside(words.first, 5)
    twice = _repeated([words.doc[at], HASHER.grams(each, 5)[at], each[at], each[at + 4]])[0]
    cover = np.zeros(len(each) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    covered = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    return [
        words.counts,
        np.diff(upto[words.first]),
        _per_text(np.flatnonzero(SYMBOL[data]), offsets),
        _per_text(starts, offsets),
        _per_text(starts[later], offsets),
        _per_text(covered, words.first),
    ]


def rule_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds statistics of whole texts to each row.

    n_words (between ASCII white space), word_chars (code points in words),
    n_symbols (of `#*$%&|<>`), n_lines (with a word), n_dup_lines (equal to an
    earlier line of the text), n_repeat_words (words in five-word windows that
    occur twice or more in the text, the first included).

    Null and empty texts have zeros; texts may be of any length; repeated rows
    count each for itself; columns with these names are replaced.
    """

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(x, pa.int64()) for x in _statistics(part.column(part.schema.get_field_index(text)))]

    return add_columns(docs, text, STATISTICS, make)


def base_failed(n_words: str = "n_words", repeated: str = "n_repeat_words") -> Column:
    """The plain rules that need no model: too short, or a fifth of the words in repeated windows."""
    return (F.col(n_words) < 10) | (100 * F.col(repeated) > 20 * F.col(n_words))


def _features(columns: list[np.ndarray], length: float) -> np.ndarray:
    """Word length, symbols a word, share of repeated lines and of repeated words: a row for each document."""
    n, chars, symbols, lines, dup, repeat = (c.astype(float) for c in columns)
    more = n + ADDED_WORDS
    return np.stack([np.log((chars + ADDED_WORDS * length) / more), np.log1p(symbols / more), dup / np.maximum(lines, 1), repeat / np.maximum(n, 1)], axis=1)


def usual_path(n: float) -> float:
    """Mean length of an unsuccessful search in a random search tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: node i of a tree has its children at 2i and 2i + 1; a leaf sends all rows to the left."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    depth: int
    rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path over the usual one: near 1 for rows that are soon alone."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, feature[node]] >= cut[node])
            total += path[node]
        return np.exp2(-total / len(self.feature) / max(usual_path(self.rows), 1e-9))


def grow(sample: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 11) -> Forest:
    """An isolation forest over the rows of `sample`."""
    rng = np.random.Generator(np.random.PCG64(seed))
    size = min(tree_rows, len(sample))
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    feature = np.zeros((trees, 2 << depth), np.int64)
    cut = np.full((trees, 2 << depth), np.inf)
    path = np.zeros((trees, 2 << depth))
    for t in range(trees):
        # (node, its level, its rows, the length known of its path or None)
        waits = [(1, 0, sample[rng.permutation(len(sample))[:size]], None)]
        while waits:
            node, level, x, known = waits.pop()
            if known is None:
                low, high = (x.min(0), x.max(0)) if len(x) else (np.zeros(0), np.zeros(0))
                free = np.flatnonzero(high > low)
                if level == depth or not len(free):
                    known = level + usual_path(len(x))
                else:
                    f = int(rng.choice(free))
                    c = rng.uniform(low[f], high[f])
                    c = c if c > low[f] else high[f]
                    feature[t, node], cut[t, node] = f, c
                    right = x[:, f] >= c
                    waits += [(2 * node, level + 1, x[~right], None), (2 * node + 1, level + 1, x[right], None)]
                    continue
            path[t, node] = known
            if level < depth:
                waits.append((2 * node, level + 1, x[:0], known))
    return Forest(feature, cut, path, depth, size)


@dataclass
class Model:
    """The forests by the names of VIEWS, none if nothing was learned; from the score `cuts[name]` on a row goes."""

    length: float
    forests: dict[str, Forest]
    cuts: dict[str, float]

    def scores(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        x = _features([batch.column(batch.schema.get_field_index(n)).to_numpy() for n in NAMES], self.length)
        return {name: forest.scores(x[:, VIEWS[name]]) for name, forest in self.forests.items()}


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows with a column scores: struct of a score for each forest."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField(name, T.DoubleType()) for name in model.forests])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = sent.value.scores(b)
            made = pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in scores.values()], names=list(scores))
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, "scores"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("scores", kind)]))


def _odd(model: Model) -> Column:
    """The names of the forests for which a row of _scored is too odd."""
    return F.filter(F.array(*(F.when(F.col("scores")[name] >= cut, F.lit(name)) for name, cut in model.cuts.items())), lambda x: x.isNotNull())


def fit(statistics: DataFrame, labels: DataFrame, doc_id: str = "doc_id", good: str = "quality", price: float = PRICE) -> Model:
    """The forests and their cuts from rows of rule_statistics and labels (doc_id, quality: 1 good, 0 bad).

    The trees see a bounded sample, the SAMPLE_ROWS labelled rows with the least
    hashes; the cuts are found from the counts of all labelled rows by score and
    label.  Rows that fail the plain rules take no part.

    A document with several labels has the worst; null labels and null ids
    count as none.  Without labels of both kinds there is nothing to calibrate by
    and every row stays.
    """
    judged = labels.select(F.col(doc_id).alias("_id"), F.col(good).cast("int").alias("_good")).dropna().groupBy("_id").agg(F.min("_good").alias("_good"))
    rows = statistics.filter(~base_failed()).select(F.col(doc_id).alias("_id"), *NAMES)
    rows = stored(rows.join(judged, "_id").select(*NAMES, "_good"), "labelled")
    picked = rows.orderBy(F.xxhash64(*NAMES), *NAMES, "_good").limit(SAMPLE_ROWS).select(*NAMES).toArrow()
    sample = [picked.column(n).to_numpy() for n in NAMES]
    if not picked.num_rows:
        return Model(0.0, {}, {})
    length = float(sample[1].sum() / sample[0].sum())
    x = _features(sample, length)
    model = Model(length, {name: grow(x[:, columns]) for name, columns in VIEWS.items()}, {})
    scored = stored(_scored(rows, model).select("scores", "_good"), "scored")
    for name in VIEWS:
        left = scored.filter(F.size(_odd(model)) == 0) if model.cuts else scored
        bins = left.groupBy(F.floor(F.col("scores")[name] * BINS).alias("bin"), (F.col("_good") > 0).alias("good")).count().collect()
        count = np.zeros((2, BINS + 1))
        for r in bins:
            count[int(r["good"]), r["bin"]] += r["count"]
        if not count.sum(1).all():
            break
        # How many bad and good rows go if all bins from k on do.
        bad, fine = count[:, ::-1].cumsum(1)[:, ::-1]
        gain = bad - price * fine
        best = np.flatnonzero(gain == gain.max())  # of equal cuts the middle one of those next to each other
        run = best[: np.flatnonzero(np.append(np.diff(best) > 1, True))[0] + 1]
        k = int(run[len(run) // 2])
        if gain[k] > 0:
            model.cuts[name] = k / BINS
    return model


def judge(statistics: DataFrame, model: Model) -> DataFrame:
    """Adds scores (by forest), base_failed, odd_for (names of forests) and kept to rows of rule_statistics.

    A row stays if it passes the plain rules and each forest's score lies below
    its cut.  Columns with these names are replaced; no row goes or moves.
    """
    rows = statistics.drop("scores", "base_failed", "odd_for", "kept")
    if not model.cuts:
        rows = rows.withColumn("scores", F.lit(None).cast("struct<all:double>")).withColumn("odd_for", F.array().cast("array<string>"))
    else:
        rows = _scored(rows, model).withColumn("odd_for", _odd(model))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.size("odd_for") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, also those named as a statistic or a verdict.

    Texts are read twice: for the model and for the verdicts.  Odd cases as in
    rule_statistics and fit; an empty table stays empty.
    """
    columns = docs.columns
    held, back = set_aside(docs.withColumnRenamed(doc_id, "_id") if doc_id != "_id" else docs, [*NAMES, *VERDICTS])
    held = rule_statistics(held, text)
    statistics = stored(held.select("_id", *NAMES), "statistics")
    model = fit(statistics.withColumnRenamed("_id", doc_id), labels, doc_id)
    kept = judge(held, model).filter("kept").drop(*NAMES, *VERDICTS)
    return kept.withColumnsRenamed(back | {"_id": doc_id}).select(*columns)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    statistics = stored(rule_statistics(docs).drop("text"), "statistics")
    model = fit(statistics, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    shown = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "odd_for"]
    return judge(statistics, model).select(*shown)
