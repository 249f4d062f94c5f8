"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (n = 1 to 4, the blended
spectrum) that both contain, over the geometric mean of the numbers that each
contains: presence, not frequency.  Non-letters count as one space, case is
folded.  Nyström landmarks (some training texts of each language) turn a text
into its kernel values with them; one-versus-rest kernel ridge regression on
these gives a score per language.  Texts are scored in batches: a presence matrix
times the landmarks' matrix times the coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.frames import add_columns
from docspark.llm.tokens import forget
from docspark.llm.words import slices, utf8

#: Training texts of each language at most; the sample is fixed by a hash of the id.
TRAIN_PER_LANGUAGE = 250
LANDMARKS_PER_LANGUAGE = 50
#: n-grams are familiar if at least this share of the training texts of some language has them; all n-grams of the landmarks count for the kernel.
LEAST_SHARE = 0.04
RIDGE = 1e-3
#: A text resembles the learned languages if at least this share of its 3- and 4-grams are familiar.  Held-out labelled
#: texts of sf0.1 have 0.57 to 1, random letters and digits up to 0.23, other scripts 0, Polish, Turkish and Finnish
#: sentences 0.22 to 0.41.
LEAST_FAMILIAR = 0.45
#: The bar of a language learned from little text is lower: this share of what its own texts have of each other.
LEAST_OF_OWN = 0.6
LONGEST = 4
SLOT_BITS = 18
UNKNOWN = "und"
#: Texts whose presence matrix is made together.
TOGETHER = 256

#: ASCII letters and bytes beyond ASCII stay, all else is a space.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)
END = 1


def _lowered(texts: list) -> pa.Array:
    return pa.array(["" if t is None else t.lower() for t in texts], pa.large_string())


def ngrams(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the n-grams as 32-bit numbers (bytes, little-endian) and the text of each."""
    data, offsets = utf8(_lowered(texts))
    k = len(texts)
    # " text " + end mark for each text, with runs of spaces made one
    folded = np.full(len(data) + 3 * k, 0x20, np.uint8)
    shift = 3 * np.arange(k)
    folded[np.arange(len(data)) + np.repeat(shift + 1, np.diff(offsets))] = FOLD[data]
    folded[offsets[1:] + shift + 2] = END
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 0x20) | (folded[:-1] != 0x20)
    upto = np.cumsum(keep)
    line = folded[keep].astype(np.uint32)
    ends = upto[offsets[1:] + shift + 2] - 1
    doc = np.repeat(np.arange(k), np.diff(np.concatenate([[-1], ends])))
    grams = line.copy()
    stop = line == END
    for n in range(1, LONGEST + 1):
        if n > 1:
            grams = grams[:-1] | line[n - 1 :] << np.uint32(8 * (n - 1))
            stop = stop[:-1] | (line[n - 1 :] == END)
        at = np.flatnonzero(~stop)
        yield grams[at], doc[: len(grams)][at]


@dataclass
class Model:
    """What tasks need to score texts."""

    languages: list[str]
    features: Features
    #: Which features are familiar.
    familiar: np.ndarray
    #: Landmarks by features, divided by the root of their n-gram counts; coefficients by language.
    landmarks: np.ndarray
    coefficients: np.ndarray
    #: For each language, the share of familiar n-grams from which a text resembles it.
    bars: np.ndarray

    def presence(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which features each text has, how many different n-grams, and the share of its 3- and 4-grams that are familiar."""
        out = np.zeros((len(texts), self.landmarks.shape[1]), np.float32)
        known, all_, others = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        for n, (grams, doc) in enumerate(ngrams(texts), 1):
            number = self.features.find(grams)
            hit = number >= 0
            out[doc[hit], number[hit]] = 1
            # n-grams that no landmark has are in no kernel value but count in the text's norm
            rest = np.unique(grams[~hit].astype(np.uint64) | doc[~hit].astype(np.uint64) << np.uint64(32))
            others += np.bincount((rest >> np.uint64(32)).astype(np.int64), minlength=len(texts))
            if n > 2:  # nearly every pair of letters is familiar
                hit[hit] = self.familiar[number[hit]]
                known += np.bincount(doc[hit], minlength=len(texts))
                all_ += np.bincount(doc, minlength=len(texts))
        return out, out.sum(1) + others, known / np.maximum(all_, 1)

    def scores(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """One row for each text, one column for each language; and the share of familiar n-grams of each text."""
        found, shares = [np.zeros((0, len(self.languages)), np.float32)], [np.zeros(0)]
        for k in range(0, len(texts), TOGETHER):  # a presence matrix has a number for each text and n-gram
            rows, size, share = self.presence(texts[k : k + TOGETHER])
            kernel = (rows @ self.landmarks.T) / np.sqrt(np.maximum(size, 1))[:, None]
            found.append(kernel @ self.coefficients)
            shares.append(share)
        return np.concatenate(found), np.concatenate(shares)


def _slot(grams: np.ndarray, factor: int) -> np.ndarray:
    return (grams * np.uint32(factor)) >> np.uint32(32 - SLOT_BITS)


class Features:
    """A number for each of some n-grams, by hash tables: what finds its slot taken in one is in the next."""

    def __init__(self, grams: np.ndarray):
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        rng = np.random.Generator(np.random.PCG64(4))
        left, number = grams, np.arange(len(grams), dtype=np.int32)
        while len(left) or not self.tables:
            factor = int(rng.integers(0, 2**31)) * 2 + 1
            slot, one = np.unique(_slot(left, factor), return_index=True)
            keys, numbers = np.zeros(1 << SLOT_BITS, np.uint32), np.full(1 << SLOT_BITS, -1, np.int32)
            keys[slot], numbers[slot] = left[one], number[one]
            self.tables.append((factor, keys, numbers))
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, number = left[rest], number[rest]

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The number of each n-gram, -1 for others."""
        out = np.full(len(grams), -1, np.int32)
        at = np.arange(len(grams))
        for factor, keys, numbers in self.tables:
            slot = _slot(grams[at], factor)
            found = (keys[slot] == grams[at]) & (numbers[slot] >= 0)
            out[at[found]] = numbers[slot[found]]
            at = at[~found]
        return out


def _features(sets: list[np.ndarray], label: np.ndarray, languages: int) -> np.ndarray:
    found = [np.zeros(0, np.uint32)]
    for k in range(languages):
        own = [s for s, at in zip(sets, label, strict=True) if at == k]
        if own:
            grams, counts = np.unique(np.concatenate(own), return_counts=True)
            found.append(grams[counts >= max(1, LEAST_SHARE * len(own))])
    return np.unique(np.concatenate(found))


def _unit(sets: list[np.ndarray], features: Features, size: int) -> np.ndarray:
    """One row for each set, divided by the root of its length."""
    out = np.zeros((len(sets), size))
    for row, s in zip(out, sets, strict=True):
        number = features.find(s)
        row[number[number >= 0]] = 1 / np.sqrt(max(len(s), 1))
    return out


def _bars(sets: list[np.ndarray], label: np.ndarray, languages: int) -> np.ndarray:
    """The bar of each language, by what half of the sample knows of the texts in the other half.

    The median is looked at, so that labelled junk does not lower the bar.
    """
    half = np.zeros(len(sets), int)
    for k in range(languages):
        half[label == k] = np.arange((label == k).sum()) % 2
    share = np.zeros(len(sets))
    for side in (0, 1):
        other = np.flatnonzero(half != side)
        known = _features([sets[i] for i in other], label[other], languages)
        for i in np.flatnonzero(half == side):
            long = sets[i][sets[i] >> np.uint32(16) > 0]  # 3- and 4-grams
            share[i] = np.isin(long, known).mean() if len(long) else 0
    return np.array([min(LEAST_FAMILIAR, LEAST_OF_OWN * np.median(share[label == k])) for k in range(languages)])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of the languages in `labelled`; None if no row has a label and a text.

    At most TRAIN_PER_LANGUAGE texts of each language are taken, those with the
    least hashes of their ids and, where ids are null or repeated, of their texts;
    rows with the same id and text count once.  Their n-grams are taken out by tasks;
    the driver solves for the coefficients, whose size does not depend on the table's.
    """
    key = F.col(doc_id).cast("string")
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), key.alias("key"), F.xxhash64(F.col(text)).alias("said"), F.col(text).alias("text"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key", "said")
    ids = rows.select("lang", "key", "said").distinct()
    ids = ids.withColumn("row", F.row_number().over(first)).filter(F.col("row") <= TRAIN_PER_LANGUAGE)
    picked = [(r["lang"], r["key"], r["said"], r["row"]) for r in ids.collect()]
    if not picked:
        return None
    chosen = labelled.sparkSession.createDataFrame(picked, "label string, picked string, hash long, row int")
    same = F.col("key").eqNullSafe(F.col("picked")) & (F.col("lang") == F.col("label")) & (F.col("said") == F.col("hash"))
    # one text for each picked row, however often it is in the table
    texts = rows.join(F.broadcast(chosen), same).groupBy("label", "row").agg(F.min("text").alias("text"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets: list[list[np.ndarray]] = [[] for _ in range(part.num_rows)]
                for grams, doc in ngrams(part.column(2).to_pylist()):
                    cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                    for k in range(part.num_rows):
                        sets[k].append(np.unique(grams[cuts[k] : cuts[k + 1]]))
                found = pa.array([np.concatenate(x).astype("<u4").tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], names=["label", "row", "grams"])

    taken = texts.mapInArrow(take, "label string, row int, grams binary")
    sample = sorted({(r["label"], r["row"]): bytes(r["grams"]) for r in taken.collect()}.items())
    languages = sorted({x for (x, _), _ in sample})
    label = np.array([languages.index(x) for (x, _), _ in sample])
    sets = [np.frombuffer(x, "<u4") for _, x in sample]

    rank = np.array([row for (_, row), _ in sample])
    first = rank <= LANDMARKS_PER_LANGUAGE
    wanted = np.unique(np.concatenate([s for s, mark in zip(sets, first, strict=True) if mark]))
    features = Features(wanted)
    landmarks = _unit([s for s, mark in zip(sets, first, strict=True) if mark], features, len(wanted))
    within = (landmarks @ landmarks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(within)
    good = values > 1e-6 * values.max() if len(values) else values > 0
    root = vectors[:, good] / np.sqrt(values[good])
    # The sample's rows are made a part at a time: all of them are several times the landmarks.
    kernel = [_unit(sets[k : k + TOGETHER], features, len(wanted)) @ landmarks.T for k in range(0, len(sets), TOGETHER)]
    mapped = np.concatenate(kernel) @ root
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language weighs the same, however many texts it has.
    weight = (1 / np.bincount(label, minlength=len(languages)))[label][:, None]
    ridge = RIDGE * np.eye(mapped.shape[1]) * len(languages)
    solved = np.linalg.solve(mapped.T @ (weight * mapped) + ridge, mapped.T @ (weight * target))
    return Model(languages, features, np.isin(wanted, _features(sets, label, len(languages))), landmarks.astype(np.float32), (root @ solved).astype(np.float32), _bars(sets, label, len(languages)))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and resembles to each document; only its text is looked at.

    Null texts and texts without any letter are `und` with score 0, as is every
    text if there was nothing to learn from.  The score is (1 + s) / 2 within 0
    and 1, where s is the regression's output, trained to be 1 for the language
    and -1 for all others.  A tie goes to the language that sorts first.  The score
    tells languages apart; a text that is like none of them scores about 0.5.
    Whether it resembles lang_pred at all is told by the share of its 3- and 4-grams
    that are familiar.
    Whole texts are scored, whatever their length; columns with these names are
    replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, bounded by the training sample

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        forget()
        texts, learned = part.column(part.schema.get_field_index(text)).to_pylist(), sent.value
        if learned is None:
            return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array([0.0] * len(texts), pa.float64()), pa.array([False] * len(texts), pa.bool_())]
        scores, familiar = learned.scores(texts)
        best = scores.argmax(1)
        share = np.clip((1 + scores[np.arange(len(texts)), best].astype(np.float64)) / 2, 0, 1)
        known = [t is not None and any(map(str.isalpha, t)) for t in texts]
        names = [learned.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(known & (familiar >= learned.bars[best]), pa.bool_())]

    return add_columns(docs, text, "lang_pred string, score double, resembles boolean", make)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
