"""Token counts by heap-and-linked-list byte-pair merging.

For each word the adjacent pairs wait in a heap by rank; the lowest is popped
and its two symbols become one, linked to their neighbours.  The count is the
number of initial symbols less the number of merges; no id is looked up.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession


from docspark.llm.frames import add_columns
from docspark.llm.tokens import Encoder, encoder

#: Words whose counts a worker remembers besides the pieces.
STORE_WORDS = 300_000
SPACES = regex.compile(r"\s+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (a fixed rule)."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts tokens as a byte-level BPE vocabulary in the tokenizers' JSON format does."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain BPE vocabularies can be counted")
        # Symbols are numbered here by first use; these numbers are not the vocabulary's ids.
        number: dict[str, int] = {}
        name = lambda x: number.setdefault(x, len(number))
        suffix = model.get("end_of_word_suffix") or ""
        self.start = [name(x) for x in byte_symbols()]
        self.last = {name(x): name(x + suffix) for x in byte_symbols()}
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for k, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault(name(a) << 17 | name(b), k)
            self.result.append(name(a + b))
        if len(number) >= 1 << 17:
            raise ValueError("a vocabulary of over 131,072 symbols")
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.steps = [n["type"] for n in _flat(spec.get("normalizer"), "normalizers")]
        if not {*self.steps} <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"unknown normalizers {self.steps}")
        splits = [p for p in _flat(spec.get("pre_tokenizer"), "pretokenizers")]
        found = next((p for p in splits if p["type"] == "Split"), None)
        byte_level = next(p for p in splits if p["type"] == "ByteLevel")
        # The fixed pattern of byte-level vocabularies that bring none of their own.
        self.own = found is not None and "[\\p{L}]+|" in found["pattern"]["Regex"]  # a run of letters is one word
        self.pattern = regex.compile(found["pattern"]["Regex"] if found else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        if not found and not byte_level.get("use_regex", True):
            raise ValueError("a vocabulary that doesn't split text")
        self.words: dict[str, int] = {}

    def merged(self, symbols: list[int]) -> int:
        """Tokens left of these symbols once no pair has a rank."""
        n, rank, result = len(symbols), self.rank, self.result
        # The rank of each symbol's pair with the next one; a heap entry that differs from it is out of date.
        ranks = [rank.get(a << 17 | b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return n
        heapify(heap)
        ranks.append(-1)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if ranks[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            symbols[i] = ab = result[r]
            ranks[j] = ranks[i] = -1
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank.get(ab << 17 | symbols[k], -1)) >= 0:
                    ranks[i] = r
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                ranks[h] = r = rank.get(symbols[h] << 17 | ab, -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        return left

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            symbols = [self.start[b] for b in word.encode()]
            symbols[-1] = self.last[symbols[-1]]
            n = self.words[word] = self.merged(symbols)
            if len(self.words) > STORE_WORDS:
                self.words.clear()
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if self.own:  # white space gives no token
            text = text.strip(" \t\n\v\f\r")
        for step in self.steps:
            if step == "NFC" and not text.isascii():
                text = unicodedata.normalize("NFC", text)
            elif step == "Replace" and not text.isalpha():
                text = SPACES.sub(" ", text)
            elif step == "Lowercase":  # each character for itself: no rule for the end of a word
                text = text.lower() if text.isascii() else "".join(map(str.lower, text))
        if self.own and text.isalpha():
            return self.word(text)
        if self.own and text[-1:] in ".," and text[:-1].isalpha():
            return self.word(text[:-1]) + self.word(text[-1])
        return sum([self.word(w) for w in self.pattern.findall(text)])

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, filter(None, self.special.split(text)))) + len(self.special.findall(text))


def _flat(part: dict | None, inner: str) -> list[dict]:
    return [] if part is None else part.get(inner, [part])


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) to each document.

    `vocabulary` is the path of a byte-level BPE vocabulary in the tokenizers'
    JSON format, read by the driver and sent to the tasks (a megabyte or two).
    Begin and end tokens are not counted; special strings in a text are one
    token each.

    A null or empty text has no bytes and no tokens; a text may be of any length;
    repeated rows are counted each; columns with these names are replaced.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    sent, mark = docs.sparkSession.sparkContext.broadcast(spec), zlib.crc32(spec.encode())

    def fresh() -> Encoder:
        counter = Counter(sent.value)
        return Encoder(lambda said: [(counter(x),) for x in said], np.int32)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        texts = part.column(part.schema.get_field_index(text))
        counts, first = encoder(("count", mark), fresh)(texts)
        n = np.diff(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[first])
        size = pa.compute.fill_null(pa.compute.binary_length(texts.cast(pa.large_binary())), 0).cast(pa.int64())
        return [size, pa.array(n, pa.int64()), pa.array(n > limit)]

    return add_columns(docs, text, "n_bytes bigint, n_tokens bigint, over_limit boolean", make)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
