"""Words of UTF-8 texts as numpy arrays, for use inside tasks.

Every function works on one Arrow array of texts: its bytes are looked at as a
whole, so that the cost per word is a few vector operations.  A null text has no
words.  Word separators are ASCII bytes, which never occur inside a multi-byte
character, so byte positions are safe to cut at.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that can't be part of a lower-cased alphanumeric word.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes of text that are looked at together; arrays of 8 bytes for each live meanwhile.
SLICE_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """64-bit hashes of byte ranges and of runs of words, fixed by a seed."""

    #: The last hashers used for byte ranges: only two keep their powers (16 MB each), as a worker serves many steps.
    held: ClassVar[list[Hasher]] = []

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = np.uint64(int(rng.integers(0, 2**63)) * 2 + 1)
        self.step = np.uint64(int(rng.integers(0, 2**63)) * 2 + 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self._shrink()

    def _shrink(self) -> None:
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if not any(h is self for h in Hasher.held[-1:]):
            *old, last = [*(h for h in Hasher.held if h is not self), self]
            for h in old[:-1]:
                h._shrink()
            Hasher.held = [*old[-1:], last]
        if len(self.powers) < n:
            n = max(n, SLICE_BYTES + 1)
            for name, x in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, x, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of data[start:end] for each pair; equal bytes give equal hashes."""
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def grams(self, words: np.ndarray, n: int) -> np.ndarray:
        """A hash of words[i:i+n] for each i; the caller drops those that cross documents."""
        if len(words) < n:
            return np.zeros(0, np.uint64)
        m = len(words) - n + 1
        out = words[:m].copy()
        for k in range(1, n):
            out *= self.step
            out += words[k : k + m]
        return mix(out)


@dataclass
class Words:
    """Words of the texts of one slice: word i is data[starts[i]:ends[i]] of text doc[i]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: Word j of text k is number first[k] + j; first has one more entry than there are texts.
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, i: int, j: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True)]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (and the last ends); a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `size` bytes of text; a longer text is a piece of its own."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def give_back() -> None:
    """Gives the system what this worker has freed so far, in earlier tasks too: the allocators of Arrow and C keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def split(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> Words:
    """The maximal runs of bytes that are not gaps, never across texts."""
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(gap[data], out=word[1:-1])
    starts = np.flatnonzero(word[1:-1] & ~word[:-2])
    ends = np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    if len(cuts):  # a word that goes on over the end of a text is two words
        cuts = cuts[word[cuts] & word[cuts + 1]]
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return Words(data, starts, ends, np.searchsorted(starts, offsets, "left"))


def white_words(texts: pa.Array) -> Words:
    """Words between ASCII white space, unchanged."""
    return split(*utf8(texts), WHITE)


def alnum_words(texts: pa.Array) -> Words:
    """A-Z lower-cased; words of digits, letters and any character beyond ASCII."""
    data, offsets = utf8(texts)
    return split(LOWER[data], offsets, NOT_ALNUM)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """The words at which a run of n words of one text begins."""
    at = np.ones(max(0, int(first[-1]) - n + 1), bool)
    for k in range(1, n):  # word first[d] - k can't begin a run: it would reach text d
        x = first[1:-1] - k
        at[x[(x >= 0) & (x < len(at))]] = False
    return np.flatnonzero(at)
