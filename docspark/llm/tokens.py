"""Token ids and token counts of many texts, computed once per distinct piece.

Byte-pair tokenizers never merge across white space, so a text can be cut where
white space begins.  Each distinct piece is encoded once per Python worker and
remembered; whole texts are put together from the pieces' ids by numpy.  The
memory is bounded: a full store starts anew.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from docspark.llm.words import WHITE, Hasher, utf8

#: Distinct pieces a worker remembers, and the bytes that they and their runs may take.
STORE_PIECES = 1_500_000
STORE_BYTES = 64_000_000
#: New pieces given to a library at once; its objects for them live meanwhile.
ENCODED_TOGETHER = 5_000
HASHER = Hasher(8)


def pieces(texts: pa.Array, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, first): texts cut before each run of ASCII white space.

    A cut is left out after Unicode white space, since one token could hold both,
    and before bytes that are not in `begins`, a mask of 256 (none: all may begin a piece).
    Piece j of text k is number first[k] + j; together the pieces are the text.
    """
    data, offsets = utf8(texts)
    if not len(data):
        return data, *(np.zeros(0, np.int64),) * 2, np.zeros(len(offsets), np.int64)
    white = WHITE[data]
    cut = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    if begins is not None:
        cut = cut[begins[data[cut]]]
    last, before = data[cut - 1], data[np.maximum(cut - 2, 0)]
    wide = (last >= 0x80) & (((before == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((before >= 0x80) & (before <= 0x81)) | (before == 0x9A))
    cut = cut[~wide & ~((last >= 0x1C) & (last <= 0x1F))]
    starts = np.union1d(cut, offsets[:-1][np.diff(offsets) > 0])
    return data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets, "left")


class Store:
    """Remembers a run of integers for each 64-bit hash."""

    def __init__(self, kind: type):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))] * 2
        self.pool = np.empty(1 << 16, self.kind)
        self.used = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start in the pool (-1: not there) and length for each key."""
        at, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int32)
        for known, starts, sizes in self.levels:
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[i] == keys
                at[hit], size[hit] = starts[i[hit]], sizes[i[hit]]
        return at, size

    def add(self, keys: np.ndarray, runs: list) -> None:
        """keys are ascending and new."""
        sizes = np.fromiter(map(len, runs), np.int32, len(runs))
        self.add_flat(keys, np.fromiter((x for run in runs for x in run), self.kind, int(sizes.sum())), sizes)

    def add_flat(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """The same for runs that stand one after the other in `flat`."""
        sizes, total = sizes.astype(np.int32), len(flat)
        if self.used + total > len(self.pool):
            grown = np.empty(self.used + max(total, self.used // 4), self.kind)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + total] = flat
        level = (keys, self.used + np.cumsum(sizes) - sizes, sizes)
        self.used += total
        fresh = _merge(self.levels[1], level)
        if len(fresh[0]) > 20_000 + len(self.levels[0][0]) // 6:  # few large merges
            self.levels = [_merge(self.levels[0], fresh), (keys[:0], level[1][:0], sizes[:0])]
        else:
            self.levels = [self.levels[0], fresh]

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.levels)

    @property
    def nbytes(self) -> int:
        return self.pool.nbytes + sum(x.nbytes for level in self.levels for x in level)


def _merge(a: tuple, b: tuple) -> tuple:
    """Both in the order of their keys; no key is in both."""
    at = np.searchsorted(a[0], b[0]) + np.arange(len(b[0]))
    first = np.ones(len(a[0]) + len(b[0]), bool)
    first[at] = False
    merged = []
    for x, y in zip(a, b, strict=True):
        both = np.empty(len(first), x.dtype)
        both[first], both[at] = x, y
        merged.append(both)
    return tuple(merged)


class Encoder:
    """Encodes the pieces of Arrow arrays of texts; `encode` maps a list of strings to their runs of integers."""

    def __init__(self, encode: Callable[[list[str]], list], kind: type = np.uint32, cut: Callable = pieces):
        self.encode, self.cut, self.store = encode, cut, Store(kind)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(values, first): values[first[k]:first[k+1]] belong to text k."""
        data, starts, ends, first = self.cut(texts)
        if not len(starts):
            return np.zeros(0, self.store.kind), np.zeros(len(first), np.int64)
        keys, one, back = np.unique(HASHER.ranges(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.store) + len(keys) > STORE_PIECES or self.store.nbytes > STORE_BYTES:
            self.store.clear()
        at, size = self.store.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            for k in range(0, len(new), ENCODED_TOGETHER):
                some = new[k : k + ENCODED_TOGETHER]
                said = [data[a:b].tobytes().decode() for a, b in zip(starts[one[some]].tolist(), ends[one[some]].tolist(), strict=True)]
                self.store.add(keys[some], self.encode(said))
            at, size = self.store.find(keys)
        at, size = at[back], size[back]
        upto = np.concatenate([[0], np.cumsum(size)])
        values = self.store.pool[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])]
        return values, upto[first]


#: One encoder for each vocabulary and use in this worker.
_ENCODERS: dict = {}
#: What else encoders need; it goes with them.
VOCABULARIES: dict = {}


def encoder(key: tuple, make: Callable[[], Encoder]) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = make()
    return _ENCODERS[key]


def forget() -> None:
    """Frees this worker's encoder, before work that needs none: Spark may give the next encoding to another worker."""
    _ENCODERS.clear()
    VOCABULARIES.clear()
