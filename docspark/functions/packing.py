"""Packing the parts of a text into chunks of a bounded number of tokens.

A text is cut into parts (paragraphs or sentences); a part that is too long for a
chunk is cut at the next finer level, down to words and runs of characters.
Each part's size is taken once; a chunk is the longest run of parts from its
begin that fits, found in the parts' running sums, and the next one begins with
the last parts that fit in the overlap.  The work grows with the length of the
text and the number of chunks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: What ends a part of each level; it belongs to the part.
ENDS = {
    "paragraph": r"\n\n+",
    "sentence": r"[.!?]+\s+|[。！？]+\s*",
    "clause": r"[,;:]\s+|[，；：、]\s*",
    "word": r"\s+",
}
LEVELS = {"paragraph": ["paragraph", "sentence", "clause", "word"], "sentence": ["sentence", "clause", "word"]}
#: Characters that count as a token at least.
TOKEN_CHARS = 4
#: Characters of chunks that are handed back to Spark at once.
OUT_CHARS = 4_000_000

_ENDS = {name: re.compile(p) for name, p in ENDS.items()}
Span = tuple[int, int]


def tokens(words: int, chars: int) -> int:
    return max(words, chars // TOKEN_CHARS)


def _cut(text: str, span: Span, level: str) -> list[Span]:
    begin, end = span
    cuts = [begin, *(m.end() for m in _ENDS[level].finditer(text, begin, end) if m.end() < end), end]
    return list(zip(cuts, cuts[1:], strict=False))


def parts(text: str, levels: list[str], size: int) -> list[tuple[int, int, int]]:
    """(begin, end, words) of parts that follow each other, each of at most `size` tokens."""
    done = []
    waits = [(0, span) for span in reversed(_cut(text, (0, len(text)), levels[0]))]
    while waits:
        depth, (begin, end) = waits.pop()
        words = len(text[begin:end].split())
        if tokens(words, end - begin) <= size:
            done.append((begin, end, words))
        elif depth + 1 < len(levels):
            waits += [(depth + 1, span) for span in reversed(_cut(text, (begin, end), levels[depth + 1]))]
        else:
            step = size * TOKEN_CHARS
            done += [(b, min(b + step, end), len(text[b : min(b + step, end)].split())) for b in range(begin, end, step)]
    return done


def pack(text: str, kind: str, size: int, overlap: int) -> list[Span]:
    """Begin and end of each chunk; none is empty or begins or ends with white space."""
    left = len(text) - len(text.lstrip())
    inner = text.strip()
    found = parts(inner, LEVELS[kind], size)
    words = list(accumulate((w for *_, w in found), initial=0))
    chars = list(accumulate((e - b for b, e, _ in found), initial=0))
    spans, first, n = [], 0, len(found)
    while first < n:
        # Both sums ascend, so the runs that fit end before the first that doesn't.
        after = min(bisect_right(words, words[first] + size), bisect_right(chars, chars[first] + TOKEN_CHARS * size + TOKEN_CHARS - 1)) - 1
        after = max(after, first + 1)
        chunk = inner[found[first][0] : found[after - 1][1]]
        begin = found[first][0] + len(chunk) - len(chunk.lstrip())
        chunk = chunk.strip()
        if chunk:
            spans.append((left + begin, left + begin + len(chunk)))
        if after == n:
            break
        room = lambda until, most: max(bisect_left(words, words[until] - most), bisect_left(chars, chars[until] - TOKEN_CHARS * most - TOKEN_CHARS + 1))
        first = min(after, max(first + 1, room(after, overlap), room(after + 1, size)))
    return spans


def sentences(text: str) -> list[str]:
    """The sentences of a text, stripped."""
    return [x for x in (text[b:e].strip() for b, e in _cut(text, (0, len(text)), "sentence")) if x]


def chunked(df: DataFrame, text: str, make: Callable[[], Callable[[str], list[str]]]) -> DataFrame:
    """The other columns of df, index (from 0) and the chunk's text: a row for each chunk that the function of `make`, made once a task, cuts from a text.

    In Arrow batches, without a shuffle; a null text has no chunks.
    """
    kept = [f for f in df.schema.fields if f.name != text]
    names = [f.name for f in kept]

    def made(batch: pa.RecordBatch, found: list[tuple[int, int, str]]) -> pa.RecordBatch:
        rows, index, cut = zip(*found, strict=True)
        columns = [batch.column(k).take(pa.array(rows)) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(index, pa.int32()), pa.array(cut, pa.string())], names=[*names, "index", text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = make()
        for batch in batches:
            found, held = [], 0
            for i, said in enumerate(batch.column(len(names))):
                for k, chunk in enumerate(cut(said.as_py() or "")):
                    found.append((i, k, chunk))
                    held += len(chunk)
                if held > OUT_CHARS:
                    yield made(batch, found)
                    found, held = [], 0
            if found:
                yield made(batch, found)

    schema = T.StructType([*kept, T.StructField("index", T.IntegerType()), T.StructField(text, T.StringType())])
    return df.select(*names, text).mapInArrow(run, schema)


def packed_chunks(df: DataFrame, kind: str, size: int, overlap: int, text: str) -> DataFrame:
    """A row for each chunk of `pack`, beside the other columns."""
    return chunked(df, text, lambda: lambda said: [said[b:e] for b, e in pack(said, kind, size, overlap)])
