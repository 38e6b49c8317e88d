"""Texts as flat byte buffers, and vectorised words, hashes and shingles over them.

An Arrow string column already is one buffer of UTF-8 bytes plus offsets. The
operators of this subpackage work on that buffer with numpy, in blocks of a few
megabytes that are sliced off a batch before anything is made of them: no Python
object is made for a word, and peak memory follows the block size, or the longest
text where that is larger, a few bytes for each of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
#: Bytes hashed at once: there are several numbers of eight bytes for each.
HASH_BYTES = 512 << 10
#: A longer span is hashed in pieces of this size, whose hashes are folded.
LONG_SPAN = 64 << 10

#: glibc's own call for it; other C libraries have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_GOLDEN = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (xor-shift and multiply)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(_GOLDEN)) | np.uint64(1)


_BYTE = constants(256, 1)
_place = constants(1 << 12, 2)


def _places(n: int) -> np.ndarray:
    global _place
    if n > len(_place):
        _place = constants(1 << (n - 1).bit_length(), 2)
    return _place


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Runs of anything but ASCII white space.
NOT_SPACE = ~_SPACE
#: Runs of 0-9, a-z and every code point from U+0080 on (texts are lower-cased first).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


@dataclass
class Texts:
    """Texts one behind the other: `data[offsets[i]:offsets[i + 1]]` is text i in UTF-8."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray | list) -> Texts:
        """Nulls count as empty texts."""
        if isinstance(column, list):
            column = pa.array(column, pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        if not len(offsets):
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        body = column.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        return cls(data, offsets - offsets[0])

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)

    def code_points(self) -> np.ndarray:
        """Code points of each text."""
        out, some = np.zeros(len(self), np.int64), np.flatnonzero(np.diff(self.offsets))
        if len(some):
            out[some] = np.add.reduceat((self.data & 0xC0) != 0x80, self.offsets[some], dtype=np.int64)
        return out


def release() -> None:
    """Give freed memory back to the system: a worker is used again, and keeps no more than it needs."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batch in slices of about `limit` bytes of text; a longer text makes its own slice."""
    texts = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, n = 0, len(texts)
    while at < n:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at), Texts.of(texts.slice(at, to - at))
        at = to
    release()


@dataclass
class Spans:
    """Byte spans in order; those of text i are `first[i]` to `first[i + 1]`."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def spans(texts: Texts, table: np.ndarray) -> Spans:
    """Maximal runs of bytes that `table` marks; runs end at the end of a text."""
    inside = table[texts.data]
    if not len(inside):
        return Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts.offsets), np.int64))
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(inside))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return Spans(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, texts.offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the disjoint, ascending, non-empty spans, by content."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    long = np.flatnonzero(ends - starts > LONG_SPAN)
    if len(long):
        out, rest = np.empty(len(starts), np.uint64), np.delete(np.arange(len(starts)), long)
        out[rest] = span_hashes(data, starts[rest], ends[rest])
        for i in long.tolist():
            cuts = np.append(np.arange(starts[i], ends[i], LONG_SPAN), ends[i])
            folded = np.zeros(1, np.uint64)
            for piece in span_hashes(data, cuts[:-1], cuts[1:]):
                folded = mix64(folded * np.uint64(_GOLDEN) + piece)
            out[i] = folded[0]
        return out
    if ends[-1] - starts[0] > HASH_BYTES and len(starts) > 1:
        cuts = np.unique(np.searchsorted(starts, np.arange(starts[0], ends[-1], HASH_BYTES)))
        parts = zip(cuts, [*cuts[1:], len(starts)], strict=True)
        return np.concatenate([_span_hashes(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]) for a, b in parts if a < b])
    return _span_hashes(data[starts[0] : ends[-1]], starts - starts[0], ends - starts[0])


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    length = ends - starts
    place = _places(int(length.max()))
    mark = np.zeros(len(data), np.int32)
    mark[starts] = 1
    at = np.arange(len(data)) - starts[np.maximum(np.cumsum(mark) - 1, 0)]
    np.clip(at, 0, len(place) - 1, out=at)
    value = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_BYTE[data], place[at], out=value[:-1])
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    return mix64(np.add.reduceat(value, cuts)[0::2] + length.astype(np.uint64) * np.uint64(_GOLDEN))


def combine(*parts: np.ndarray, seed: int = 7) -> np.ndarray:
    """One hash of several hashes in order."""
    c = constants(len(parts), seed)
    out = np.zeros(len(parts[0]), np.uint64)
    for x, k in zip(parts, c, strict=True):
        out += x * k
    return mix64(out)


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words, and where those of each text begin.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    left = np.repeat(n, count)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    c = constants(size, 11)
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        part = padded[at + j] * c[j]
        if j:
            part[left <= j] = 0
        out += part
    return mix64(out + np.minimum(left, size).astype(np.uint64)), begin


def distinct_by_text(hashes: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    return [np.unique(hashes[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ..., counts[i] of them, for each i in turn."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """`text`, the named columns, and all of the table's own in one, `own`: none of a plan's columns clashes with them."""
    return docs.select("text", *names, F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("own"))


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns added, or replaced where a name is taken."""
    names = [x for x in batch.schema.names if x not in columns]
    arrays = [batch.column(batch.schema.get_field_index(x)) for x in names]
    return pa.RecordBatch.from_arrays([*arrays, *columns.values()], names=[*names, *columns])
