"""Operator 2, token counts, and the piece encoder that operator 10 shares.

A text is cut at safe boundaries: places where the tokenizer's own splitting
always cuts, whatever stands on either side. The tokens of a text are then those
of its pieces in order. Within a block each distinct piece is encoded once, and a
bounded memory keeps what a worker has encoded before. What has no white space and no
ASCII punctuation has no safe boundary either, and stays one piece whatever its length.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

#: Pieces in a generation of a worker's memory, of which there are two, and bytes of a piece's ids that are kept: bounds on it.
REMEMBERED, REMEMBERED_BYTES = 400_000, 64
#: Bytes of text in one call of the library.
CALL_BYTES = 256 << 10

_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = True
_MARK = ~_ALNUM
_MARK[:0x21] = _MARK[0x7F:] = False


def marks(special: list[str]) -> np.ndarray:
    """ASCII punctuation before which a word may be cut off: all but what follows a letter or digit within a special token."""
    table = _MARK.copy()
    for x in special:
        raw = np.frombuffer(x.encode(), np.uint8)
        table[raw[1:][_ALNUM[raw[:-1]]]] = False
    return table


def _before_marks(data: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return np.flatnonzero(_ALNUM[data[:-1]] & mark[data[1:]]) + 1


def cut_words(texts: tx.Texts, mark: np.ndarray) -> tx.Spans:
    """Pieces without white space, for tokenizers that drop it and keep punctuation apart from words."""
    at, inner = tx.spans(texts, tx.NOT_SPACE), _before_marks(texts.data, mark)
    begin, end = np.zeros(len(texts.data) + 1, bool), np.zeros(len(texts.data) + 1, bool)
    begin[at.starts] = begin[inner] = end[at.ends] = end[inner] = True
    starts = np.flatnonzero(begin)
    return tx.Spans(starts, np.flatnonzero(end), np.searchsorted(starts, texts.offsets))


def cut_tiles(texts: tx.Texts, mark: np.ndarray) -> tx.Spans:
    """Pieces that tile the text, for byte-level tokenizers that keep words, figures, punctuation and space apart.

    Cut before white space that follows something else, after a single line break,
    and before punctuation behind a letter or figure. A token holds at most
    leading white space, and no look-around of theirs looks back over such a cut.
    """
    data, space = texts.data, ~tx.NOT_SPACE[texts.data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    # Not after Unicode white space either: U+0085, U+00A0, or one of three bytes.
    cut[2:] &= ~((data[:-2] == 0xC2) & np.isin(data[1:-1], (0x85, 0xA0)))
    cut[3:] &= ~(np.isin(data[:-3], (0xE1, 0xE2, 0xE3)) & (data[1:-2] >= 0x80) & (data[2:-1] >= 0x80))
    cut[:1] = False
    lines = np.flatnonzero(cut & (data == 0x0A))
    lines = lines[(lines + 1 < len(data)) & ~np.isin(lines, texts.offsets)]
    lines = lines[(data[lines + 1] < 0x80) & ~space[lines + 1]]
    cut[lines + 1] = True
    cut[_before_marks(data, mark)] = True
    cut[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return tx.Spans(starts, ends, np.searchsorted(starts, texts.offsets))


class Memory:
    """Ids of pieces by the pieces' hashes: sorted arrays, some thirty bytes for a piece."""

    def __init__(self, width: np.dtype):
        self.hashes, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, width)

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the pieces are known; numbers of ids of those, and their ids, one behind the other."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(0, np.int64), self.flat
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        at = at[found]
        sizes = self.sizes[at].astype(np.int64)
        return found, sizes, self.flat[tx.ragged(self.starts[at], sizes)] if len(self.flat) else self.flat

    def put(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Learn pieces in ascending order that are not known; those with very many ids are not kept."""
        starts = np.cumsum(sizes) - sizes
        short = sizes * self.flat.itemsize <= REMEMBERED_BYTES
        hashes, starts, sizes = hashes[short], starts[short], sizes[short]
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes.astype(np.int32))
        if len(ids):
            self.flat = np.concatenate([self.flat, ids[tx.ragged(starts, sizes)]])


class PieceEncoder:
    """Token ids (or only their number) of pieces, through the tokenizers library."""

    def __init__(self, path: str, cut, lengths_only: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut, self.lengths_only = cut, lengths_only
        self.mark = marks([x.content for x in self.tokenizer.get_added_tokens_decoder().values()])
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known, self.older = Memory(self.width), Memory(self.width)

    def _learn(self, texts: tx.Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the library makes of new pieces, in calls of about equally many bytes: numbers of ids, and the ids."""
        raw, code, sizes, ids = texts.data.tobytes(), "H" if self.width.itemsize == 2 else "I", [], array("H" if self.width.itemsize == 2 else "I")
        call = np.cumsum(ends - starts) // CALL_BYTES
        for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(call)) + 1):
            pieces = [raw[s:e].decode("utf-8") for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
            for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False):
                sizes.append(len(x))
                if not self.lengths_only:
                    ids.extend(array(code, x.ids))
        return np.array(sizes, np.int64), np.frombuffer(ids, self.width) if len(ids) else np.zeros(0, self.width)

    def pieces(self, texts: tx.Texts) -> tuple[tx.Spans, np.ndarray, np.ndarray, np.ndarray]:
        """The pieces, numbers and ids of the distinct ones, and which one each piece is."""
        at = self.cut(texts, self.mark)
        hashes, one, which = np.unique(tx.span_hashes(texts.data, at.starts, at.ends), return_index=True, return_inverse=True)
        if len(self.known.hashes) > REMEMBERED:
            self.known, self.older = Memory(self.width), self.known
        size, parts, new = np.zeros(len(hashes), np.int64), [], np.arange(len(hashes))
        for memory in (self.known, self.older):
            found, sizes, ids = memory.get(hashes[new])
            size[new[found]] = sizes
            parts.append((new[found], ids))
            new = new[~found]
        fresh = one[new]
        size[new], ids = self._learn(texts, at.starts[fresh], at.ends[fresh])
        parts.append((new, ids))
        flat = np.empty(0 if self.lengths_only else int(size.sum()), self.width)
        if not self.lengths_only:
            begin = np.cumsum(size) - size
            for some, ids in parts:
                flat[tx.ragged(begin[some], size[some])] = ids
        for some, ids in parts[1:]:  # the older generation's are carried over
            self.known.put(hashes[some], size[some], ids)
        return at, size, flat, which

    def counts(self, texts: tx.Texts) -> np.ndarray:
        at, size, _, which = self.pieces(texts)
        total = np.concatenate([[0], np.cumsum(size[which])])
        return total[at.first[1:]] - total[at.first[:-1]]

    def ids(self, texts: tx.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and how many each text has."""
        at, size, flat, which = self.pieces(texts)
        begin = np.cumsum(size) - size
        total = np.concatenate([[0], np.cumsum(size[which])])
        return flat[tx.ragged(begin[which], size[which])], total[at.first[1:]] - total[at.first[:-1]]


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, cut, lengths_only: bool) -> PieceEncoder:
    """One encoder for each worker process; a reused worker keeps what it has learned."""
    key = (path, cut.__name__, lengths_only)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, cut, lengths_only)
    return _encoders[key]


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", cut=cut_words, tokens: str = "n_tokens", size: str = "n_bytes", keep: list[str] | None = None) -> DataFrame:
    """Append the UTF-8 length and the token count of every whole text to the columns `keep` (default: all).

    Only lengths come back from Python; there is no shuffle, and each row is
    handled where it lies. Null and empty texts count 0 and 0; repeated rows stay;
    columns that already bear the two output names are replaced. Long texts are cut
    at white space, so that no call of the library gets more than one piece above
    `CALL_BYTES`.
    """
    kept = [x for x in (docs.columns if keep is None else keep) if x not in (tokens, size)]
    schema = T.StructType([docs.schema[x] for x in kept] + [T.StructField(size, T.LongType()), T.StructField(tokens, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, cut, True)
        for batch in batches:
            for part, texts in tx.blocks(batch, text):
                yield tx.with_columns(part.select(kept), **{size: pa.array(np.diff(texts.offsets)), tokens: pa.array(enc.counts(texts))})

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(count, schema)


def count_query(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """Token counts of documents and whether they pass a context window of `limit` tokens."""
    found = token_counts(docs, tokenizer_path, keep=["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
