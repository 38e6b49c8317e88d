"""Operator 4, benchmark decontamination through an FM-index of each training shard.

A shard is a few megabytes of documents within a task. Its words become symbols of
the benchmark's vocabulary; a word that the benchmark lacks, or a pair of
neighbours that no test window has, ends a run, and only runs as long as the
shortest window can hold an occurrence. Over the runs stand a suffix array by
prefix doubling, its Burrows-Wheeler transform in a wavelet matrix, and sampled
suffix positions. All windows are searched backward at once, occurrences located
through the samples, and their spans merged. The windows lie in the shared folder, in
blocks; a task holds one block at a time, and the driver holds the blocks' names alone.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path
from . import text as tx

WINDOW = 13
SHARD_BYTES = 4 << 20
SAMPLE = 4
#: Benchmark text in one block (one item at least). A larger benchmark goes over each batch of documents in as many passes.
BENCHMARK_BYTES = 4 << 20
#: Located rows at a time: a bound on memory where a window is very frequent.
LOCATE_ROWS = 1 << 20


class WaveletMatrix:
    """Rank and access over a sequence of small integers, a bit level at a time."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels: list[tuple[np.ndarray, int]] = []
        for b in reversed(range(bits)):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((ones, len(seq) - int(ones[-1])))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.bits = bits

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros_like(at), at
        for level, (ones, zeros) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        symbol = np.zeros_like(at)
        for ones, zeros in self.levels:
            one = ones[at + 1] - ones[at]
            symbol = symbol * 2 + one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Runs of positive symbols, 1 to `alphabet`, in `text` with a 0 after each."""

    def __init__(self, text: np.ndarray, alphabet: int):
        n, stop = len(text), text == 0
        # Each stop is a symbol of its own, in order, and less than all others: no comparison goes past one.
        rank = np.where(stop, np.cumsum(stop) - 1, text + int(stop.sum()) - 1).astype(np.int64)
        step = 1
        while True:
            key = rank * (n + alphabet + 1)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], key[order[1:]] != key[order[:-1]]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            if step >= n or rank[order[-1]] == n - 1:
                break
            step *= 2
        before = np.where(order > 0, text[order - 1], 0)
        self.size, self.bwt = n, WaveletMatrix(before.astype(np.int64), max(1, int(alphabet).bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        starts = (order == 0) | (before == 0)  # a walk never has to cross a stop
        sampled = starts | (order % SAMPLE == 0)
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo to hi of the suffixes that begin with each pattern (padded rows of symbols), by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            symbol = patterns[live, lengths[live] - back].astype(np.int64)
            lo[live] = self.below[symbol] + self.bwt.rank(symbol, lo[live])
            hi[live] = self.below[symbol] + self.bwt.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row's suffix: walk back to a sampled one."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.sampled[at + 1] > self.sampled[at]
            out[open_[done]] = self.positions[self.sampled[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            symbol = self.bwt.access(at)
            rows[open_] = self.below[symbol] + self.bwt.rank(symbol, at)
            steps += 1
        return out


@dataclass
class Phrases:
    """Distinct test windows as symbols of the benchmark's vocabulary, and the items that have each."""

    vocabulary: np.ndarray  # ascending word hashes; symbol i + 1 is word i
    pairs: np.ndarray  # ascending first * (size + 1) + second of neighbours within a window
    patterns: np.ndarray
    lengths: np.ndarray
    item_first: np.ndarray  # items[item_first[w]:item_first[w + 1]] have window w
    items: np.ndarray
    names: np.ndarray  # of the items, in UTF-8

    @classmethod
    def of(cls, names: list[str], texts: list[str | None], window: int = WINDOW) -> Phrases:
        flat = tx.Texts.of(texts).lowered()
        at = tx.spans(flat, tx.ALNUM)
        vocabulary, symbols = np.unique(tx.span_hashes(flat.data, at.starts, at.ends), return_inverse=True)
        n, size = np.diff(at.first), len(vocabulary) + 1
        count = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        starts = tx.ragged(at.first[:-1], count)
        length = np.repeat(np.minimum(n, window), count).astype(np.int32)
        named, who = np.unique(np.array([x.encode() for x in names], object), return_inverse=True) if names else (np.zeros(0, object), np.zeros(0, np.int64))
        who = np.repeat(who, count)
        padded = np.concatenate([symbols + 1, np.zeros(window, np.int64)]).astype(np.int32)
        code = np.zeros(len(starts), np.uint64)  # equal windows have equal codes
        for i, c in enumerate(tx.constants(window, 31)):
            code += np.where(i < length, padded[starts + i], 0).astype(np.uint64) * c
        order = np.lexsort((who, code))
        starts, length, who = starts[order], length[order], who[order]
        fresh = np.ones(len(starts), bool)
        if len(starts):
            fresh[1:] = length[1:] != length[:-1]
            for i in range(window):  # windows with one code are compared word by word
                x = np.where(i < length, padded[starts + i], 0)
                fresh[1:] |= x[1:] != x[:-1]
        patterns = np.zeros((int(fresh.sum()), window), np.int32)
        lengths = length[fresh].astype(np.int64)
        for i in range(window):
            patterns[:, i] = np.where(i < lengths, padded[starts[fresh] + i], 0)
        one = [np.unique(patterns[:, i].astype(np.int64)[two] * size + patterns[two, i + 1]) for i in range(window - 1) if (two := patterns[:, i + 1] > 0).any()]
        which = np.cumsum(fresh) - 1
        new = np.append(True, (which[1:] != which[:-1]) | (who[1:] != who[:-1]))[: len(which)]
        first = np.searchsorted(which[new], np.arange(len(lengths) + 1))
        return cls(vocabulary, np.unique(np.concatenate([np.zeros(0, np.int64), *one])), patterns, lengths, first, who[new].astype(np.int64), named.astype(bytes))

    def save(self, path: str) -> None:
        out, (where, name) = io.BytesIO(), fs.FileSystem.from_uri(path)
        np.savez(out, **{x.name: getattr(self, x.name) for x in fields(self)})
        where.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with where.open_output_stream(name) as file:
            file.write(out.getbuffer())

    @classmethod
    def load(cls, path: str) -> Phrases:
        where, name = fs.FileSystem.from_uri(path)
        with where.open_input_file(name) as file:
            return cls(**np.load(io.BytesIO(file.read())))


class Blocks:
    """Phrases by the names of their files; the last one that was read is kept, so a single block is read once for each worker."""

    held: tuple[str, Phrases] | None = None

    @classmethod
    def get(cls, path: str) -> Phrases:
        if cls.held is None or cls.held[0] != path:
            cls.held = None
            cls.held = path, Phrases.load(path)
        return cls.held[1]


def _member(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return at, sorted_[at] == x if len(sorted_) else np.zeros(len(x), bool)


def occurrences(words: np.ndarray, first: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (index of the first word) and windows of all occurrences within the texts' words."""
    if not len(phrases.lengths) or not len(words):
        return
    at, there = _member(phrases.vocabulary, words)
    symbol, size = np.where(there, at + 1, 0), len(phrases.vocabulary) + 1
    joined = np.zeros(len(words), bool)  # to the word before
    joined[1:] = (symbol[1:] > 0) & (symbol[:-1] > 0)
    joined[first[first < len(words)]] = False
    near = np.flatnonzero(joined)
    joined[near] = _member(phrases.pairs, symbol[near - 1] * size + symbol[near])[1]
    starts = np.flatnonzero((symbol > 0) & ~joined)
    closes = np.ones(len(words), bool)
    closes[:-1] = ~joined[1:]
    length = np.flatnonzero((symbol > 0) & closes) + 1 - starts
    long = length >= phrases.lengths.min()
    starts, length = starts[long], length[long]
    if not len(starts):
        return
    # The runs, each with a stop behind it, and the word that each symbol is.
    origin = tx.ragged(starts, length + 1)
    text = np.zeros(len(origin), np.int64)
    stops = np.cumsum(length + 1) - 1
    inner = np.ones(len(origin), bool)
    inner[stops] = False
    text[inner] = symbol[origin[inner]]
    index = FMIndex(text, size - 1)
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    hit = np.flatnonzero(hi > lo)
    total = np.cumsum(hi[hit] - lo[hit])
    for part in np.split(hit, np.searchsorted(total, np.arange(LOCATE_ROWS, total[-1] if len(total) else 0, LOCATE_ROWS))):
        for a in range(0, int((hi[part] - lo[part]).sum()), LOCATE_ROWS):
            rows = tx.ragged(lo[part], hi[part] - lo[part])[a : a + LOCATE_ROWS]
            which = np.repeat(part, hi[part] - lo[part])[a : a + LOCATE_ROWS]
            yield origin[index.locate(rows)], which


class Scan:
    """The operator's columns for a shard, gathered block by block."""

    def __init__(self, texts: tx.Texts):
        self.texts = texts
        low = texts.lowered()
        self.at = tx.spans(low, tx.ALNUM)
        self.words = tx.span_hashes(low.data, self.at.starts, self.at.ends)
        self.delta = np.zeros(len(self.words) + 1, np.int32)
        self.items: dict[int, set[str]] = {}

    def add(self, phrases: Phrases) -> None:
        first = self.at.first
        for place, which in occurrences(self.words, first, phrases):
            np.add.at(self.delta, place, 1)
            np.add.at(self.delta, place + phrases.lengths[which], -1)
            doc = np.searchsorted(first, place, side="right") - 1
            pair = np.unique(doc * len(phrases.lengths) + which)
            doc, which = pair // len(phrases.lengths), pair % len(phrases.lengths)
            count = phrases.item_first[which + 1] - phrases.item_first[which]
            pair = np.unique(np.repeat(doc, count) * len(phrases.names) + phrases.items[tx.ragged(phrases.item_first[which], count)])
            for d, i in zip((pair // len(phrases.names)).tolist(), (pair % len(phrases.names)).tolist(), strict=True):
                self.items.setdefault(d, set()).add(phrases.names[i].decode())

    def columns(self) -> dict[str, pa.Array]:
        at, texts = self.at, self.texts
        hit = np.cumsum(self.delta[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[at.first[1:]] - total[at.first[:-1]]
        spans: list[list[dict]] = [[] for _ in range(len(texts))]
        for d in np.flatnonzero(n_hit).tolist():
            a, b = int(at.first[d]), int(at.first[d + 1])
            edge = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
            base = int(texts.offsets[d])
            lead = np.concatenate([[0], np.cumsum((texts.data[base : texts.offsets[d + 1]] & 0xC0) != 0x80)])
            spans[d] = [{"start": int(lead[at.starts[a + s] - base]), "end": int(lead[at.ends[a + e - 1] - base])} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
        items = [sorted(self.items.get(d, ())) for d in range(len(texts))]
        return {"n_words": pa.array(np.diff(at.first), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, _SPANS)}


_COLUMNS = {
    "n_words": T.LongType(),
    "n_hit": T.LongType(),
    "items": T.ArrayType(T.StringType()),
    "spans": T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
}
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def benchmark_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, limit: int = BENCHMARK_BYTES) -> list[str]:
    """Write the benchmark's windows to the shared folder, in blocks of at most `limit` bytes of text (one item at least); the files' names.

    Tasks make the blocks; a task that is run again leaves files that nobody names.
    """
    folder = fresh_path(benchmark.sparkSession, "windows")
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, bytes_, files = [], [], 0, []

        def close() -> None:
            files.append(f"{folder}/{uuid.uuid4().hex}.npz")
            Phrases.of(names, texts, window).save(files[-1])
            names.clear()
            texts.clear()

        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = len(x.encode())
                if names and bytes_ + own > limit:
                    close()
                    bytes_ = 0
                names.append(name)
                texts.append(x)
                bytes_ += own
        if names:
            close()
        yield pa.RecordBatch.from_pydict({"file": pa.array(files, pa.string())})

    return [r.file for r in rows.repartition(max(1, -(-size // limit))).mapInArrow(build, "file string").collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, keep: list[str] | None = None, limit: int = BENCHMARK_BYTES) -> DataFrame:
    """Append n_words, n_hit, items and merged removal spans (code points) to the columns `keep` (default: all).

    A test window is `window` consecutive words of an item, or all words of a
    shorter item; a word inside any occurrence is hit. There is no shuffle of documents:
    each task indexes its own rows. A benchmark over `BENCHMARK_BYTES` is several blocks in
    the shared folder; every shard searches all of them, one after the other. Null and empty texts
    have no words and no hits; items without words match nothing; a null item id is
    named `null`; repeated rows stay; columns named as the appended ones are replaced.
    """
    kept = [x for x in (docs.columns if keep is None else keep) if x not in _COLUMNS]
    schema = T.StructType([docs.schema[x] for x in kept] + [T.StructField(k, v) for k, v in _COLUMNS.items()])
    files = benchmark_blocks(benchmark, window=window, limit=limit)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in tx.blocks(batch, text, SHARD_BYTES):
                scan = Scan(texts)
                for file in files:
                    scan.add(Blocks.get(file))
                yield tx.with_columns(part.select(kept), **scan.columns())

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(find, schema)


#: The contract's rule: a document is contaminated where hit words are 5 % of its words or more.
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns and the removal spans for every row; null and empty texts have no words and are clean."""
    found = find_contamination(docs, benchmark, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever these are named."""
    return find_contamination(tx.packed(docs), benchmark, keep=["own"]).filter(~F.expr(CONTAMINATED)).select("own.*")
