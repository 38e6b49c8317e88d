"""Inverted indexes as tables of posting blocks, and a top-k search that leaves blocks out.

Building. Each task inverts the texts that it reads, a bounded number of terms at a time; what
is inverted together is a segment. A segment's units are numbered in order of length,
then of id, so that units in a block are alike. A block has up to `BLOCK` postings of
one term in one segment and a bound on what any of them can score. Blocks are dealt into files
by ranges of (term, segment), so a frequent term takes several files and no task is given
all of it; `terms` knows for each term its document frequency and its files.

Searching. Only files of the queries' terms are opened. Their blocks meet the queries, which
pass by as a stream of rows, in as many parts as postings need. The k-th best score so far is
a threshold. Where queries are few, terms are scored one after the other, in order of what they can
add at most: a block that cannot lift a unit to the threshold is left out, and once the terms that are left
cannot do so alone, only blocks that hold one of the units in question are scored. Many queries are
compared at once with tiles of units: of those that a tile's bounds leave, terms that many of them share are
a product of matrices, other terms are added posting by posting, and what comes near the
threshold in single precision is scored exactly. A large search runs in two waves:
thresholds of a few parts leave out blocks of all others before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..session import broadcast_if_small, materialise, shuffle_partitions

#: Term occurrences in a segment, at most, or those of one text; postings in a block, at most.
SEGMENT_TERMS, BLOCK = 4 << 20, 128
#: Blocks of one term or more that are scored at once.
GROUP = 32
#: Queries that are compared with tiles at once, and those that are too few for it; units of a tile; additions in a product of matrices that take as long as one by place.
QUERIES, FEW, TILE, PRODUCTS = 2048, 8, 1024, 500
#: Pairs of a hit and a term that are scored exactly at once.
PAIRS = 1 << 20
#: Postings that a task of a search holds, about, and where all are few; a search of so many tasks runs in two waves, or three.
PART_POSTINGS, LEAST_POSTINGS, TWO_WAVES, THREE_WAVES = 4 << 20, 64 << 10, 16, 128
#: Terms of all queries that are broadcast to the blocks, at most.
BROADCAST_TERMS = 1_000_000
#: What rounding of scores may hide.
SPARE = 2e-9

#: Cells of queries and units that are summed at once; a term is kept as a row of numbers where at least one in so many units of its segment has it; ranges of a segment's units that have bounds of their own.
CELLS, DENSE, RANGES = 1 << 20, 12, 32
#: All units are summed for a query of whose terms more postings than one in so many units are to be read; postings of a term that make a first threshold, for each unit that is asked for.
WHOLE, SEEDS = 4, 3
#: Segments of vectors that a task searches one after another, and whose vocabularies it reads together, at most; units and postings that are compared with queries at once.
TOGETHER, VOCABULARIES, UNITS, HELD = 16, 32, 16384, 4 << 20
#: Units of a range that has bounds of its own; groups of like units; terms that tell them apart; a term is a row of numbers where at least one in so many units has it.
WIDE, GROUPS, TRAITS, OFTEN = 64, 8, 256, 12
_WHOLE = "segment long, blocks binary, data binary, units array<string>, texts int, n_terms long, n_stop long"
_BLOCKS = "segment long, term string, at int, n int, most_tf int, least_dl int, least_kept int, data binary"
_SEGMENT = "segment long, term string, at int, n int, most_tf int, least_dl int, least_kept int, data binary, units array<string>, texts int, n_terms long, n_stop long"
#: Records of `data`, one for each posting: a unit's number, less that of the block's posting before it, and how often it has the term, or what it adds for a weight of 1.
COUNTED = np.dtype([("doc", "<i4"), ("tf", "<i4")])
WEIGHED = np.dtype([("doc", "<i4"), ("impact", "<f8")])
#: `data` of a segment's own row: terms of each unit, and stop words among them.
LENGTHS = np.dtype([("dl", "<i4"), ("stop", "<i4")])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ..., counts[i] numbers, for each i in turn."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1]) if len(ends) else np.zeros(0, np.int64)


def packed(records: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Records as binary values that begin at `starts`."""
    offsets = (np.append(starts, len(records)) * records.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(records)])


def unpacked(data: pa.Array, kind: np.dtype) -> np.ndarray:
    """The records of all values, one behind the other."""
    if not len(data):
        return np.zeros(0, kind)
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind) if offsets[-1] > offsets[0] else np.zeros(0, kind)


def steps(docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers as steps from one to the next; each block begins with its number."""
    out = np.diff(docs, prepend=0)
    out[starts] = docs[starts]
    return out


def numbers(steps_: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The inverse of `steps`."""
    total = np.cumsum(steps_, dtype=np.int64)
    return total - np.repeat(total[starts] - steps_[starts], counts)


def numbered(ids: pa.Array, length: np.ndarray) -> np.ndarray:
    """Texts in order of length, then of id."""
    return np.lexsort((pc.rank(ids).to_numpy(), length)) if len(ids) else np.zeros(0, np.int64)


def places(order: np.ndarray) -> np.ndarray:
    """The place of each text in the order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def segment(name: int, ids: pa.Array, order: np.ndarray, length: np.ndarray, stop: np.ndarray | None, known: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, vocabulary: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of one segment: its blocks, and one row with its units.

    length, stop, known: for each text its terms, stop words among them (None: there are none), and
    whether it is no null; term, doc, tf: postings in order, by places in the vocabulary and in `order`.
    """
    length, stop = length[order], np.zeros(len(order), np.int64) if stop is None else stop[order]
    at = np.arange(len(term))
    fresh = np.append(True, term[1:] != term[:-1])[: len(term)]
    within = at - np.maximum.accumulate(np.where(fresh, at, 0)) if len(term) else at
    starts = np.flatnonzero(within % BLOCK == 0)
    records, lengths = np.empty(len(term), COUNTED), np.empty(len(order), LENGTHS)
    records["doc"], records["tf"], lengths["dl"], lengths["stop"] = steps(doc, starts), tf, length, stop
    n = len(starts)
    least = lambda x: pa.array(np.minimum.reduceat(x, starts).astype(np.int32) if n else np.zeros(0, np.int32))
    blocks = {
        "segment": pa.array(np.full(n, name)),
        "term": vocabulary.take(pa.array(term[starts])).cast(pa.string()),
        "at": pa.array((within[starts] // BLOCK).astype(np.int32)),
        "n": pa.array(np.diff(np.append(starts, len(term))).astype(np.int32)),
        "most_tf": pa.array(-np.minimum.reduceat(-tf, starts).astype(np.int32) if n else np.zeros(0, np.int32)),
        "least_dl": least(length[doc]),
        "least_kept": least((length - stop)[doc]),
        "data": packed(records, starts),
    }
    units = {"segment": pa.array([name]), "data": packed(lengths, np.zeros(1, np.int64)), "units": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order))), "texts": pa.array([int(known.sum())], pa.int32()), "n_terms": pa.array([int(length.sum())]), "n_stop": pa.array([int(stop.sum())])}
    kinds = {"segment": pa.int64(), "term": pa.string(), "data": pa.binary(), "units": pa.list_(pa.string()), "n_terms": pa.int64(), "n_stop": pa.int64()}
    names = [x.split()[0] for x in _SEGMENT.split(", ")]
    for found, rows in ((blocks, n), (units, 1)):
        yield pa.RecordBatch.from_arrays([found[x] if x in found else pa.nulls(rows, kinds.get(x, pa.int32())) for x in names], names=names)


def in_segments(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], np.ndarray], make: Callable[[int, pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Gather rows until their sizes pass `SEGMENT_TERMS`, and make a segment of them."""
    name, held, total = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        ends, at = np.cumsum(size(batch)), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, before + SEGMENT_TERMS - total, side="right")), at if held else at + 1)
            held.append(batch.slice(at, to - at))
            total += int(ends[to - 1]) - before if to > at else 0
            if to < batch.num_rows:
                yield from make(name, pa.Table.from_batches(held).combine_chunks())
                name, held, total = name + 1, [], 0
            at = to
    if held:
        yield from make(name, pa.Table.from_batches(held).combine_chunks())


def _of_terms(name: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """rows: unit_id, terms, stop."""
    terms, ids = rows["terms"].combine_chunks(), rows["unit_id"].combine_chunks()
    length = pc.fill_null(pc.list_value_length(terms), 0).to_numpy().astype(np.int64)
    found, order = terms.flatten().dictionary_encode(), numbered(ids, length)
    owner, texts = np.repeat(places(order), length), max(len(order), 1)
    key, tf = np.unique(found.indices.to_numpy().astype(np.int64) * texts + owner, return_counts=True)
    yield from segment(name, ids, order, length, pc.fill_null(rows["stop"], 0).to_numpy().astype(np.int64), terms.is_valid().to_numpy(zero_copy_only=False), key // texts, key % texts, tf, found.dictionary)


def grams_of(texts: list[str], order: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Postings of every substring of `low` to `high` code points: gram, text's place in `order` and count, in order; and the grams."""
    size = np.array([len(x) for x in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.zeros(0x110000, np.int64)
    place[points] = 1
    letters = np.flatnonzero(place).astype(np.uint32)
    place[letters] = np.arange(len(letters))
    letter = place[points]
    begin, owner_of, many = np.cumsum(size) - size, np.repeat(places(order), size), max(len(texts), 1)
    left = np.repeat(begin + size, size) - np.arange(len(points))  # code points from here to the end of the text
    parts, words = [], []
    for n in range(low, high + 1):
        at = np.flatnonzero(left >= n)
        if not len(at):
            continue
        if (len(letters) ** n) * many < 1 << 63:  # a gram is a number in base `letters`, and sorts together with its text
            code = np.zeros(len(at), np.int64)
            for i in range(n):
                code = code * len(letters) + letter[at + i]
            key, tf = np.unique(code * many + owner_of[at], return_counts=True)
            code, doc = np.divmod(key, many)
            fresh = np.append(True, code[1:] != code[:-1])
            first, found = code[fresh], []
            for _ in range(n):
                first, last = np.divmod(first, len(letters))
                found.append(last)
            grams = letters[np.stack(found[::-1], axis=1)]
        else:
            rows, tf = np.unique(np.column_stack([*(letter[at + i] for i in range(n)), owner_of[at]]), axis=0, return_counts=True)
            fresh, doc = np.append(True, (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)), rows[:, -1]
            grams = letters[rows[fresh, :-1]]
        raw = np.ascontiguousarray(grams).tobytes().decode("utf-32-le", "surrogatepass")
        parts.append((np.cumsum(fresh) - 1 + len(words), doc, tf))
        words += [raw[i : i + n] for i in range(0, len(raw), n)]
    none = np.zeros(0, np.int64)
    return *(np.concatenate([none, *(x[i] for x in parts)]) for i in range(3)), pa.array(words, pa.string())


def whole(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each segment, its blocks in one value."""
    for blocks in made:
        units, sink, given = next(made), pa.BufferOutputStream(), unpacked(blocks["data"], COUNTED)
        # Steps and counts each in the narrowest type that holds them: interleaved records take several times the disk.
        narrow = {x: pa.array(given[x].astype(np.min_scalar_type(int(given[x].max(initial=0))))) for x in ("doc", "tf")}
        for part in (blocks.drop_columns(["segment", "data"]), pa.RecordBatch.from_pydict(narrow)):
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
        own = {x: units[x] for x in ("segment", "data", "units", "texts", "n_terms", "n_stop")} | {"blocks": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
        names = [x.split()[0] for x in _WHOLE.split(", ")]
        yield pa.RecordBatch.from_arrays([own[x] for x in names], names=names)


def stored(path: str, columns: list[str]) -> pa.Table:
    """Columns of a file in the shared folder."""
    where, name = fs.FileSystem.from_uri(path)
    with where.open_input_file(name) as file:
        return pq.ParquetFile(file).read(columns)


def blocks_in(value: pa.Scalar, name: int | None = None) -> pa.RecordBatch:
    """Blocks of a segment; name: with their postings and the segment's number."""
    source = pa.BufferReader(value.as_buffer())
    blocks = pa.ipc.open_stream(source).read_all().combine_chunks().to_batches()
    if not blocks:
        return pa.RecordBatch.from_pylist([], pa.schema([("term", pa.string()), ("at", pa.int32()), ("n", pa.int32()), ("most_tf", pa.int32()), ("least_dl", pa.int32()), ("least_kept", pa.int32()), ("segment", pa.int64()), ("data", pa.binary())]))
    if name is None:
        return blocks[0]
    given, n = pa.ipc.open_stream(source).read_all(), blocks[0]["n"].to_numpy().astype(np.int64)
    records = np.empty(given.num_rows, COUNTED)
    records["doc"], records["tf"] = given["doc"].to_numpy(), given["tf"].to_numpy()
    return blocks[0].append_column("segment", pa.array(np.full(len(n), name))).append_column("data", packed(records, np.cumsum(n) - n))


def vocabulary(blocks: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms of a segment, where the blocks of each begin, and its postings."""
    first = np.flatnonzero(blocks["at"].to_numpy() == 0)
    return blocks["term"].take(pa.array(first)), first, np.add.reduceat(blocks["n"].to_numpy().astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def vocabularies(paths: list[str]) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """Distinct terms of some segments; of all terms of one segment after the other, their places among these; and of each segment, its terms' postings."""
    found = [vocabulary(blocks_in(stored(path, ["blocks"])["blocks"][0])) for path in paths]
    own = pa.concat_arrays([pa.array([], pa.string()), *(x[0] for x in found)]).dictionary_encode()
    return own.dictionary, own.indices.to_numpy(), [x[2] for x in found]


class PostingsIndex:
    """whole: a row for each segment in a file of its own (segment, blocks, data, units, texts, n_terms, n_stop).

    Made when first asked for: postings: blocks in files by term; terms: (term, df, first, last), with the term's files; files: their paths.
    """

    def __init__(self, segments: DataFrame, norms: DataFrame | None = None):
        self.segments, self.norms = segments, norms
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        self.totals = tuple(segments.agg(total(F.size("units").cast("long")), total("texts"), total("n_terms"), total("n_stop")).first())  # units, texts, terms, stop words

    @property
    def units(self) -> DataFrame:
        return self.segments.select(F.explode("units").alias("unit_id"))

    def ids(self) -> DataFrame:
        """(segment, doc, unit_id)"""
        return self.segments.select("segment", F.posexplode("units").alias("doc", "unit_id"))

    def mean_length(self, without_stop: bool) -> float:
        _, texts, terms, stop = self.totals
        return (terms - (stop if without_stop else 0)) / texts if texts else 0.0

    @cached_property
    def places(self) -> DataFrame:
        """(at, path, norms): the file of each segment, in turn, and that of its units' lengths as vectors."""
        where = lambda df, name: df.select("segment", F.col("_metadata.file_path").alias(name))
        found = where(self.segments, "path")
        found = found.withColumn("norms", F.lit(None).cast("string")) if self.norms is None else found.join(where(self.norms, "norms"), "segment")
        # The first segments of all tasks come first, so that a few of them are of any part of the table.
        return materialise(found.select((F.row_number().over(Window.orderBy(F.xxhash64("segment"))) - 1).alias("at"), "path", "norms"), "places")

    def each(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, first: int = 0, last: int | None = None, most: int = 1) -> DataFrame:
        """A task for each segment from `first` to `last`, or for up to `most` where there are more than cores: run over their rows of `places`."""
        n = self.places.count() if last is None else last
        tasks = n - first
        if most > 1:
            cores = max(self.segments.sparkSession.sparkContext.defaultParallelism, 1)
            tasks = max(-(-tasks // most), min(tasks, 2 * cores))
        tasks = max(tasks, 1)
        some = self.places.filter((F.col("at") >= first) & (F.col("at") < n)).withColumn("at", F.pmod(F.col("at") - first, F.lit(tasks)).cast("int"))
        return some.repartitionById(tasks, "at").mapInArrow(run, schema)

    def counted(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df), of the terms of a table alone where one is given."""
        asked = None if terms is None else materialise(terms.select("term").distinct(), "asked").inputFiles()

        def some_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch["path"].to_pylist():
                    found, _, n = vocabulary(blocks_in(stored(path, ["blocks"])["blocks"][0]))
                    for file in asked:
                        some = pc.index_in(found, stored(file, ["term"])["term"].combine_chunks()).is_valid()
                        yield pa.RecordBatch.from_arrays([found.filter(some), pa.array(n).filter(some)], names=["term", "n"])

        def all_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, number, counts = vocabularies([path for batch in batches for path in batch["path"].to_pylist()])
            n = np.bincount(number, np.concatenate([np.zeros(0), *counts]), len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([found, pa.array(n)], names=["term", "n"])

        made = self.each(some_terms, "term string, n long") if terms is not None else self.each(all_terms, "term string, n long", most=VOCABULARIES)
        return made.groupBy("term").agg(F.sum("n").alias("df"))

    @cached_property
    def postings(self) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch["path"].to_pylist():
                    row = stored(path, ["segment", "blocks"])
                    yield blocks_in(row["blocks"][0], row["segment"][0].as_py()).select([x.split()[0] for x in _BLOCKS.split(", ")])

        return materialise(self.each(run, _BLOCKS).repartitionByRange(shuffle_partitions(self.segments.sparkSession), "term", "segment").sortWithinPartitions("term", "segment", "at"), "postings")

    @cached_property
    def files(self) -> list[str]:
        return sorted(self.postings.inputFiles())

    @cached_property
    def terms(self) -> DataFrame:
        # Names alone are compared: paths are written in more ways than one. A term's files follow one another.
        names = F.lit([f.rsplit("/", 1)[-1] for f in self.files]).cast("array<string>")
        place = F.array_position(names, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).cast("int") - 1
        return materialise(self.postings.select("term", "n", place.alias("file")).groupBy("term").agg(F.sum("n").alias("df"), F.min("file").alias("first"), F.max("file").alias("last")), "terms")

    def of(self, files: list[int]) -> DataFrame:
        """Blocks in some of the files: others are not opened."""
        if not files:
            return self.postings.limit(0)
        return self.postings.sparkSession.read.schema(self.postings.schema).parquet(*[self.files[i] for i in files])


def inverted(tokenised: DataFrame) -> DataFrame:
    """Segments of rows (unit_id, terms, stop), made where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole(in_segments(batches, lambda b: pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64), _of_terms))

    return tokenised.select(F.col("unit_id").cast("string").alias("unit_id"), "terms", F.col("stop").cast("int").alias("stop")).mapInArrow(run, _WHOLE)


def inverted_grams(texts: DataFrame, low: int, high: int) -> DataFrame:
    """Segments of character n-grams of rows (unit_id, text): `dl` is the text's length."""

    def make(name: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        column = rows["text"].combine_chunks()
        given = [x or "" for x in column.to_pylist()]
        length, ids = np.array([len(x) for x in given], np.int64), rows["unit_id"].combine_chunks()
        order = numbered(ids, length)
        yield from segment(name, ids, order, length, None, column.is_valid().to_numpy(zero_copy_only=False), *grams_of(given, order, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole(in_segments(batches, lambda b: (high - low + 1) * pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64), make))

    return texts.select(F.col("unit_id").cast("string").alias("unit_id"), "text").mapInArrow(run, _WHOLE)


def indexed(made: DataFrame) -> PostingsIndex:
    """The index of segments as `inverted` makes them."""
    return PostingsIndex(materialise(made, "segments", 1))


@dataclass
class Blocks:
    """Blocks of one part, sorted by segment, term and first unit; `impact` is what a posting adds for a weight of 1."""

    docs: np.ndarray
    impact: np.ndarray
    dl: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    rows: dict[int, dict[str, tuple[int, int]]]
    scored: int = 0
    skipped: int = 0

    def __post_init__(self):
        ends = self.starts + self.counts - 1
        self.first, self.last = (self.docs[x] if len(x) else np.zeros(0, np.int64) for x in (self.starts, ends))
        self.bound = np.maximum.reduceat(self.impact, self.starts) if len(self.starts) else np.zeros(0)
        self.most = {s: {t: float(self.bound[lo:hi].max()) for t, (lo, hi) in of.items()} for s, of in self.rows.items()}

    @classmethod
    def of(cls, parts: list[pa.RecordBatch], kind: np.dtype, impact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Blocks:
        """parts: segment, term, n, data, a segment's own row first; impact: what postings add for a weight of 1, from their records and their units' lengths."""
        lengths: dict[int, np.ndarray] = {}
        rows: dict[int, dict[str, tuple[int, int]]] = {}
        counts, records, of_unit, at = [], [], [], 0
        for x in parts:
            own = x.column(1).is_null()
            for r in x.filter(own).select([0, 3]).to_pylist():
                lengths[r["segment"]] = np.frombuffer(r["data"], LENGTHS)
            x = x.filter(pc.invert(own))
            if not x.num_rows:
                continue
            segments, n = x.column(0).to_numpy(), x.column(2).to_numpy().astype(np.int64)
            for i, (s, t) in enumerate(zip(segments.tolist(), x.column(1).to_pylist(), strict=True), at):
                of = rows.setdefault(s, {})
                of[t] = (of[t][0] if t in of else i, i + 1)
            at += x.num_rows
            found = unpacked(x.column(3), kind).copy()
            found["doc"] = numbers(found["doc"], np.cumsum(n) - n, n)
            counts.append(n)
            records.append(found)
            first = np.append(0, np.flatnonzero(np.diff(segments)) + 1)
            ends = np.append(np.cumsum(n), 0)[np.append(first[1:], len(n)) - 1]
            cuts = np.split(found["doc"], ends[:-1])
            of_unit += [lengths[s][docs] for s, docs in zip(segments[first].tolist(), cuts, strict=True)]
        if not at:
            return cls(*(np.zeros(0, np.int64) for _ in range(5)), {})
        n, found, units = np.concatenate(counts), np.concatenate(records), np.concatenate(of_unit)
        return cls(found["doc"].astype(np.int64), impact(found, units), units["dl"], np.cumsum(n) - n, n, rows)

    def best(self, query: list[tuple[str, float]], k: int, threshold: float, final: Callable[[np.ndarray], np.ndarray], spare: float, unit_length: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(segment, doc, sum, final score) of the k best units above 0; equal scores of one segment by length, then number.

        Of units that are equal at the last place all are given, up to k of each length. unit_length:
        impacts of a unit are a vector of length 1, so what they can add is bounded by its rest as well.
        """
        out: list[tuple[np.ndarray, ...]] = []
        sums = np.zeros(0)
        for s, of in self.rows.items():
            most = self.most[s]
            terms = sorted(((w * most[t], w, *of[t]) for t, w in query if t in of and w > 0), reverse=True)
            if not terms:
                continue
            doc, value, size = self._segment(terms, k, threshold, spare, unit_length)
            shown = final(value)
            order = np.lexsort((doc, -shown))
            if len(order) > k:
                tied = shown[order] == shown[order[k - 1]]
                run = np.arange(len(order))
                fresh = np.append(True, (size[order][1:] != size[order][:-1]) | (tied[1:] != tied[:-1]))
                within = run - np.maximum.accumulate(np.where(fresh, run, 0))
                order = order[(shown[order] > shown[order[k - 1]]) | (tied & (within < k))]
            out.append((np.full(len(order), s), doc[order], value[order], shown[order]))
            sums = np.concatenate([sums, value[order]])
            if len(sums) >= k:
                threshold = max(threshold, float(np.partition(sums, len(sums) - k)[len(sums) - k]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        segment_, doc, value, shown = (np.concatenate(x) for x in zip(*out, strict=True))
        some = value >= threshold - spare
        return segment_[some], doc[some], value[some], shown[some]

    def _segment(self, terms: list[tuple[float, float, int, int]], k: int, threshold: float, spare: float, unit_length: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the units that may be among the best k. Terms (most that it adds, weight, first row, last) are scored one by one, or together where they have few blocks."""
        most, weight, lo, hi = (np.array(x) for x in zip(*terms, strict=True))
        n = int(self.last[np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])].max()) + 1
        sums, dl, squares = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
        # What terms from the i-th on can add: by their bounds, and where impacts are vectors of length 1, by their weights' length.
        left = np.append(np.cumsum(most[::-1])[::-1], 0.0)
        length = np.append(np.sqrt(np.cumsum((weight**2)[::-1])[::-1]), 0.0) if unit_length else np.full(len(most) + 1, np.inf)
        at, blocks = 0, np.cumsum(hi - lo)
        while at < len(most):
            to = max(at + 1, int(np.searchsorted(blocks, (blocks[at - 1] if at else 0) + GROUP, side="right")))
            least, before = threshold - spare, min(left[at], length[at])
            many = hi[at:to] - lo[at:to]
            rows, of = ragged(lo[at:to], many), np.repeat(np.arange(at, to), many)
            bound = weight[of] * self.bound[rows]
            if before >= least:  # units that no term has met yet may still come in
                others = left[0] - most
                if unit_length:
                    others = np.minimum(others, np.sqrt(np.maximum(length[0] ** 2 - weight**2, 0.0)))
                keep = bound + others[of] >= least
            else:
                reach = sums + (np.minimum(before, length[at] * np.sqrt(np.maximum(1 - squares, 0.0)) + SPARE) if unit_length else before)
                units = np.flatnonzero((sums > 0) & (reach >= least))
                a, b = np.searchsorted(units, self.first[rows]), np.searchsorted(units, self.last[rows], side="right")
                keep = b > a
                if keep.any():
                    best = np.maximum.reduceat(np.append(sums[units], 0.0), np.ravel(np.column_stack([a[keep], b[keep]])))[0::2]
                    keep[keep] = best + np.minimum(bound[keep] + left[at] - most[of[keep]], length[at]) >= least
            self.scored += int(np.count_nonzero(keep))
            self.skipped += int(np.count_nonzero(~keep))
            rows, of = rows[keep], of[keep]
            some = ragged(self.starts[rows], self.counts[rows])
            d, impact = self.docs[some], self.impact[some]
            sums += np.bincount(d, np.repeat(weight[of], self.counts[rows]) * impact, n)
            dl[d] = self.dl[some]
            if unit_length:
                squares += np.bincount(d, impact**2, n)
            if n >= k and len(some):
                threshold = max(threshold, float(np.partition(sums, n - k)[n - k]))
            at = to
        found = np.flatnonzero((np.round(sums, scoring.PLACES) > 0) & (sums >= threshold - spare))
        return found, sums[found], dl[found]


def foremost(query: np.ndarray, segment_: np.ndarray, doc: np.ndarray, size: np.ndarray, shown: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each query's best k in order of query and score, and their ranks; of those that are equal at the last place up to k of a segment and length."""
    order = np.lexsort((doc, segment_, -shown, query))
    q, s = query[order], shown[order]
    at = np.arange(len(order))
    first = np.append(True, q[1:] != q[:-1])[: len(q)]
    begin = np.maximum.accumulate(np.where(first, at, 0)) if len(q) else at
    last = np.minimum(begin + k - 1, np.append(np.flatnonzero(first)[1:], len(q))[np.cumsum(first) - 1] - 1)
    tied = s == s[last]
    fresh = first | np.append(True, (tied[1:] != tied[:-1]) | (segment_[order][1:] != segment_[order][:-1]) | (size[order][1:] != size[order][:-1]))[: len(q)]
    within = at - np.maximum.accumulate(np.where(fresh, at, 0)) if len(q) else at
    keep = (s > s[last]) | (tied & (within < k))
    return order[keep], (at - begin)[keep]


@dataclass
class Tiles:
    """Postings of one part in order of (tile, term, unit); a tile is up to `TILE` units of a segment, a run is what a tile has of a term."""

    terms: pa.Array
    key: np.ndarray  # (tile * terms + term) * TILE + unit
    impact: np.ndarray
    dl: np.ndarray
    segments: np.ndarray  # of each tile: its segment and its first unit
    first: np.ndarray

    @classmethod
    def of(cls, blocks: Blocks) -> Tiles:
        number = {t: i for i, t in enumerate(sorted({t for of in blocks.rows.values() for t in of}))}
        term, base = np.zeros(len(blocks.starts), np.int64), np.zeros(len(blocks.starts), np.int64)
        segments, first, at = [], [], 0
        for s, of in blocks.rows.items():
            for t, (lo, hi) in of.items():
                term[lo:hi], base[lo:hi] = number[t], at
            tiles = int(max(blocks.last[hi - 1] for _, hi in of.values())) // TILE + 1
            segments += [s] * tiles
            first += range(0, tiles * TILE, TILE)
            at += tiles
        key = blocks.docs // TILE
        key += np.repeat(base, blocks.counts)
        key *= max(len(number), 1)
        key += np.repeat(term, blocks.counts)
        key *= TILE
        key += blocks.docs % TILE
        order = np.argsort(key, kind="stable")
        return cls(pa.array(list(number), pa.string()), key[order], blocks.impact[order], blocks.dl[order].astype(np.int32), np.array(segments, np.int64), np.array(first, np.int64))

    def __post_init__(self):
        run = self.key // TILE
        self.starts = np.flatnonzero(np.append(True, run[1:] != run[:-1])[: len(run)])
        self.runs = run[self.starts]
        self.counts = np.diff(np.append(self.starts, len(run)))
        self.most = np.maximum.reduceat(self.impact, self.starts) if len(run) else np.zeros(0)
        self.ends = np.searchsorted(self.runs, np.arange(len(self.segments) + 1) * max(len(self.terms), 1))
        self.highest = np.zeros(len(self.terms))  # what a term adds at most for a weight of 1
        np.maximum.at(self.highest, self.runs % max(len(self.terms), 1), self.most)
        self.compared = self.skipped = 0

    def best(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, threshold: np.ndarray, final: Callable[[np.ndarray, np.ndarray], np.ndarray], spare: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, segment, doc, sum, final score) of each query's k best units above 0, more where they are equal, as `Blocks.best` has them.

        query, term, weight: the queries' terms that occur here, once for each query, in order of queries; threshold, spare: of each query;
        final: of sums and their queries.
        """
        n, threshold = len(threshold), threshold.copy()
        tops = np.zeros((n, k))
        out: list[tuple[np.ndarray, ...]] = []
        for tile, (lo, hi) in enumerate(zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True)):
            if lo == hi:
                continue
            names = self.runs[lo:hi] - tile * len(self.terms)
            at = np.minimum(np.searchsorted(names, term), hi - lo - 1)
            has = np.flatnonzero(names[at] == term)
            at, q, w = at[has], query[has], weight[has]
            most = np.bincount(q, w * self.most[lo + at], n)
            active = (most > 0) & (most >= threshold - spare)
            self.compared += int(np.count_nonzero(active))
            self.skipped += n - int(np.count_nonzero(active))
            rows = np.flatnonzero(active)
            if not len(rows):
                continue
            some = active[q]
            at, q, w = at[some], q[some], w[some]
            begin, end = int(self.starts[lo]), int(self.starts[hi - 1] + self.counts[hi - 1])
            unit = self.key[begin:end] % TILE
            row = (np.cumsum(active) - 1)[q]
            near = self._near(at, row, w, len(rows), self.starts[lo:hi] - begin, self.counts[lo:hi], unit, self.impact[begin:end])
            many = np.bincount(row, minlength=len(rows))
            error = (many + 4) * 1.2e-7 * most[rows]
            floor = np.maximum(threshold[rows] - spare[rows] - error, 1e-37).astype(np.float32)
            hot = np.flatnonzero(near.max(axis=1) >= floor)
            if not len(hot):
                continue
            near, floor = near[hot] if len(hot) < len(rows) else near, floor[hot]
            full = np.flatnonzero(np.count_nonzero(near >= floor[:, None], axis=1) > 2 * k)
            if len(full) and near.shape[1] > k:
                kth = np.partition(near[full], near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                floor[full] = np.maximum(floor[full], kth - 2 * error[hot[full]] - spare[rows[hot[full]]])
            hit, doc = np.nonzero(near >= floor[:, None])
            hit = hot[hit]
            value, size = self._exact(hit, doc, np.append(0, np.cumsum(many)), self.runs[lo + at], w, self.key[begin:end], self.impact[begin:end], self.dl[begin:end])
            of = rows[hit]
            good = (np.round(value, scoring.PLACES) > 0) & (value >= threshold[of] - spare[of])
            of, doc, value, size = of[good], doc[good], value[good], size[good]
            shown = final(value, of)
            chosen, rank = foremost(of, np.zeros(len(of), np.int64), doc, size, shown, k)
            of, doc, value, size, shown = of[chosen], doc[chosen], value[chosen], size[chosen], shown[chosen]
            out.append((of, np.full(len(of), self.segments[tile]), doc + self.first[tile], size, value, shown))
            met = np.unique(of)
            new = np.zeros((len(met), k))
            first = rank < k
            new[np.searchsorted(met, of[first]), rank[first]] = value[first]
            tops[met] = np.partition(np.concatenate([tops[met], new], axis=1), k, axis=1)[:, k:]
            threshold[met] = np.maximum(threshold[met], tops[met].min(axis=1))
        if not out:
            return *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0), np.zeros(0)
        of, segment_, doc, size, value, shown = (np.concatenate(x) for x in zip(*out, strict=True))
        good = value >= threshold[of] - spare[of]
        of, segment_, doc, size, value, shown = (x[good] for x in (of, segment_, doc, size, value, shown))
        chosen, _ = foremost(of, segment_, doc, size, shown, k)
        return of[chosen], segment_[chosen], doc[chosen], value[chosen], shown[chosen]

    @staticmethod
    def _near(at: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, starts: np.ndarray, counts: np.ndarray, unit: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Sums of a tile's units for each of n queries, in single precision. at, row, weight: a run of the tile, for a query, and its weight."""
        wide = int(unit.max()) + 1
        dense = np.bincount(at, minlength=len(counts)) * counts * PRODUCTS > n * wide
        shared = np.flatnonzero(dense)
        if len(shared):
            some = ragged(starts[shared], counts[shared])
            left, right = np.zeros((n, len(shared)), np.float32), np.zeros((len(shared), wide), np.float32)
            right[np.repeat(np.arange(len(shared)), counts[shared]), unit[some]] = impact[some]
            of = dense[at]
            left[row[of], (np.cumsum(dense) - 1)[at[of]]] = weight[of]
            near = left @ right
            at, row, weight = at[~of], row[~of], weight[~of]
        else:
            near = np.zeros((n, wide), np.float32)
        if len(at):
            flat, place = near.reshape(-1), np.arange(len(at))
            fresh = np.append(True, row[1:] != row[:-1])
            turn = place - np.maximum.accumulate(np.where(fresh, place, 0))
            for i in range(int(turn.max()) + 1):  # one term of each query in turn: no place comes twice
                now = np.flatnonzero(turn == i)
                many = counts[at[now]]
                some = ragged(starts[at[now]], many)
                flat[np.repeat(row[now] * wide, many) + unit[some]] += (np.repeat(weight[now], many) * impact[some]).astype(np.float32)
        return near

    @staticmethod
    def _exact(row: np.ndarray, doc: np.ndarray, first: np.ndarray, run: np.ndarray, weight: np.ndarray, key: np.ndarray, impact: np.ndarray, dl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of hits (row, doc), and lengths of their units. first: of each row, where its runs and weights begin."""
        value, size = np.zeros(len(row)), np.zeros(len(row), np.int64)
        many = np.diff(first)[row]
        ends, at = np.cumsum(many), 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            pair, hit = ragged(first[row[at:to]], many[at:to]), np.repeat(np.arange(at, to), many[at:to])
            want = run[pair] * TILE + doc[hit]
            place = np.minimum(np.searchsorted(key, want), len(key) - 1)
            found = np.flatnonzero(key[place] == want)
            place, hit = place[found], hit[found]
            value[at:to] = np.bincount(hit - at, weight[pair[found]] * impact[place], to - at)
            size[hit] = dl[place]
            at = to
        return value, size


@dataclass
class Segment:
    """All postings of one segment in order of (term, unit), and of (term, falling impact), for many queries at once.

    A query's terms stand in order of what they add at most. A unit that reaches the threshold has an impact in the first
    of its terms that all terms behind can lift so far, so of each term only the postings of the highest impacts are
    read; those of the rest are looked up for such units alone. Where these are many, all units are summed. Frequent terms are
    kept as rows of numbers for all units, of single precision; what comes near a threshold is scored exactly.
    """

    name: int
    terms: pa.Array
    starts: np.ndarray
    counts: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    dl: np.ndarray  # of each unit

    @classmethod
    def load(cls, path: str, norms: str | None, impact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Segment:
        row = stored(path, ["segment", "blocks", "data"])
        blocks, units = blocks_in(row["blocks"][0], row["segment"][0].as_py()), np.frombuffer(row["data"][0].as_buffer(), LENGTHS)
        terms, _, counts = vocabulary(blocks)
        n, given = blocks["n"].to_numpy().astype(np.int64), unpacked(blocks["data"], COUNTED)
        doc = numbers(given["doc"], np.cumsum(n) - n, n).astype(np.int32)
        of_unit = units[doc] if norms is None else np.frombuffer(stored(norms, ["norm"])["norm"][0].as_buffer(), np.float64)[doc]
        return cls(row["segment"][0].as_py(), terms, np.cumsum(counts) - counts, counts, doc, impact(given, of_unit), units["dl"].astype(np.int64))

    def __post_init__(self):
        self.most = np.maximum.reduceat(self.impact, self.starts) if len(self.starts) else np.zeros(0)
        self.wide = max(1, -(-len(self.dl) // RANGES))  # units of a range
        owner = np.repeat(np.arange(len(self.terms)), self.counts)
        of = owner * RANGES + self.doc // self.wide
        run = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
        self.bounds = np.zeros((len(self.terms), RANGES), np.float32)  # what a term adds at most in a range, for a weight of 1
        if len(run):
            self.bounds.ravel()[of[run]] = np.maximum.reduceat(self.impact, run)
        self.row = np.full(len(self.terms) + 1, -1)  # of each frequent term, its row
        often = np.flatnonzero(self.counts * DENSE > len(self.dl))
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.wide * RANGES), np.float32)
        some = ragged(self.starts[often], self.counts[often])
        self.rows[np.repeat(np.arange(len(often)), self.counts[often]), self.doc[some]] = self.impact[some]
        self.key = owner * len(self.dl) + self.doc
        # Postings of each term by falling impact, in single precision: its bits, as a whole number, are in the same order.
        self.fallen = (owner << 32) + self._fall(self.impact)
        order = np.argsort(self.fallen)
        self.fallen, self.fallen_doc, self.fallen_impact = self.fallen[order], self.doc[order], self.impact[order].astype(np.float32)
        self.fallen_range = (self.fallen_doc // self.wide).astype(np.int8)
        self.added = self.compared = self.skipped = self.whole = 0

    @staticmethod
    def _fall(impact: np.ndarray) -> np.ndarray:
        """Whole numbers that fall as impacts rise."""
        return (1 << 31) - 1 - impact.astype(np.float32).view(np.int32).astype(np.int64)

    def best(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, least: np.ndarray, final: Callable[[np.ndarray, np.ndarray], np.ndarray], spare: np.ndarray, length: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(query, segment, doc, sum, final score) as `Tiles.best` gives them. length: all terms together add at most the root of the sum of its squares."""
        n = len(least)
        add = weight * self.most[term]
        order = np.lexsort((-add, query))
        query, term, weight, add = query[order], term[order], weight[order], add[order]
        first = np.searchsorted(query, np.arange(n + 1))
        ends = np.append(0.0, np.cumsum(add))
        after = ends[first[1:]][query] - ends[1:]  # what the terms behind this one add at most
        cap = np.full(len(query) + 1, np.inf)
        if length is not None:
            squares = np.append(0.0, np.cumsum(length[order] ** 2))
            cap[:-1] = np.sqrt(np.maximum(squares[first[1:]][query] - squares[:-1], 0.0) + 1e-9)
        error = (np.diff(first) + 4) * 1.2e-7 * np.bincount(query, add, n) + 1e-9
        least = np.maximum(least, self._seeded(query, first, term, weight, k, least <= 0) - error)
        floor = least - spare - error
        # A unit that reaches the threshold is found by the first of its terms in this order: what stands behind adds no more than `after`.
        last = np.zeros(len(query) + 1, bool)
        last[first[1:][first[1:] > first[:-1]] - 1] = True
        behind = np.where(last[:-1], 0.0, np.minimum(after, cap[1:]) * (1 + 1e-9) + 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            low = np.where(add > 0, (floor[query] - behind) / weight, np.inf)
        many = np.searchsorted(self.fallen, (term << 32) + self._fall(np.clip(low, 0.0, 3e38) * (1 - 1e-6)), side="right") - self.starts[term]
        many = np.clip(np.where(add > 0, many, 0), 0, self.counts[term])
        total = np.bincount(query, many, n).astype(np.int64)
        active = np.flatnonzero(total)
        self.compared += len(active)
        self.skipped += n - len(active)
        dense = total * WHOLE > len(self.dl)
        out: list[tuple[np.ndarray, ...]] = []
        some = active[~dense[active]]
        ends, at = np.cumsum(total[some]), 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS // 8, side="right")))
            out.append(self._found(some[at:to], first, term, weight, many, cap, floor))
            at = to
        some, step = active[dense[active]], max(1, CELLS // (self.wide * RANGES))
        self.whole += len(some)
        for lo in range(0, len(some), step):
            out.append(self._all(some[lo : lo + step], first, term, weight, k, least, spare, error))
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        for hit, doc in out:
            value = self._exact(hit, doc, first, term, weight)
            good = (np.round(value, scoring.PLACES) > 0) & (value >= least[hit] - spare[hit])
            hit, doc, value = hit[good], doc[good], value[good]
            shown = final(value, hit)
            chosen, _ = foremost(hit, np.zeros(len(hit), np.int64), doc, self.dl[doc], shown, k)
            found = [np.append(x, y) for x, y in zip(found, (hit[chosen], np.full(len(chosen), self.name), doc[chosen], value[chosen], shown[chosen]), strict=True)]
        return tuple(found)

    def _seeded(self, query: np.ndarray, first: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, wanted: np.ndarray) -> np.ndarray:
        """For queries that have no threshold yet: what k units reach at least, by the postings of one of their terms with the highest impacts and by frequent terms."""
        out = np.zeros(len(wanted))
        pairs = np.flatnonzero(wanted[query] & (self.counts[term] >= k))
        for lo in range(0, len(pairs), max(1, CELLS // (8 * SEEDS * k))):
            some = pairs[lo : lo + max(1, CELLS // (8 * SEEDS * k))]
            many = np.minimum(self.counts[term[some]], SEEDS * k)
            at, of = ragged(self.starts[term[some]], many), np.repeat(np.arange(len(some)), many)
            doc, value = self.fallen_doc[at], weight[some][of] * self.fallen_impact[at]
            begin, all_ = first[query[some]], first[query[some] + 1]
            for i in range(int((all_ - begin).max(initial=0))):
                other = np.minimum(begin + i, len(term) - 1)
                use = (begin + i < all_) & (other != some) & (self.row[term[other]] >= 0)
                mine = np.flatnonzero(use[of])
                value[mine] += weight[other][of[mine]] * self.rows[self.row[term[other]][of[mine]], doc[mine]]
            order = np.lexsort((-value, of))
            np.maximum.at(out, query[some], value[order][np.cumsum(many) - many + k - 1])
        return out

    def _found(self, some: np.ndarray, first: np.ndarray, term: np.ndarray, weight: np.ndarray, many: np.ndarray, cap: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, unit) that may reach the queries' floors: of each term `many` postings of the highest impacts."""
        asked = np.diff(first)[some]
        pairs, of = ragged(first[some], asked), np.repeat(np.arange(len(some)), asked)
        t, w, many = term[pairs], weight[pairs], many[pairs]
        sums = np.zeros((len(pairs) + 1, RANGES))
        np.cumsum(w[:, None] * self.bounds[t], axis=0, out=sums[1:])
        behind = sums[np.cumsum(asked)][of] - sums[1:]  # what the terms behind this one add at most in each range
        ends = np.cumsum(asked)[of]  # the query's terms end here
        if np.isfinite(cap[:-1]).any():
            behind = np.minimum(behind, np.where(np.arange(len(pairs)) + 1 < ends, cap[pairs + 1], 0.0)[:, None])
        need = floor[some][of]
        with np.errstate(divide="ignore", invalid="ignore"):  # the least impact that a unit of each range needs
            low = np.where(w[:, None] > 0, (need[:, None] - behind) / w[:, None], 0.0).astype(np.float32).ravel()
        at = ragged(self.starts[t], many)
        self.added += len(at)
        cell = np.repeat(np.arange(0, len(low), RANGES, dtype=np.int32), many)
        cell += self.fallen_range.take(at)
        impact = self.fallen_impact.take(at)
        can = np.flatnonzero(impact >= low.take(cell))
        pair, near = np.divmod(cell[can], RANGES)
        doc = self.fallen_doc.take(at[can])
        over = w[pair] * impact[can] + behind.ravel().take(cell[can]) - need[pair]
        # Of the terms behind, frequent ones are read from their rows, then the others are looked up, one after the other.
        for frequent in (True, False):
            mine = (self.row[t] >= 0) == frequent
            before, places_ = np.cumsum(mine), np.flatnonzero(mine)
            left = np.append(before, 0)[ends - 1] - before
            for i in range(int(left.max(initial=0))):
                use = np.flatnonzero(left[pair] > i)
                other = places_[before[pair[use]] + i]
                which = t[other]
                most = self.bounds[which, near[use]]
                if frequent:
                    adds = self.rows[self.row[which], doc[use]]
                else:
                    has = most > 0
                    use, other, which, most = use[has], other[has], which[has], most[has]
                    found, place = self._places(which, doc[use])
                    adds = np.zeros(len(use))
                    adds[found] = self.impact[place]
                over[use] += w[other] * (adds - most)
                keep = over >= 0
                pair, doc, near, over = pair[keep], doc[keep], near[keep], over[keep]
        cell = np.sort(of[pair] * len(self.dl) + doc.astype(np.int64))
        cell = cell[np.append(True, cell[1:] != cell[:-1])[: len(cell)]]
        return some[cell // len(self.dl)], cell % len(self.dl)

    def _all(self, of: np.ndarray, first: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, least: np.ndarray, spare: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, unit) that may reach the queries' thresholds, by sums for all units."""
        units = self.wide * RANGES
        floor = np.maximum((least - spare - error)[of], 1e-37)
        near = self._near(first[of], np.diff(first)[of], term, weight).reshape(len(of), units)
        if units > k:
            full = np.flatnonzero(np.count_nonzero(near >= floor[:, None], axis=1) > 32 * k)
            kth = np.partition(near[full], units - k, axis=1)[:, units - k]
            floor[full] = np.maximum(floor[full], kth - 2 * error[of[full]] - spare[of[full]])
        hit, doc = np.nonzero(near >= floor[:, None])
        return of[hit], doc

    def _near(self, first: np.ndarray, wanted: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums of some queries for all units."""
        units, at = self.wide * RANGES, ragged(first, wanted)
        of, row = np.repeat(np.arange(len(first)), wanted), self.row[term[at]]
        rare = row < 0
        pair, many = at[rare], self.counts[term[at[rare]]]
        some = ragged(self.starts[term[pair]], many)
        self.added += len(some)
        cell = np.repeat(of[rare] * units, many) + self.doc[some]
        near = np.bincount(cell, np.repeat(weight[pair], many) * self.impact[some], len(first) * units).astype(float, copy=False)  # whole numbers where nothing is added
        row, of, given = row[~rare], of[~rare], weight[at[~rare]].astype(np.float32)
        ends = np.searchsorted(of, np.arange(len(first) + 1)).tolist()
        for q in np.unique(of).tolist():
            mine = slice(ends[q], ends[q + 1])
            near[q * units : (q + 1) * units] += given[mine] @ self.rows[row[mine]]
        return near

    def _places(self, term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs have a posting, and its place."""
        some = np.flatnonzero(self.bounds[term, doc // self.wide] > 0)
        want = term[some] * len(self.dl) + doc[some]
        order = np.argsort(want)  # in order, so that neighbours are read together
        want, some = want[order], some[order]
        place = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        found = self.key[place] == want
        return some[found], place[found]

    def _exact(self, query: np.ndarray, doc: np.ndarray, first: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        value, many = np.zeros(len(query)), np.diff(first)[query]
        ends, at = np.cumsum(many), 0
        while at < len(query):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            pair, hit = ragged(first[query[at:to]], many[at:to]), np.repeat(np.arange(at, to), many[at:to])
            adds = np.zeros(len(pair))
            found, place = self._places(term[pair], doc[hit])
            adds[found] = weight[pair[found]] * self.impact[place]
            value[at:to] = np.bincount(hit - at, adds, to - at)
            at = to
        return value


def alike(vectors: np.ndarray, groups: int, seed: int = 0) -> np.ndarray:
    """A group for each vector: spherical k-means for a few rounds. What is alike gets narrow bounds; results do not depend on it."""
    n = len(vectors)
    if n <= groups:
        return np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    centres = vectors[rng.integers(n, size=1)]
    for _ in range(groups - 1):
        far = np.maximum(1 - (vectors @ centres.T).max(axis=1), 0) ** 2
        centres = np.concatenate([centres, vectors[[int(np.searchsorted(np.cumsum(far), rng.random() * far.sum()).clip(0, n - 1))]]])
    for _ in range(5):
        of = (vectors @ centres.T).argmax(axis=1)
        centres = np.stack([vectors[of == g].sum(axis=0) if (of == g).any() else centres[g] for g in range(groups)])
        centres /= np.maximum(np.sqrt((centres**2).sum(axis=1, keepdims=True)), 1e-30)
    return (vectors @ centres.T).argmax(axis=1)


class Vectors:
    """Units of some segments as vectors, in ranges of like units, of what queries ask for alone.

    Frequent terms are rows of numbers for all units, in single precision, with a bound for each range; of rarer ones
    all postings are added. A query adds up rows only in ranges whose bounds reach its threshold, and what comes near
    the threshold is scored exactly.
    """

    def __init__(self, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], terms: int, impact: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]):
        """parts: of each segment its number, lengths and norms of its units, and its postings (place of the term, unit, count)."""
        sizes = [len(x[1]) for x in parts]
        n = self.n = sum(sizes)
        self.ranges = max(1, -(-n // WIDE))
        units = self.ranges * WIDE
        term = np.concatenate([x[3] for x in parts])
        unit = np.concatenate([x[4] + base for x, base in zip(parts, np.cumsum(sizes) - sizes, strict=True)])
        value = impact({"tf": np.concatenate([x[5] for x in parts])}, np.concatenate([x[2] for x in parts])[unit])
        length = np.concatenate([x[1] for x in parts])
        counts = np.bincount(term, minlength=terms)
        # Groups are told apart by the terms that some units have and others lack.
        traits = np.argsort(-(counts * np.maximum(n - counts, 0)), kind="stable")[:TRAITS]
        column = np.full(terms, -1, np.int32)
        column[traits] = np.arange(len(traits))
        column = column[term]
        some = np.flatnonzero(column >= 0)
        vectors = np.zeros((n, len(traits)), np.float32)
        vectors[unit[some], column[some]] = value[some]
        vectors /= np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-30)
        group = alike(vectors, GROUPS)
        order = np.lexsort((length, group))
        del vectors, column, some
        edges = np.unique(np.searchsorted(group[order], np.arange(GROUPS)) // WIDE)
        self.segment = np.repeat([x[0] for x in parts], sizes)[order]
        self.doc = np.concatenate([np.arange(x) for x in sizes])[order]
        self.dl = length[order]
        key = term.astype(np.int64) * units + places(order)[unit]
        del term, unit
        order = np.argsort(key)
        self.key, self.impact = key[order], value[order]
        del key, value, order
        self.units, self.counts = units, counts
        self.starts = np.cumsum(counts) - counts
        self.most = np.zeros(terms)
        if len(self.key):
            self.most[counts > 0] = np.maximum.reduceat(self.impact, self.starts[counts > 0])
        self.row = np.full(terms, -1)
        often = np.flatnonzero(counts * OFTEN > n)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), units), np.float32)
        for r, t in enumerate(often.tolist()):
            mine = slice(self.starts[t], self.starts[t] + counts[t])
            self.rows[r, self.key[mine] - t * units] = self.impact[mine]
        self.bounds = self.rows.reshape(len(often), self.ranges, WIDE).max(axis=2)
        # What a frequent term adds in each group, about.
        self.groups = np.add.reduceat(self.bounds, edges[edges < self.ranges], axis=1)
        self.compared = self.skipped = 0

    def best(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, least: np.ndarray, final: Callable[[np.ndarray, np.ndarray], np.ndarray], spare: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, segment, doc, sum, final score) as `Tiles.best` gives them."""
        n, step = len(least), max(1, CELLS // self.units)
        first = np.searchsorted(query, np.arange(n + 1))
        error = (np.diff(first) + 4) * 1.2e-7 * np.bincount(query, weight * self.most[term], n) + 1e-9
        found = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0)] * 2]
        # Queries of the same group follow one another, so that the rows they read are at hand.
        often = np.flatnonzero(self.row[term] >= 0)
        of, w, row = query[often], weight[often], self.row[term[often]]
        groups = [np.bincount(of, w * x[row], n) for x in np.ascontiguousarray(self.groups.T)]
        turn = np.argsort(np.argmax(groups, axis=0), kind="stable")
        for lo in range(0, n, step):
            hit, doc = self._near(np.sort(turn[lo : lo + step]), first, term, weight, k, least, spare, error)
            value = self._exact(hit, doc, first, term, weight)
            good = (np.round(value, scoring.PLACES) > 0) & (value >= least[hit] - spare[hit])
            hit, doc, value = hit[good], doc[good], value[good]
            shown = final(value, hit)
            chosen, _ = foremost(hit, self.segment[doc], self.doc[doc], self.dl[doc], shown, k)
            hit, doc, value, shown = hit[chosen], doc[chosen], value[chosen], shown[chosen]
            found.append([hit, self.segment[doc], self.doc[doc], value, shown])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _near(self, queries: np.ndarray, first: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, least: np.ndarray, spare: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, unit) that may reach the queries' thresholds."""
        wanted = np.diff(first)[queries]
        of, at = np.repeat(np.arange(len(queries)), wanted), ragged(first[queries], wanted)
        t, w = term[at], weight[at]
        rare = self.row[t] < 0
        many = self.counts[t[rare]]
        some = ragged(self.starts[t[rare]], many)
        cell = self.key[some] + np.repeat((of[rare] - t[rare]) * self.units, many)
        near = np.bincount(cell, np.repeat(w[rare], many) * self.impact[some], len(queries) * self.units).astype(np.float32).reshape(len(queries), self.ranges, WIDE)
        top = near.max(axis=2)
        rows, of, given = self.row[t[~rare]], of[~rare], w[~rare].astype(np.float32)
        ends = np.searchsorted(of, np.arange(len(queries) + 1)).tolist()
        blocks = self.rows.reshape(-1, WIDE)
        hits: list[np.ndarray] = [np.zeros(0, np.int64)]
        units: list[np.ndarray] = [np.zeros(0, np.int64)]

        def added(mine: np.ndarray, w: np.ndarray, ranges: np.ndarray) -> np.ndarray:
            return (w @ blocks.take(np.add.outer(mine * self.ranges, ranges).ravel(), axis=0).reshape(len(mine), len(ranges) * WIDE)).reshape(-1, WIDE)

        for i, q in enumerate(queries.tolist()):
            mine, w = rows[ends[i] : ends[i + 1]], given[ends[i] : ends[i + 1]]
            bound = top[i] + w @ self.bounds.take(mine, axis=0)
            floor = least[q] - spare[q] - error[q]
            if least[q] <= 0 and self.n > k:  # a first threshold: what k units reach in the ranges with the highest bounds
                ranges = np.argpartition(bound, -FEW)[-FEW:] if self.ranges > FEW else np.arange(self.ranges)
                value = (near[i, ranges] + added(mine, w, ranges)).ravel()
                floor = max(floor, float(np.partition(value, len(value) - k)[len(value) - k]) - 2 * error[q] - spare[q])
            ranges = np.flatnonzero(bound >= floor - error[q])
            self.compared += len(ranges)
            self.skipped += self.ranges - len(ranges)
            if not len(ranges):
                continue
            value = (near[i].take(ranges, axis=0) + added(mine, w, ranges)).ravel()
            at = np.flatnonzero(value >= max(floor, 1e-37))
            if len(at) > 4 * k:
                kth = float(np.partition(value[at], len(at) - k)[len(at) - k])
                at = at[value[at] >= kth - 2 * error[q] - spare[q]]
            if len(at):
                hits.append(np.full(len(at), q))
                units.append(ranges[at // WIDE] * WIDE + at % WIDE)
        return np.concatenate(hits), np.concatenate(units)

    def _exact(self, query: np.ndarray, unit: np.ndarray, first: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        value, many = np.zeros(len(query)), np.diff(first)[query]
        ends, at = np.cumsum(many), 0
        while at < len(query):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            pair, hit = ragged(first[query[at:to]], many[at:to]), np.repeat(np.arange(at, to), many[at:to])
            want = term[pair] * self.units + unit[hit]
            place = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            has = np.flatnonzero(self.key[place] == want)
            value[at:to] = np.bincount(hit[has] - at, weight[pair[has]] * self.impact[place[has]], to - at)
            at = to
        return value


def vectors_of(places_: list[tuple[str, str]], asked: pa.Array, impact: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]) -> Iterator[Vectors]:
    """Segments (path, norms) of up to `UNITS` units and `HELD` postings of the terms that are asked for together, one at least."""
    held: list[tuple] = []
    units = postings = 0
    for path, norms in places_:
        row = stored(path, ["segment", "blocks", "data"])
        name = row["segment"][0].as_py()
        blocks, lengths = blocks_in(row["blocks"][0], name), np.frombuffer(row["data"][0].as_buffer(), LENGTHS)
        n, given = blocks["n"].to_numpy().astype(np.int64), unpacked(blocks["data"], COUNTED)
        term = np.repeat(pc.fill_null(pc.index_in(blocks["term"], asked), -1).to_numpy(), n)
        some = term >= 0
        part = name, lengths["dl"].astype(np.int64), np.frombuffer(stored(norms, ["norm"])["norm"][0].as_buffer(), np.float64), term[some], numbers(given["doc"], np.cumsum(n) - n, n)[some].astype(np.int32), given["tf"][some]
        if held and (units + len(part[1]) > UNITS or postings + len(part[3]) > HELD):
            yield Vectors(held, len(asked), impact)
            held, units, postings = [], 0, 0
        held.append(part)
        units, postings = units + len(part[1]), postings + len(part[3])
    if held:
        yield Vectors(held, len(asked), impact)


def shown_as(dtype: str, offset: float | np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Scores as they are ranked: with what units have without a match, of the precision of `dtype`, rounded."""
    if dtype in ("float64", "double"):
        return lambda x: np.round(x + offset, scoring.PLACES)
    return lambda x: np.round((x + offset).astype(np.float32).astype(float), scoring.PLACES)


def worthwhile(blocks: DataFrame, known: DataFrame, least: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Blocks that can lift a unit to the threshold of some query, together with all that its other terms add at most.

    blocks: with `_bound`; known: (query_id, term, w, offset); least: (query_id, least), of queries that have a threshold.
    """
    most = small(materialise(blocks.groupBy("term").agg(F.max("_bound").alias("most")), "bounds"))
    weighed = known.join(most, "term").withColumn("_add", F.col("w") * F.col("most")).withColumn("_all", F.sum("_add").over(Window.partitionBy("query_id")))
    goal = F.coalesce("least", F.lit(0.0)) * (1 - 1e-6) - F.abs("offset") * 1e-6 - SPARE
    need = weighed.join(least, "query_id", "left").groupBy("term").agg(F.min((goal - (F.col("_all") - F.col("_add"))) / F.col("w")).alias("_need"))
    return blocks.join(small(materialise(need, "need")), "term").filter("_bound >= _need")


_ASKED = "ids array<string>, least binary, offset binary, terms array<string>, query binary, term binary, w binary, scale binary"


def in_blocks(queries: DataFrame, size: int) -> DataFrame:
    """Queries (query_id, terms (term, w, scale), offset, least) by up to `size` in a row, their terms once in each row: what all segments read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                ids, terms, offset, least = batch.slice(lo, size).columns
                pairs, many = terms.flatten(), pc.list_value_length(terms).to_numpy().astype(np.int64)
                found = pairs.field("term").dictionary_encode()
                binary = {"least": least.to_numpy(), "offset": offset.to_numpy(), "query": np.repeat(np.arange(len(ids), dtype=np.int32), many), "term": found.indices.to_numpy(), "w": pairs.field("w").to_numpy(), "scale": pairs.field("scale").to_numpy()}
                own = {x: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for x, v in binary.items()}
                for x, v in (("ids", ids), ("terms", found.dictionary)):
                    own[x] = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                names = [x.split()[0] for x in _ASKED.split(", ")]
                yield pa.RecordBatch.from_arrays([own[x] for x in names], names=names)

    return queries.select("query_id", "terms", "offset", "least").mapInArrow(run, _ASKED)


def search_all(index: PostingsIndex, known: DataFrame, k: int, impact: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: str, unit_length: bool) -> DataFrame:
    """(query_id, segment, doc, sum, score) of many queries: a task for each segment, where its postings lie; queries are read from the shared folder, a block of them at a time."""
    single = dtype not in ("float64", "double")
    terms = F.sort_array(F.collect_list(F.struct("term", "w", "scale")))
    # Queries with the same terms are one.
    same = known.groupBy("query_id").agg(terms.alias("terms"), F.first("offset").alias("offset"))
    kept = materialise(same.groupBy("terms", "offset").agg(F.min("query_id").alias("query_id"), F.collect_list("query_id").alias("members")), "distinct")
    size = QUERIES * 16
    parts = index.places.count()

    def blocks_of(least: DataFrame | None) -> list[str]:
        given = kept.select("query_id", "terms", "offset")
        given = given.withColumn("least", F.lit(0.0)) if least is None else given.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        return sorted(materialise(in_blocks(given.repartition(max(1, -(-n // size))), size), "blocks", 1).inputFiles())

    def wave(first: int, last: int, least: DataFrame | None) -> DataFrame:
        asked = blocks_of(least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [x for batch in batches for x in zip(batch["path"].to_pylist(), batch["norms"].to_pylist(), strict=True)]
            if unit_length:
                terms = pc.unique(pa.concat_arrays([pa.array([], pa.string()), *(stored(file, ["terms"])["terms"].combine_chunks().flatten() for file in asked)]))
                for vectors in vectors_of(held, terms, impact):
                    yield from scored(vectors, terms)
                    del vectors
                return
            for path, norms in held:
                part = Segment.load(path, norms, impact)
                yield from scored(part, part.terms)

        def scored(part: Segment | Vectors, known_terms: pa.Array) -> Iterator[pa.RecordBatch]:
            for file in asked:
                row = stored(file, [x.split()[0] for x in _ASKED.split(", ")])
                if not row.num_rows:
                    continue
                read = lambda x, kind: np.frombuffer(row[x][0].as_buffer(), kind)  # noqa: E731, B023
                ids, number = row["ids"][0].values, np.full(len(row["terms"][0].values), -1)
                at = pc.index_in(known_terms, row["terms"][0].values)
                number[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                offset, term, query, w = read("offset", float), number[read("term", np.int32)], read("query", np.int32).astype(np.int64), read("w", float)
                here = term >= 0
                query, term, w = query[here], term[here], w[here]
                weight = w * read("scale", float)[here]
                spare = np.full(len(ids), SPARE)
                if single:
                    spare += 1e-6 * (np.abs(offset) + np.bincount(query, weight * part.most[term], len(ids)))
                found = part.best(query, term, weight, k, read("least", float), lambda value, of: shown_as(dtype, offset[of])(value), spare)  # noqa: B023
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(found[0])), *(pa.array(x) for x in found[1:])], names=["query_id", "segment", "doc", "sum", "score"])

        return index.each(run, "query_id string, segment long, doc long, sum double, score double", first, last, TOGETHER if unit_length else 1)

    n = kept.count()
    if parts < TWO_WAVES:
        found = wave(0, parts, None)
    else:
        # Each wave knows the k-th best of all segments before it.
        place = Window.partitionBy("query_id").orderBy(F.desc("sum"))
        ends = [max(1, parts // 64), max(1, parts // 8), parts] if parts >= THREE_WAVES else [math.isqrt(parts), parts]
        found, least, first = None, None, 0
        for last in ends:
            hits = wave(first, last, least)
            if last < parts:
                hits = materialise(hits, "hits")
            found = hits if found is None else found.unionByName(hits)
            least = found.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") == k).select("query_id", F.col("sum").alias("least"))
            first = last
    found = found.withColumn("_rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("_rank") <= k)
    return found.select("query_id", "segment", "doc", "score").join(kept.select("query_id", F.explode("members").alias("_member")), "query_id").select(F.col("_member").alias("query_id"), "segment", "doc", "score")


def search(index: PostingsIndex, known: DataFrame, k: int, impact: Callable[[np.ndarray, np.ndarray], np.ndarray], bound: Column | None, dtype: str = "float64", unit_length: bool = False) -> DataFrame:
    """(query_id, unit_id, score): the k best matches of each query, more where they are equal.

    known: (query_id, term, df, w, scale, offset). impact: what postings add for a weight of w times scale, from their
    records and their units' lengths, or norms where the index has them; bound: a column that no impact of the block exceeds.
    unit_length: for each unit, impacts times scales are a vector of length 1, and so is w.
    """
    spark = index.segments.sparkSession
    known = materialise(known.filter("w > 0"), "known")
    if bound is None or known.select("query_id").distinct().limit(FEW).count() >= FEW:
        ranked = broadcast_if_small(materialise(search_all(index, known, k, impact, dtype, unit_length), "ranked"))
        return index.ids().join(ranked, ["segment", "doc"]).select("query_id", "unit_id", "score")
    kind = COUNTED
    known = materialise(known.drop("df").join(index.terms, "term"), "known")
    asked = known.groupBy("term").agg(F.first("df").alias("df"), F.first("first").alias("first"), F.first("last").alias("last"))
    n_terms, postings, ranges = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0)), F.collect_set(F.struct("first", "last"))).first()
    files = sorted({f for first, last in ranges for f in range(first, last + 1)})
    small = F.broadcast if n_terms <= BROADCAST_TERMS else lambda df: df
    parts = max(1, -(-postings // PART_POSTINGS), min(shuffle_partitions(spark), -(-postings // LEAST_POSTINGS)))
    # Segments are dealt in turn: by hash some parts would have several times the postings of others.
    dealt = index.segments.select("segment", F.row_number().over(Window.orderBy("segment")).alias("_at"))
    parts = max(1, min(parts, index.segments.count()))
    dealt = F.broadcast(materialise(dealt.select("segment", F.pmod(F.col("_at"), F.lit(parts)).cast("int").alias("part")), "parts"))
    blocks = index.of(files).join(small(asked.select("term")), "term", "left_semi").withColumn("_bound", bound).join(dealt, "segment")
    lengths = index.segments.select("segment", "data").join(dealt, "segment")
    queries = known.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"), F.first("offset").alias("offset"))
    single = dtype not in ("float64", "double")
    names = ["segment", "term", "n", "data"]

    def together(tiles: Tiles, asked: pa.RecordBatch) -> pa.RecordBatch:
        """What a part has for many queries."""
        ids, terms, offset, least = (asked.column(asked.schema.get_field_index(x)) for x in ("query_id", "terms", "offset", "least"))
        offset, least, pairs = offset.to_numpy(), least.to_numpy(), terms.flatten()
        term = pc.fill_null(pc.index_in(pairs.field("term"), tiles.terms), -1).to_numpy().astype(np.int64)
        query, weight = np.repeat(np.arange(len(ids)), pc.list_value_length(terms).to_numpy()), pairs.field("w").to_numpy()
        spare = np.full(len(ids), SPARE)
        if single:
            spare += 1e-6 * (np.abs(offset) + np.bincount(query, weight * np.append(tiles.highest, 0.0)[term], len(ids)))
        here = term >= 0
        found = tiles.best(query[here], term[here], weight[here], k, least, lambda value, of: shown_as(dtype, offset[of])(value), spare)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(found[0])), *(pa.array(x) for x in found[1:])], names=["query_id", "segment", "doc", "sum", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, tiles = [], None, None
        for batch in batches:
            at = batch.num_rows - int(np.count_nonzero(batch.column(batch.schema.get_field_index("query_id")).is_valid().to_numpy(zero_copy_only=False)))  # blocks come first
            if at:
                held.append(batch.slice(0, at).select(names))
            if at == batch.num_rows:
                continue
            if part is None and tiles is None:
                part = Blocks.of(held, kind, impact)
                held.clear()
            if tiles is not None or batch.num_rows - at >= FEW:
                if tiles is None:
                    tiles, part = Tiles.of(part), None
                for lo in range(at, batch.num_rows, QUERIES):
                    yield together(tiles, batch.slice(lo, QUERIES))
                continue
            found: list[tuple[str, tuple[np.ndarray, ...]]] = []
            for q in batch.slice(at).select(["query_id", "terms", "offset", "least"]).to_pylist():
                spare = SPARE + (1e-6 * (abs(q["offset"]) + sum(x["w"] * max((m.get(x["term"], 0.0) for m in part.most.values()), default=0.0) for x in q["terms"])) if single else 0.0)
                found.append((q["query_id"], part.best([(x["term"], x["w"]) for x in q["terms"]], k, q["least"], shown_as(dtype, q["offset"]), spare, unit_length)))
            n = [len(x[1][0]) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([x[0] for x in found], object), n), pa.string()), *(pa.array(np.concatenate([x[1][i] for x in found])) for i in range(4))], names=["query_id", "segment", "doc", "sum", "score"])

    def wave(blocks: DataFrame, first: int, last: int, least: DataFrame | None) -> DataFrame:
        some = blocks.filter((F.col("part") >= first) & (F.col("part") < last)).select("part", "at", *names)
        given = queries.withColumn("least", F.lit(0.0)) if least is None else queries.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        given = given.withColumn("part", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        own = lengths.filter((F.col("part") >= first) & (F.col("part") < last))
        both = some.unionByName(own, allowMissingColumns=True).unionByName(given, allowMissingColumns=True).withColumn("part", F.col("part") - first)
        return both.repartitionById(last - first, "part").sortWithinPartitions(F.asc_nulls_first("query_id"), "segment", F.asc_nulls_first("term"), "at").mapInArrow(run, "query_id string, segment long, doc long, sum double, score double")

    if parts < TWO_WAVES:
        found = wave(blocks, 0, parts, None)
    else:
        early, place = math.isqrt(parts), Window.partitionBy("query_id").orderBy(F.desc("sum"))
        found = materialise(wave(blocks, 0, early, None), "hits")
        least = materialise(found.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") == k).select("query_id", F.col("sum").alias("least")), "least")
        found = found.unionByName(wave(worthwhile(blocks, known, least, small), early, parts, least))
    ranked = found.withColumn("_rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).filter(F.col("_rank") <= k).select("query_id", "segment", "doc", "score")
    ranked = broadcast_if_small(materialise(ranked, "ranked"))
    return index.ids().join(ranked, ["segment", "doc"]).select("query_id", "unit_id", "score")
