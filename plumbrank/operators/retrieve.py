"""Retrievers: BM25, character n-gram TF-IDF, dense vectors; and their registry.

A retriever has a `name`, a `descriptor` that holds all that can change its output,
`index(units)` and `search(queries, k)`. Units are (unit_id, text), queries
(query_id, text); a search gives (query_id, unit_id, rank, score) with k rows for each
query, or as many as there are units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, ClassVar, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..session import broadcast_if_small, materialise, spread
from . import cells, models
from .postings import COUNTED, LENGTHS, VOCABULARIES, PostingsIndex, blocks_in, indexed, inverted, inverted_grams, numbers, search, stored, unpacked, vocabularies
from .ranking import rank

#: Rows (term, idf) that a task holds at once, about.
FILED = 2 << 20


class Retriever(Protocol):
    name: str

    @property
    def descriptor(self) -> dict[str, Any]: ...
    def index(self, units: DataFrame) -> None: ...
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


def padded(matches: DataFrame, queries: DataFrame, units: DataFrame, k: int, offset: DataFrame | None = None, dtype: str = "float64") -> DataFrame:
    """Top k of matches, filled up with units of no match in order of their ids.

    matches: (query_id, unit_id, score) of units that score above 0 by themselves; offset:
    (query_id, offset), what each unit has without a match. Scores are of `dtype` before
    they are ranked, so what its precision makes equal is in order of ids. Matches are
    ranked and written once; only queries with fewer than k of them are filled up, from
    the first k ids.
    """
    ranked = materialise(rank(_precise(matches, dtype), k, "unit_id"), "ranked")
    short = queries.select("query_id").distinct().join(ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")), "query_id", "left").filter(F.coalesce("_n", F.lit(0)) < k).select("query_id")
    first = units.select("unit_id").orderBy("unit_id").limit(k)
    blanks = short.crossJoin(F.broadcast(first)).join(ranked, ["query_id", "unit_id"], "left_anti").withColumn("score", F.lit(0.0))
    if offset is not None:
        blanks = blanks.join(offset, "query_id", "left").select("query_id", "unit_id", F.coalesce("offset", F.lit(0.0)).alias("score"))
    return rank(ranked.select("query_id", "unit_id", "score").unionByName(_precise(blanks, dtype)), k, "unit_id")


def _precise(scored: DataFrame, dtype: str) -> DataFrame:
    """Scores as numbers of `dtype`, kept as double."""
    return scored if dtype in ("float64", "double") else scored.withColumn("score", F.col("score").cast("float").cast("double"))


def pinned(model_id: str, revision: str | None, resolve: Callable[[str], str | None] | None) -> str | None:
    """The revision that was asked for, or the one that a model's name stands for now, as far as `resolve` can tell."""
    if revision is not None or resolve is None:
        return revision
    try:
        found = resolve(model_id)
    except Exception:  # offline, unknown, a local path: all of them mean that it is not known
        return None
    return None if found is None else str(found)


@dataclass
class BM25Retriever:
    """An index holds all terms and serves any method, k1, b and stop words; only with a stemmer, which may make a stop word of another, does it lack the stop words."""

    uses: ClassVar[tuple[str, ...]] = ("numpy", "pyarrow")
    version: ClassVar[int] = 2
    name: str = "bm25"
    k1: float = 1.5
    b: float = 0.75
    method: str = "lucene"
    stopwords: str | None = "en"
    stemmer: str | None = None
    token_pattern: str = text.TERM
    lower: bool = True
    dtype: str = "float64"
    _index: PostingsIndex | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        scoring.check_method(self.method)

    @property
    def descriptor(self) -> dict[str, Any]:
        return {"kind": "bm25", "k1": self.k1, "b": self.b, "method": self.method, "stopwords": self.stopwords, "stemmer": self.stemmer, "token_pattern": self.token_pattern, "lower": self.lower, "dtype": self.dtype, "impl_version": self.version}

    @property
    def index_options(self) -> tuple:
        """Retrievers for which these are the same can share an index."""
        return "bm25", self.lower, self.token_pattern, self.stemmer, self.stopwords if self.stemmer else None

    def index(self, units: DataFrame) -> None:
        found = text.stem_column(text.terms(F.col("text"), self.stopwords if self.stemmer else None, self.lower, self.token_pattern), self.stemmer)
        rows = spread(units.select("unit_id", "text")).select("unit_id", found.alias("terms"))
        stop = F.lit(0) if self.stemmer else F.size(F.filter("terms", lambda t: t.isin(*text.ENGLISH_STOPWORDS)))
        self._index = indexed(inverted(rows.withColumn("stop", stop)))

    def share(self, other: PostingsIndex | None = None) -> PostingsIndex | None:
        """The index, or take over another's."""
        self._index = other or self._index
        return self._index

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        ix = self._index
        if ix is None:
            raise ValueError("index() comes before search()")
        found = text.stem_column(text.terms(F.col("text"), self.stopwords, self.lower, self.token_pattern), self.stemmer)
        wanted = queries.select("query_id", F.explode(found).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("qtf"))
        w = F.col("qtf") * scoring.bm25_idf(self.method, F.lit(float(ix.totals[0])), F.col("df").cast("double"))
        stopped = self.stopwords is not None and not self.stemmer
        absent = scoring.bm25_absent(self.method, self.k1)
        offset = F.sum("w").over(Window.partitionBy("query_id")) * absent
        wanted = materialise(wanted, "wanted")
        known = materialise(wanted.join(ix.counted(wanted), "term").withColumn("w", w).withColumn("scale", F.lit(1.0)).withColumn("offset", offset if absent else F.lit(0.0)), "known")
        method, k1, b, avgdl = self.method, self.k1, self.b, ix.mean_length(stopped)

        def impact(of: np.ndarray, units: np.ndarray) -> np.ndarray:
            return scoring.bm25_tf(method, k1, b, of["tf"].astype(float), (units["dl"] - units["stop"] if stopped else units["dl"]).astype(float), avgdl)

        bound = scoring.bm25_tf(method, k1, b, F.col("most_tf").cast("double"), F.col("least_kept" if stopped else "least_dl").cast("double"), F.lit(avgdl))
        hits = search(ix, known, k, impact, bound, self.dtype)
        return padded(hits, queries, ix.units, k, known.select("query_id", "offset").distinct() if absent else None, self.dtype)


def tf_weights(tf: np.ndarray, sublinear: bool) -> np.ndarray:
    return 1 + np.log(tf) if sublinear else tf.astype(float)


def norms(ix: PostingsIndex, files: list[str], sublinear: bool) -> DataFrame:
    """(segment, norm): lengths of a segment's units as vectors. files: (term, idf), which each task reads once for all its segments, up to `FILED` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = [path for batch in batches for path in batch["path"].to_pylist()]
        terms, number, sizes = vocabularies(paths)
        idf, held, many = np.zeros(len(terms)), [], 0
        for i, file in enumerate(files):
            held.append(stored(file, ["term", "idf"]))
            many += held[-1].num_rows
            if many >= FILED or i == len(files) - 1:
                known = pa.concat_tables(held).combine_chunks()
                if len(known):
                    at = pc.index_in(terms, known["term"].combine_chunks())
                    idf[at.is_valid().to_numpy(zero_copy_only=False)] = known["idf"].take(at.drop_null()).to_numpy()
                held, many = [], 0
        first = 0
        for path, counts in zip(paths, sizes, strict=True):
            row = stored(path, ["segment", "blocks", "data"])
            blocks = blocks_in(row["blocks"][0], row["segment"][0].as_py())
            n, given = blocks["n"].to_numpy().astype(np.int64), unpacked(blocks["data"], COUNTED)
            weight = tf_weights(given["tf"], sublinear) * np.repeat(idf[number[first : first + len(counts)]], counts)
            first += len(counts)
            units = len(row["data"][0].as_buffer()) // LENGTHS.itemsize
            norm = np.sqrt(np.bincount(numbers(given["doc"], np.cumsum(n) - n, n), weight**2, units))
            yield pa.RecordBatch.from_arrays([row["segment"].combine_chunks(), pa.array([norm.tobytes()], pa.binary())], names=["segment", "norm"])

    return ix.each(run, "segment long, norm binary", most=VOCABULARIES)


@dataclass
class TfidfRetriever:
    """Postings hold counts, and the index a norm for each unit, so that a cosine is a sum over what a query has."""

    uses: ClassVar[tuple[str, ...]] = ("numpy", "pyarrow")
    version: ClassVar[int] = 2
    name: str = "tfidf"
    ngram_range: tuple[int, int] = (3, 5)
    lower: bool = True
    sublinear_tf: bool = True
    smooth_idf: bool = True
    dtype: str = "float64"
    _index: PostingsIndex | None = field(default=None, repr=False)
    _df: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        low, high = self.ngram_range
        if not 1 <= low <= high:
            raise ValueError(f"ngram_range {self.ngram_range} must hold 1 <= low <= high")

    @property
    def descriptor(self) -> dict[str, Any]:
        return {"kind": "tfidf", "ngram_range": list(self.ngram_range), "lower": self.lower, "sublinear_tf": self.sublinear_tf, "smooth_idf": self.smooth_idf, "dtype": self.dtype, "impl_version": self.version}

    def _idf(self, units: int) -> Column:
        return scoring.smooth_idf(F.lit(float(units)), F.col("df").cast("double"), self.smooth_idf)

    def index(self, units: DataFrame) -> None:
        lowered = F.lower("text") if self.lower else F.col("text")
        plain = indexed(inverted_grams(spread(units.select("unit_id", lowered.alias("text"))), *self.ngram_range))
        self._df = materialise(plain.counted(), "df")
        files = sorted(materialise(self._df.select("term", self._idf(plain.totals[0]).alias("idf")), "idf").inputFiles())
        self._index = PostingsIndex(plain.segments, materialise(norms(plain, files, self.sublinear_tf), "norms", 1))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        ix = self._index
        if ix is None:
            raise ValueError("index() comes before search()")
        grams = text.char_ngrams(queries, "query_id", *self.ngram_range, self.lower).groupBy("query_id", F.col("gram").alias("term")).agg(F.count(F.lit(1)).cast("double").alias("tf"))
        # Grams that the corpus lacks have no idf: they leave the query's vector, its norm too.
        asked = grams.join(self._df, "term").withColumn("scale", self._idf(ix.totals[0])).withColumn("qw", scoring.tf_weight(F.col("tf"), self.sublinear_tf) * F.col("scale"))
        norm = F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("query_id")))
        known = asked.select("query_id", "term", "df", (F.col("qw") / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).alias("w"), "scale", F.lit(0.0).alias("offset"))
        sublinear = self.sublinear_tf
        hits = search(ix, known, k, lambda of, norm: tf_weights(of["tf"], sublinear) / np.where(norm == 0, 1.0, norm), None, self.dtype, unit_length=True)
        return padded(hits, queries, ix.units, k, None, self.dtype)


@dataclass
class DenseRetriever:
    """Vectors come from a column, or from an encoder: a function from a list of texts to a matrix, or `load`, which gives one in each worker process.

    Calls hold texts of like length; vectors return to the rows that their texts came from. Search is exact, in cells.

    A model republished under its name is another model: without a `revision`, `resolve`
    says which one the name stands for now. None where that cannot be known, never a guess.
    """

    uses: ClassVar[tuple[str, ...]] = ("numpy", "pyarrow")
    version: ClassVar[int] = 2
    model_id: str = "precomputed"
    name: str = "dense"
    revision: str | None = None
    device: str = "cpu"
    dtype: str = "float64"
    normalize: bool = True
    query_prompt: str = ""
    document_prompt: str = ""
    max_seq_length: int | None = None
    batch_size: int = 32
    encoder: Callable[[list[str]], np.ndarray] | None = None
    load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None
    resolve: Callable[[str], str | None] | None = field(default=None, repr=False)
    _cells: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.revision = pinned(self.model_id, self.revision, self.resolve)

    @property
    def descriptor(self) -> dict[str, Any]:
        names = ("model_id", "revision", "device", "dtype", "normalize", "query_prompt", "document_prompt", "max_seq_length", "batch_size")
        return {"kind": "dense", **{x: getattr(self, x) for x in names}, "impl_version": self.version}

    def _vectors(self, rows: DataFrame, unit: str, prompt: str) -> DataFrame:
        """(unit, vector as array<double>), of unit length where `normalize` says so; a null vector stays out."""
        if "vector" not in rows.columns:
            if self.encoder is None and self.load is None:
                raise ValueError("texts need an encoder, or `load` that gives one; or give a `vector` column")
            key, encoder, load, count = models.name_of(self.descriptor, self.load), self.encoder, self.load, self.batch_size

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                encode = encoder or models.loaded(key, load)
                for batch in batches:
                    texts = [prompt + (x or "") for x in batch.column(1).to_pylist()]
                    found: list[Any] = [None] * len(texts)
                    for call in models.calls([models.size(x) for x in texts], count):
                        for i, vector in zip(call, np.asarray(encode([texts[i] for i in call]), float), strict=True):
                            found[i] = vector
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=[unit, "vector"])

            rows = rows.select(unit, "text").mapInArrow(run, f"{unit} string, vector array<double>")
        v = F.col("vector").cast("array<double>")
        rows = rows.select(unit, v.alias("vector")).filter("vector is not null")
        if not self.normalize:
            return rows
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        return rows.withColumn("_norm", norm).select(unit, F.when(F.col("_norm") == 0, F.col("vector")).otherwise(F.transform("vector", lambda x: x / F.col("_norm"))).alias("vector"))

    def index(self, units: DataFrame) -> None:
        self._cells = cells.build(self._vectors(units, "unit_id", self.document_prompt))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if self._cells is None:
            raise ValueError("index() comes before search()")
        return rank(cells.search(self._cells, self._vectors(queries, "query_id", self.query_prompt), k, self.dtype in ("float32", "float16")), k, "unit_id")


RETRIEVERS: dict[str, Callable[..., Retriever]] = {"bm25": BM25Retriever, "tfidf": TfidfRetriever, "dense": DenseRetriever}


def build(kind: str, **options: Any) -> Retriever:
    if kind not in RETRIEVERS:
        raise ValueError(f"unknown retriever {kind!r}; known: {', '.join(RETRIEVERS)}")
    return RETRIEVERS[kind](**options)


def retrieve(retriever: Retriever, units: DataFrame, queries: DataFrame, k: int, unit: str = "doc_id") -> DataFrame:
    """Index and search, with the unit's own name in the run."""
    if k < 1:
        raise ValueError("k must be at least 1")
    retriever.index(units.withColumnRenamed(unit, "unit_id"))
    return retriever.search(queries, k).withColumnRenamed("unit_id", unit)
