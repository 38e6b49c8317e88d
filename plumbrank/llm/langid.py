"""Operator 6, language identification by compression.

A text is compressed with each language's raw-content zstandard dictionary, and the
language whose dictionary leaves the fewest bytes wins. A narrow margin is
reported as a rejection beside the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialise
from . import text as tx
from .toxicity import held_out

#: Bound of the fit: documents a language, bytes of a dictionary, languages.
DOCS_A_LANGUAGE = 256
DICTIONARY_BYTES = 112 << 10
LANGUAGES = 512
#: Bytes of a training text that enter a dictionary in one turn.
PIECE_BYTES = 512
LEVEL = 7
#: Bytes of text compressed at once, up to a space. Longer texts are taken in parts, so that a text does not become its own dictionary.
PART_BYTES = 2048
#: A winner that saves less than this share of bytes against the second is rejected.
MARGIN = 0.01
#: Likelihood ratio of a byte saved in a hundred, for the score.
SHARPNESS = 1.0

_LETTER = regex.compile(r"\p{L}")


def normal(text: str) -> bytes:
    """Lower case, and any run without letters as one space: figures and markup speak for no language."""
    return regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip().encode()


def parts(data: bytes, size: int) -> list[bytes]:
    """The bytes in parts of at most `size`, cut behind a space; where there is none, between characters."""
    out, at = [], 0
    while at < len(data):
        to = min(at + size, len(data))
        if to < len(data):
            space = data.rfind(b" ", at, to) + 1
            while not space and data[to] & 0xC0 == 0x80 and to > at + 1:
                to -= 1
            to = space or to
        out.append(data[at:to])
        at = to
    return out


def fit_dictionaries(docs: DataFrame, lang: str = "lang", per_language: int = DOCS_A_LANGUAGE, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary for each language, the most frequent first: texts of a bounded sample, at most `size` bytes.

    The sample is the `per_language` documents of each language with the least hash of
    their id that aren't held out and have letters; ids that share a text or repeat count
    once. Whole texts are normalised on the executors and cut into pieces; a dictionary takes
    the first piece of each document, then the second of each, and so on until it is full.
    Ids are cut by a threshold on their hash, from their number, ahead of any shuffle
    (six deviations above what is wanted), so a frequent language is no hot key; the few
    that are left are ranked and broadcast (at most languages x per_language) to fetch
    texts. More languages than `LANGUAGES` are an error, not a sample of them.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t"), F.col(lang).alias("_l")).filter(F.col("_l").isNotNull() & F.col("_t").rlike(r"\p{L}") & ~held_out("_id"))
    ids = materialise(rows.select("_l", "_id", F.xxhash64("_id").alias("_h")), "language-ids")
    often = {r["_l"]: r["n"] for r in ids.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(often) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not often:
        return {}
    wanted = per_language + 6 * per_language**0.5 + 10
    least = docs.sparkSession.createDataFrame([(k, float(min(1.0, wanted / n))) for k, n in often.items()], "_l string, _part double")
    low = ids.join(F.broadcast(least), "_l").filter(F.col("_h") / F.lit(2.0**64) + 0.5 <= F.col("_part")).select("_l", "_id", "_h").distinct()
    ranked = low.withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_id"))).filter(F.col("_r") <= per_language)
    chosen = rows.join(F.broadcast(ranked), ["_l", "_id"]).groupBy("_l", "_r").agg(F.min("_t").alias("_t"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language, rank, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                cut = parts(normal(text), PIECE_BYTES)
                cut = cut[: int(np.searchsorted(np.cumsum([len(x) for x in cut]), size, side="right"))]  # no dictionary has room for more
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(cut), pa.string()), pa.array([rank] * len(cut), pa.int32()), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], names=["_l", "_r", "_turn", "_piece"])

    cut = chosen.mapInArrow(pieces, "_l string, _r int, _turn int, _piece binary")
    room = F.sum(F.length("_piece")).over(Window.partitionBy("_l").orderBy("_turn", "_r"))
    filled = cut.withColumn("_to", room).filter(F.col("_to") <= size)
    found = {r["_l"]: b"".join(x["_piece"] for x in r["_all"]) for r in filled.groupBy("_l").agg(F.array_sort(F.collect_list(F.struct("_turn", "_r", "_piece"))).alias("_all")).collect()}
    discard(ids)
    return {k: found[k] for k in sorted(found, key=lambda k: (-often[k], k)) if found[k]}


class Classifier:
    """Languages in the order of the dictionaries, which is what decides between equal sizes."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self.compressors = [self._compressor(dictionaries[x]) for x in self.languages]

    @staticmethod
    def _compressor(content: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text under each language."""
        cut = parts(normal(text), PART_BYTES)
        return np.array([sum(len(c.compress(x)) for x in cut) for c in self.compressors], float)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        if text is None or not self.languages or not _LETTER.search(text):
            return "und", 0.0, True
        sizes = self.sizes(text)
        low = np.sort(sizes)
        margin = float((low[1] - low[0]) / low[1]) if len(low) > 1 else 1.0
        share = np.exp(-SHARPNESS * 100.0 * (sizes - low[0]) / low[0])
        return self.languages[int(sizes.argmin())], float(1.0 / share.sum()), margin < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append lang_pred, score and rejected to the columns `keep` (default: all).

    `und` with score 0 where the text is null or has no letters, or nothing was
    learned. Equal sizes go to the more frequent language. Repeated rows stay; columns named as
    the appended ones are replaced. The dictionaries are broadcast: at most
    `LANGUAGES` x `DICTIONARY_BYTES`.
    """
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    kept = [x for x in (docs.columns if keep is None else keep) if x not in added]
    schema = T.StructType([docs.schema[x] for x in kept] + [T.StructField(k, v) for k, v in added.items()])
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield tx.with_columns(batch.select(kept), lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()), rejected=pa.array(rejected, pa.bool_()))

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def language_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row; `und` and 0 for null texts and texts without letters."""
    found = identify(docs, fit_dictionaries(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
