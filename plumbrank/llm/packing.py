"""Operator 12, best-fit packing of token ids into sequences of a fixed capacity.

1. Texts are encoded where they lie; a document of more ids than a sequence holds is cut
   into full pieces and a rest. Pieces are a table in the shared folder.
2. Lengths alone are dealt out by hash, so that each task has a fair mix of them, and packed
   by best fit, longest first. Bins with little room left are sequences as they are.
3. Underfull bins are items of the next round, which has an eighth of the tasks: they are
   dealt out anew and packed by best fit again, as wholes. Rounds go on to a single task, or
   until nothing fits any more. A bin that lacks the room for the shortest item of all is
   left out at once, and a round has more tasks where its items are many, so no task is
   given more than a bounded number of them.
4. From the last round back to the first, bins learn their place in the sequence.

A bin bears the number of the piece that opens it, so numbers need no exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, shuffle_partitions
from . import text as tx
from .tokens import cut_words, encoder

#: A bin that is short of at most this share of its capacity is emitted.
NEARLY_FULL = 1 / 64
#: Underfull bins of so many tasks meet in one of the next round.
FAN_IN = 8
#: Items that are packed at once, at most, and that a task of a later round is given, about.
ITEMS = 200_000
#: Pieces of a task of the first round where there are few of them: best fit needs a choice.
LEAST_ITEMS = 8192


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pack items of 1 to `capacity`, longest first, each into the fullest bin that has room.

    Returns for each item the item that opened its bin, its place there, and how full the
    bin became. Of bins that are equally full the last filled is taken, of equally long
    items the first comes first.
    """
    n = len(lengths)
    opener, place, filled = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    some = 0  # bit r is set where free[r] isn't empty
    for i, size in zip((order := np.argsort(-lengths, kind="stable")).tolist(), lengths[order].tolist(), strict=True):
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, bin_ = capacity, i
        opener[i], place[i] = bin_, capacity - room
        room -= size
        filled[bin_] = capacity - room
        free[room].append(bin_)
        some |= 1 << room
    return opener, place, filled[opener]


def _pieces(docs: DataFrame, tokenizer_path: str, key: str, text: str, capacity: int, end_id: int | None) -> DataFrame:
    """(item, key, piece, start, length, ids) of all pieces; ids are little-endian unsigned 32-bit numbers."""
    fields = [T.StructField("item", T.LongType()), T.StructField(key, docs.schema[key].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, item = encoder(tokenizer_path, cut_words, False), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, texts in tx.blocks(batch, "text"):
                ids, sizes = enc.ids(texts)
                ids = ids.astype("<u4")
                if end_id is not None:
                    ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                many = -(-sizes // capacity)
                of = np.repeat(np.arange(len(sizes)), many)
                piece = tx.ragged(np.zeros(len(sizes), np.int64), many)
                length = np.minimum(sizes[of] - piece * capacity, capacity)
                offsets = np.concatenate([[0], np.cumsum(length)]) * 4
                raw = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(item + np.arange(len(of))), part.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), raw.cast(pa.binary())], names=[f.name for f in fields])
                item += len(of)

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, T.StructType(fields))


def _round(items: DataFrame, capacity: int) -> DataFrame:
    """(item, bin, place, filled) of items (item, length): each task packs what it is given, at most `ITEMS` at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            item, length = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(2))
            order = np.argsort(item)
            item, length = item[order], length[order]
            opener, place, filled = best_fit(length, capacity)
            return pa.RecordBatch.from_pydict({"item": pa.array(item), "bin": pa.array(item[opener]), "place": pa.array(place), "filled": pa.array(filled)})

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ITEMS):
                part = batch.slice(at, ITEMS)
                if n + part.num_rows > ITEMS:
                    yield packed(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield packed(held)

    return items.select("item", "length").mapInArrow(run, "item long, bin long, place long, filled long")


@dataclass
class Packing:
    """pieces: (item, key, piece, start, length, ids); places: (item, sequence_id, offset), a row for each piece."""

    pieces: DataFrame
    places: DataFrame

    def placed(self, *columns: str) -> DataFrame:
        """Columns of the pieces, with sequence and offset."""
        return self.pieces.select("item", *columns).join(self.places, "item").drop("item")

    def sequences(self) -> DataFrame:
        """(sequence_id, n_tokens, n_pieces, ids): whole sequences, ids as they follow one another."""
        rows = self.placed("length", "ids").groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        return rows.select("sequence_id", "n_tokens", "n_pieces", F.aggregate("parts", F.lit(b""), lambda ids, x: F.concat(ids, x["ids"])).alias("ids"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 0, key: str = "doc_id", text: str = "text") -> Packing:
    """Pack the ids of all documents into as few sequences of at most `capacity` ids as best fit finds.

    Each document ends with `end_id`. Null and empty texts hold the end id alone (without one
    they have no piece); repeated rows and null keys are documents like others; other
    columns are not read. Only a document of more than `capacity` ids is cut. An empty
    table gives no pieces.
    """
    pieces = materialise(_pieces(docs, tokenizer_path, key, text, capacity, end_id), "pieces")
    short, slack = pieces.filter(F.col("length") < capacity), int(capacity * NEARLY_FULL)
    n = short.count()
    before, tasks = n, max(1, -(-n // ITEMS), min(shuffle_partitions(docs.sparkSession), n // LEAST_ITEMS))
    rounds = [materialise(_round(short.repartition(tasks, "item"), capacity), "packed")]
    while tasks > 1:
        open_ = rounds[-1].filter((F.col("place") == 0) & (F.col("filled") < capacity - slack)).select(F.col("bin").alias("item"), F.col("filled").alias("length"))
        n, least = open_.agg(F.count(F.lit(1)), F.min("length")).first()
        open_ = open_.filter(F.col("length") <= capacity - (least or capacity))
        fewer = max(1, tasks // FAN_IN, -(-n // ITEMS))
        if n < 2 or (fewer >= tasks and n > 0.99 * before):
            break
        tasks, before = fewer, n
        rounds.append(materialise(_round(open_.repartition(tasks, "item"), capacity), "packed"))
    found = None
    for table in reversed(rounds):
        if found is None:
            found = table.select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
            continue
        # Bins that went on to a later round; all others are sequences.
        upper = found.select(F.col("item").alias("bin"), F.col("sequence_id").alias("_to"), F.col("offset").alias("_at"))
        full = F.col("filled") >= capacity - slack
        moved = table.filter(~full).join(upper, "bin", "left").select("item", F.coalesce("_to", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("_at", F.lit(0))).alias("offset"))
        found = table.filter(full).select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset")).unionByName(moved)
    whole = pieces.filter(F.col("length") == capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return Packing(pieces, found.unionByName(whole))


def packing_query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Places of all pieces, with the checksum of the ids that were stored."""
    return pack(docs, tokenizer_path).placed("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
