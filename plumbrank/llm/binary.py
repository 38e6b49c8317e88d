"""Operator 10, token-id files with a minimal perfect hash index.

A shard file holds the ids of consecutive documents, in ascending key order:

    magic | ids, raw, uint16 or uint32, little-endian | index sections | footer | footer length | magic

The index maps a document key to its ids in constant time: a minimal perfect hash
gives a slot, the slot's stored fingerprint tells a foreign key, its entry gives
the first document of that key and their number (keys may repeat), and the
document offsets give the ids. One key is looked up with a handful of reads of a few
bytes. The manifest, a small Parquet table, has a row for each shard with its first and
last key, so a key's shard is known without opening any, and ids before a shard are a
running sum over it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path, shuffle_partitions
from . import text as tx
from .tokens import cut_tiles, encoder

MAGIC = b"PLMBIDX1"
#: Slots for each key on a level of the hash: sparser levels end sooner.
GAMMA = 2.0
#: Bytes of text in a shard, about; and in one of a table that is too small to give every task a whole shard.
SHARD_BYTES, LEAST_BYTES = 64 << 20, 4 << 20
#: Bytes of ids that a reader takes at once.
READ_BYTES = 4 << 20


@dataclass
class PerfectHash:
    """Levels of bit arrays. A key rests on the first level where no other key meets it; its slot is the rank of its bit."""

    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tx.mix64(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        sizes, parts, left = [], [], keys
        while len(left):
            size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        ones = np.bitwise_count(words).astype(np.int64)
        return cls(np.array(sizes, np.int64), words, np.concatenate([[0], np.cumsum(ones)]))

    @classmethod
    def slot(cls, key: np.ndarray, sizes: np.ndarray, word_at, rank_at) -> int:
        """The slot of one key, or -1; word_at and rank_at fetch single entries, one word for each level that is tried."""
        base = 0
        for level, size in enumerate(sizes.tolist()):
            at = int(cls._place(key, level, size)[0]) + base
            word, bit = int(word_at(at >> 6)), at & 63
            if word >> bit & 1:
                return int(rank_at(at >> 6)) + (word & ((1 << bit) - 1)).bit_count()
            base += size
        return -1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key that was built in; of a foreign key any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = self._place(keys[open_], level, size) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.ranks[at >> 6] + below)[hit]
            open_, base = open_[~hit], base + size
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (tx.mix64(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype("<u4")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Writes one shard front to back; only keys and offsets stay in memory."""

    def __init__(self, path: str, width: np.dtype):
        where, name = _open(path)
        self.out, self.width, self.keys, self.sizes = where.open_output_stream(name), width, [], []
        self.out.write(MAGIC)

    def add(self, keys: np.ndarray, null: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.keys.append((keys, null))
        self.sizes.append(sizes)
        self.out.write(np.ascontiguousarray(ids, self.width).tobytes())

    def close(self) -> dict[str, int | None]:
        """Write the index; returns the shard's entries in the manifest."""
        keys, null = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((list(y), t) for y, t in zip(zip(*self.keys) if self.keys else ((), ()), (np.int64, bool), strict=True)))
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        n_null = int(null.sum())  # they sort first
        known, first, count = np.unique(keys[n_null:], return_index=True, return_counts=True)
        hashed = known.view(np.uint64)
        mph = PerfectHash.build(hashed)
        slot = mph.slots(hashed)
        mark, entry, many = np.zeros(len(known), "<u4"), np.zeros(len(known), "<u8"), np.zeros(len(known), "<u4")
        mark[slot], entry[slot], many[slot] = fingerprints(hashed), first + n_null, count
        sections = {"keys": keys.astype("<i8"), "offsets": offsets, "sizes": mph.sizes.astype("<i8"), "words": mph.words, "ranks": mph.ranks.astype("<i8"), "marks": mark, "entries": entry, "counts": many}
        at, placed = len(MAGIC) + int(offsets[-1]) * self.width.itemsize, {}
        for name, x in sections.items():
            pad = -at % 8
            self.out.write(b"\0" * pad + x.tobytes())
            placed[name] = [at + pad, len(x), x.dtype.str]
            at += pad + x.nbytes
        footer = json.dumps({"dtype": self.width.str, "n_ids": int(offsets[-1]), "n_docs": len(keys), "n_null": n_null, "sections": placed}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        first, last = (int(known[0]), int(known[-1])) if len(known) else (None, None)
        return {"n_docs": len(keys), "n_null": n_null, "n_ids": int(offsets[-1]), "first_key": first, "last_key": last}


class ShardReader:
    """Keyed access to one shard: sections of the index are read whole where many keys are asked for, entry by entry for one."""

    def __init__(self, path: str):
        where, name = _open(path)
        self.file = where.open_input_file(name)
        end = self.file.size()
        tail = self._bytes(end - 16, 16)
        if tail[8:] != MAGIC or self._bytes(0, 8) != MAGIC:
            raise ValueError(f"{path}: not a token shard")
        size = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(self._bytes(end - 16 - size, size))
        self.width = np.dtype(self.footer["dtype"])

    def _bytes(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at) if size else b""

    def entries(self, name: str, first: int = 0, count: int | None = None) -> np.ndarray:
        """Entries of a section, all of them or `count` from `first`."""
        at, n, kind = self.footer["sections"][name]
        kind, count = np.dtype(kind), n if count is None else count
        return np.frombuffer(self._bytes(at + first * kind.itemsize, count * kind.itemsize), kind)

    @cached_property
    def keys(self) -> np.ndarray:
        return self.entries("keys")

    @cached_property
    def offsets(self) -> np.ndarray:
        return self.entries("offsets")

    @cached_property
    def index(self) -> tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray]:
        return PerfectHash(*map(self.entries, ("sizes", "words", "ranks"))), *map(self.entries, ("marks", "entries", "counts"))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first document of each key in this shard and how many it has; -1 and 0 where it has none."""
        hashed = np.asarray(keys, np.int64).view(np.uint64)
        mph, marks, entries, counts = self.index
        slot = mph.slots(hashed)
        there = slot >= 0
        if len(marks):
            there &= marks[slot] == fingerprints(hashed)
            doc = np.where(there, entries[slot].astype(np.int64), -1)
            there &= self.keys[np.maximum(doc, 0)] == keys
            return np.where(there, doc, -1), np.where(there, counts[slot].astype(np.int64), 0)
        return np.full(len(keys), -1), np.zeros(len(keys), np.int64)

    def find_one(self, key: int) -> tuple[int, int]:
        """As `find`, for one key: single entries of the index are read, whatever its size."""
        hashed = np.array([key], np.int64).view(np.uint64)
        one = lambda name: lambda i: self.entries(name, i, 1)[0]
        slot = PerfectHash.slot(hashed, self.entries("sizes"), one("words"), one("ranks"))
        if slot < 0 or one("marks")(slot) != fingerprints(hashed)[0]:
            return -1, 0
        doc = int(one("entries")(slot))
        return (doc, int(one("counts")(slot))) if int(one("keys")(doc)) == key else (-1, 0)

    def ids(self, doc: int, docs: int = 1) -> np.ndarray:
        lo, *_, hi = self.entries("offsets", doc, docs + 1).tolist()
        return np.frombuffer(self._bytes(len(MAGIC) + lo * self.width.itemsize, (hi - lo) * self.width.itemsize), self.width)


_MANIFEST = "shard int, file string, n_docs long, n_null long, n_ids long, first_key long, last_key long"


def write_token_files(docs: DataFrame, tokenizer_path: str, out_dir: str, key: str = "doc_id", text: str = "text", end_id: int | None = 2) -> DataFrame:
    """Encode whole texts and write them as shards in ascending key order; returns the manifest.

    Texts are range-partitioned by key once, into shards of about `SHARD_BYTES` of text,
    or as many as there are partitions where these still hold `LEAST_BYTES`. A task streams its rows to one file
    under a name of its own, and the manifest, committed by Spark's own writer,
    names the file of the attempt that counted: a task that is run again leaves an
    orphan, never a mixture. Null texts count as empty and hold the end id alone;
    null keys sort first; repeated keys stay side by side, ordered by text, in several shards
    where they are many.
    """
    spark = docs.sparkSession
    docs.sparkSession.createDataFrame([], "a int").write.parquet(f"{out_dir}/made")  # makes the folder through Spark's own file system
    files = f"{out_dir}/shards"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer_path, cut_tiles, False), TaskContext.get().partitionId()
        width = enc.width if end_id is None or end_id < 1 << 8 * enc.width.itemsize else np.dtype("<u4")
        out, name = None, f"{shard:06d}-{uuid.uuid4().hex}.ids"
        for batch in batches:
            for part, texts in tx.blocks(batch, "text"):
                if out is None:
                    where, folder = _open(files)
                    where.create_dir(folder, recursive=True)
                    out = ShardWriter(f"{files}/{name}", width)
                ids, sizes = enc.ids(texts)
                if end_id is not None:
                    ids, sizes = np.insert(ids.astype(width), np.cumsum(sizes), end_id), sizes + 1
                keys = part.column(part.schema.get_field_index("key"))
                out.add(keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False), ids, sizes)
        if out is not None:
            told = out.close()
            tx.release()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], **{k: pa.array([v], pa.int64()) for k, v in told.items()}})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES), min(shuffle_partitions(spark), size // LEAST_BYTES))
    # The manifest's rows, one for each shard, meet in one file.
    rows.repartitionByRange(shards, "key", F.substring("text", 1, 64)).sortWithinPartitions("key", "text").mapInArrow(write, _MANIFEST).repartition(1).write.parquet(f"{out_dir}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{out_dir}/manifest")


def read_token_files(spark: SparkSession, out_dir: str, key: str = "doc_id") -> DataFrame:
    """One row for each document of the files, in their words: key, start, n_tokens, ids_crc32.

    The manifest has a row for each shard, so the running sum over it is the only step in
    one task. Each document is looked up through the hash index of its shard; ids are read
    `READ_BYTES` at a time, or a document at a time where that is longer.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{out_dir}/manifest")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = manifest.select("shard", "file", before.alias("base"))
    files = f"{out_dir}/shards"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(f"{files}/{row['file']}")
                n_null, n = shard.footer["n_null"], shard.footer["n_docs"]
                first, count = shard.find(np.unique(shard.keys[n_null:]))
                at = np.concatenate([np.arange(n_null), tx.ragged(first, count)])
                if len(at) != n or (first < 0).any():
                    raise ValueError(f"{row['file']}: the index misses documents")
                block = (shard.offsets[at + 1].astype(np.int64) * shard.width.itemsize - 1) // READ_BYTES
                for some in np.split(at, np.flatnonzero(np.diff(block)) + 1) if n else ():
                    ids = shard.ids(int(some[0]), len(some))
                    cut = (shard.offsets[some[0] : some[0] + len(some) + 1] - shard.offsets[some[0]]).astype(np.int64).tolist()
                    yield pa.RecordBatch.from_pydict({
                        key: pa.array(shard.keys[some], pa.int64(), mask=some < n_null),
                        "start": pa.array(row["base"] + shard.offsets[some].astype(np.int64)),
                        "n_tokens": pa.array(np.diff(cut), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.int64()),
                    })

    return rows.repartition(max(1, min(shuffle_partitions(spark), manifest.count())), "shard").mapInArrow(read, f"{key} long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, out_dir: str, key: int | None) -> list[np.ndarray]:
    """The ids of every document with this key, or without one: only shards whose keys go around it are opened.

    A key has several such shards only where its documents go over the ends of files.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{out_dir}/manifest")
    holds = F.col("n_null") > 0 if key is None else (F.col("first_key") <= key) & (F.col("last_key") >= key)
    found = []
    for row in manifest.filter(holds).orderBy("shard").toLocalIterator():
        shard = ShardReader(f"{out_dir}/shards/{row.file}")
        first, count = (0, row.n_null) if key is None else shard.find_one(key)
        found += [shard.ids(first + i) for i in range(count)]
    return found


def binary_query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write token files to the shared folder and return what reading them back gives."""
    out_dir = fresh_path(docs.sparkSession, "ids")
    write_token_files(docs, tokenizer_path, out_dir)
    return read_token_files(docs.sparkSession, out_dir)
