"""Token-id files: raw id payloads in shards, each with a minimal perfect hash index from document key to offset.

A dataset is a table of shards in ascending key order, written and read with Spark's own Parquet writer (so any store
that Spark reaches will do, a lost task is simply run again and readers never see half a shard). One row is one shard:

    part int, shard int     place in the order: range partition, then shard within it
    first_id, last_id long  smallest and largest key
    n_docs, n_ids long      documents and ids in it
    width int               bytes an id takes in the payload: 2 where the vocabulary allows, else 4
    n_null int              documents without a key: the first ones
    keys, lengths binary    keys (int64; 0 for those without) and id counts (uint32) in order, little-endian
    index binary            the minimal perfect hash: level count, bits of each level, levels' bit arrays
    prints, offsets binary  by hash slot: a key's fingerprint (uint32) and its document's position in the shard (uint32)
    payload binary          all ids, one document after the other
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavemill.llm import common, words

#: A shard is closed at so many payload bytes; one longer document makes a shard of its own.
SHARD_BYTES = 4 << 20

_SHARD = {
    "part": pa.int32(), "shard": pa.int32(), "first_id": pa.int64(), "last_id": pa.int64(), "n_docs": pa.int64(), "n_ids": pa.int64(), "width": pa.int32(), "n_null": pa.int32(),
    "keys": pa.binary(), "lengths": pa.binary(), "index": pa.binary(), "prints": pa.binary(), "offsets": pa.binary(), "payload": pa.binary(),
}
SCHEMA = "part int, shard int, first_id long, last_id long, n_docs long, n_ids long, width int, n_null int, keys binary, lengths binary, index binary, prints binary, offsets binary, payload binary"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over int64 keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash over distinct keys: level by level, keys that meet no other set their bit; a key's slot
    is the rank of its bit. Lookups look at a constant number of bits on average."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(b.sum()) for b in levels)])
        self.ranks = [np.concatenate([[0], np.cumsum(b, dtype=np.int64)]) for b in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, seed = [], 1
        while len(keys):
            size = 2 * len(keys)
            at = (_mix(keys, seed) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys, seed = keys[~alone[at]], seed + 1
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 (or any slot, which the fingerprint tells) for keys that aren't indexed."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_mix(keys[left], k + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4")
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<u4", n, 4), 4 + 4 * n, []
        for size in map(int, sizes):
            end = at + (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, end - at, at), count=size).astype(bool))
            at = end
        return cls(levels)


def _shard(part: int, number: int, width: int, keys: list, parts: list[bytes]) -> tuple:
    ids = np.array([0 if k is None else k for k in keys], np.int64)
    known = np.array([k is not None for k in keys], bool)
    lengths = np.array([len(p) // width for p in parts], "<u4")
    distinct, first = np.unique(ids[known], return_index=True)
    first = np.flatnonzero(known)[first]
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    prints, offsets = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[slots], offsets[slots] = _fingerprints(distinct), first
    ends = (int(distinct[0]), int(distinct[-1])) if len(distinct) else (None, None)
    return (part, number, *ends, len(keys), int(lengths.sum()), width, len(keys) - int(known.sum()), ids.astype("<i8").tobytes(), lengths.tobytes(), index.to_bytes(), prints.tobytes(), offsets.tobytes(), b"".join(parts))


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode docs(doc_id, text) and write a dataset at `path`, which must not exist, in ascending doc_id order.

    Documents are range-partitioned by doc_id once; each partition is sorted, encoded and cut into shards as it
    streams by, so a task holds one shard at most. Null text is empty (the end id alone). Repeated doc_ids are all
    stored; the index leads to the first. A null doc_id sorts first and isn't indexed; a shard counts those it holds.
    """
    rows = common.only(docs, doc_id="long", text="string")

    def shards(batches):
        encode = words.encoder(vocabulary)
        width = 2 if max(encode.one.library.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        end = end_id.to_bytes(width, "little")
        part, number, keys, parts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, common.BATCH_ROWS):
                some = batch.slice(at, common.BATCH_ROWS)
                for key, found in zip(some.column("doc_id").to_pylist(), encode(common.blobs(some.column("text"))), strict=True):
                    ids = found.astype(f"<u{width}").tobytes() + end
                    if keys and size + len(ids) > shard_bytes:
                        yield common.record(_SHARD, *([v] for v in _shard(part, number, width, keys, parts)))
                        number, keys, parts, size = number + 1, [], [], 0
                    keys.append(key)
                    parts.append(ids)
                    size += len(ids)
        if keys:
            yield common.record(_SHARD, *([v] for v in _shard(part, number, width, keys, parts)))

    ordered = rows.repartitionByRange(common.partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    common.in_python(ordered, shards, SCHEMA, holds="encoder").write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


class Shard:
    """One shard in memory: keyed access to its documents' ids."""

    def __init__(self, row: dict):
        self.width, self.payload, self.n_null = row["width"], row["payload"], row["n_null"]
        self.keys, self.lengths = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.index = PerfectHash.from_bytes(row["index"])
        self.prints, self.offsets = np.frombuffer(row["prints"], "<u4"), np.frombuffer(row["offsets"], "<u4").astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's document in the shard; -1 where the fingerprint says that the shard hasn't got it."""
        slots = self.index.slots(keys)
        out = np.full(len(keys), -1, np.int64)
        if len(self.prints):
            ok = (slots >= 0) & (self.prints[slots] == _fingerprints(keys))
            out[ok] = self.offsets[slots[ok]]
        return out

    def ids(self, document: int) -> np.ndarray:
        a, b = int(self.starts[document]) * self.width, int(self.starts[document + 1]) * self.width
        return np.frombuffer(self.payload, f"<u{self.width}", (b - a) // self.width, a)


def _directory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _bases(table: DataFrame) -> DataFrame:
    """(part, shard, base): ids before each shard; sums by part, then over the parts' sums."""
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table.select("part", "shard", within.alias("within")).join(parts, "part").select("part", "shard", (F.col("before") + F.col("within")).alias("base"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a dataset, found by its key: doc_id, start, n_tokens, ids_crc32 (over 32-bit ids).

    start counts the ids of all documents before it. A repeated doc_id's later rows follow the first in the shard's
    order; rows without a doc_id come first and keep their null. An empty dataset gives an empty result.
    """
    table = _directory(spark, path)
    bases = _bases(table)
    out = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "shard": pa.int32()}

    def documents(batches):
        for row in common.rows_of(batches):
            shard = Shard(row)
            keys, place = shard.keys, np.arange(len(shard.keys))
            named = place >= shard.n_null
            first = named & np.concatenate([[True], (keys[1:] != keys[:-1]) | ~named[:-1]])  # later rows of a key, and those without one, have no entry
            place[first] = shard.find(keys[first])
            if (place < 0).any():
                raise ValueError(f"shard {row['part']}/{row['shard']} doesn't find its own keys")
            columns = ([], [], [], [])
            for key, at in zip(keys.tolist(), place.tolist(), strict=True):
                ids = shard.ids(at)
                for column, value in zip(columns, (key, int(shard.starts[at]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                    column.append(value)
            columns[0][: shard.n_null] = [None] * shard.n_null
            n = len(keys)
            yield common.record(out, *columns, [row["part"]] * n, [row["shard"]] * n)

    found = common.in_python(table, documents, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int")
    return found.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """ids (array of int) of keys(doc_id): each key goes to the part whose range holds it (there are as many as partitions
    at writing), there to the shards whose range holds it, then through their index.

    Keys that aren't stored, and nulls, give no row; repeated keys give a row each.
    """
    table = _directory(spark, path)
    ranges = table.filter("first_id is not null")
    bounds = ranges.groupBy("part").agg(F.min("first_id").alias("a"), F.max("last_id").alias("b")).orderBy("a").toArrow()
    parts, lows, highs = (bounds.column(c).to_numpy() for c in ("part", "a", "b"))

    def place(batches):
        for batch in batches:
            want = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at = np.searchsorted(lows, want, "right") - 1
            ok = (at >= 0) & (want <= highs[at]) if len(lows) else np.zeros(len(want), bool)
            yield common.record({"doc_id": pa.int64(), "part": pa.int32()}, want[ok], parts[at[ok]])

    asked = common.in_python(common.only(keys, doc_id="long").filter("doc_id is not null"), place, "doc_id long, part int")
    near = asked.join(ranges.select("part", "shard", "first_id", "last_id"), "part").filter("doc_id between first_id and last_id")
    near = near.groupBy("part", "shard").agg(F.collect_list("doc_id").alias("asked"))
    types = {"doc_id": pa.int64(), "ids": pa.list_(pa.int32())}

    def fetch(batches):
        for row in common.rows_of(batches):
            shard, want = Shard(row), np.array(row["asked"], np.int64)
            found = shard.find(want)
            ok = (found >= 0) & (shard.keys[found] == want)
            for at in range(0, int(ok.sum()), common.BATCH_ROWS):
                some = slice(at, at + common.BATCH_ROWS)
                yield common.record(types, want[ok][some], [shard.ids(int(p)).tolist() for p in found[ok][some]])

    return common.in_python(table.join(near, ["part", "shard"]), fetch, "doc_id long, ids array<int>")
