"""Best-fit packing in bulk-synchronous supersteps over tables of gaps."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavemill.llm import common, words

_PIECES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

_STEP = "sequence_id long, room long, length long, first long, n long, left long"

#: Gaps that one task ranks and settles.
GAPS_A_TASK = 100_000


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Token pieces of docs(doc_id, text): doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit).

    A document is its ids and end_id; only a longer one than capacity is cut, the first piece taking the remainder.
    Null text is empty: one piece of the end id.
    """
    end = np.array([end_id], np.uint32)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for doc_id, found in zip(batch.column("doc_id").to_pylist(), words.encoder(vocabulary)(common.blobs(batch.column("text"))), strict=True):
            ids = np.concatenate([found, end]).astype("<u4").tobytes()
            n = len(ids) // 4
            at = 0
            for k in range(-(-n // capacity)):
                to = min(n, (n - 1) % capacity + 1 + k * capacity)
                part = ids[4 * at : 4 * to]
                for column, value in zip(out, (doc_id, k, at, to - at, zlib.crc32(part), part), strict=True):
                    column.append(value)
                at = to
        return common.record(_PIECES | {"ids": pa.binary()}, *out) if with_ids else common.record(_PIECES, *out[:5])

    rows = common.only(docs, doc_id="long", text="string")
    return common.over_texts(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids, holds="encoder")


def sweep(rooms: dict[int, int], waiting: dict[int, int], above: int) -> list[tuple[int, int, int, int, int, int]]:
    """One successor sweep, from the longest pieces to those longer than `above`: each length in turn goes to the tightest
    gaps that take it and that no longer piece has taken in this sweep.

    rooms: gaps of each size; waiting: pieces of each length. Rows (room, first gap, one past the last gap, length, first
    piece, pieces a gap): gaps are ranks within their size, pieces ranks among those waiting of their length, so that
    no two pieces meet in one place. Where more pieces of a length wait than gaps are left, a gap takes several of them.
    """
    out, stack, free = [], [], 0
    for size in range(max(rooms, default=0), above, -1):
        if n := rooms.get(size):
            stack.append([size, 0, n])
            free += n
        rank, left = 0, waiting.get(size, 0)
        while left and stack:
            room, first, n = stack[-1]
            each = max(1, min(room // size, -(-left // free), left))
            take = min(n, left // each)
            out.append((room, first, first + take, size, rank, each))
            rank, left, free = rank + take * each, left - take * each, free - take
            if take == n:
                stack.pop()
            else:
                stack[-1] = [room, first + take, n - take]
    return out


def _band(waiting: dict[int, int], capacity: int) -> int:
    """The length above which pieces take part in the next sweep: a shorter band joins once under a tenth of those that
    wait are longer."""
    bands = capacity // 2, capacity // 4, 0
    return next(b for b in bands if not b or 10 * sum(n for length, n in waiting.items() if length > b) >= sum(waiting.values()))


def _opened(stranded: dict[int, int], capacity: int) -> int:
    """The least number of sequences that pieces of these lengths can need."""
    return max(sum(n for length, n in stranded.items() if 2 * length > capacity), -(-sum(length * n for length, n in stranded.items()) // capacity))


def _ranked(rows: DataFrame, size: str, key: str, salts: int) -> DataFrame:
    """rows with rank, from 0 without gaps among rows of one size. Salts spread a hot size; key is unique, so that a
    lost task gives the same ranks again."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    before = salted.groupBy(size, "salt").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy(size).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(size, "salt").orderBy(key)))
    return ranked.join(before, [size, "salt"]).withColumn("rank", F.col("rank") - 1 + F.coalesce("before", F.lit(0))).drop("salt", "before")


def _settled(gaps: DataFrame, matches: list[tuple[int, int, int, int, int, int]], taken: dict[int, int], least: int) -> DataFrame:
    """gaps(sequence_id, room, rank) with the pieces they take: length, first (rank among all of that length), n (0: none);
    and the room left after them, 0 where that is under `least`."""
    rows = np.array(sorted(matches), np.int64).reshape(-1, 6)
    first = rows[:, 4] + np.array([taken.get(length, 0) for length in rows[:, 3].tolist()], np.int64)

    def settle(batches):
        for batch in batches:
            room, rank = (batch.column(c).to_numpy() for c in ("room", "rank"))
            length, start, n = (np.zeros(len(room), np.int64) for _ in range(3))
            for size in np.unique(room).tolist():
                lo, hi = np.searchsorted(rows[:, 0], [size, size + 1])
                if lo < hi:
                    mine = np.flatnonzero(room == size)
                    at = lo + np.searchsorted(rows[lo:hi, 1], rank[mine], "right") - 1
                    ok = (at >= lo) & (rank[mine] < rows[at, 2])
                    mine, at = mine[ok], at[ok]
                    length[mine], n[mine] = rows[at, 3], rows[at, 5]
                    start[mine] = first[at] + (rank[mine] - rows[at, 1]) * rows[at, 5]
            left = room - length * n
            columns = batch.column("sequence_id"), room, length, start, n, np.where(left < least, 0, left)
            yield pa.record_batch([pa.array(c) for c in columns], names=["sequence_id", "room", "length", "first", "n", "left"])

    return common.in_python(gaps.select("sequence_id", "room", "rank"), settle, _STEP)


def fill(spark: SparkSession, counts: dict[int, int], capacity: int = 1024) -> DataFrame:
    """Places for counts[length] pieces of each length (1 to capacity): length, rank, sequence_id, offset, one row each.

    Supersteps over a table of gaps (sequence_id, room): gaps are sorted and ranked by room; a sweep over the counts of
    each room and length tells which ranks meet; gaps take their pieces, shrink and are written as the next superstep's
    table, until no piece waits. Pieces above half of the capacity go first, then those above a quarter, then the rest.
    Pieces that fit no gap open as many sequences as they need at least. Only the counts of lengths, at most `capacity`,
    reach the driver, which keeps those of rooms by them; gaps and pieces stay tables.
    """
    counts = {length: n for length, n in counts.items() if n}
    if any(length is None or not 1 <= length <= capacity for length in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    taken, steps, opened = dict.fromkeys(counts, 0), [], 0
    gaps, rooms = spark.range(0).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("room")), {}
    while waiting := {length: n - taken[length] for length, n in counts.items() if n > taken[length]}:
        above = _band(waiting, capacity)
        widest = max(rooms, default=0)
        if more := _opened({length: n for length, n in waiting.items() if length > max(above, widest)}, capacity):
            gaps = gaps.union(spark.range(opened, opened + more).select("id", F.lit(capacity).cast("long")))
            opened, rooms = opened + more, rooms | {capacity: rooms.get(capacity, 0) + more}
        matches = sweep(rooms, waiting, above)
        tasks = -(-sum(rooms.values()) // GAPS_A_TASK)
        before = dict(taken)
        for room, a, b, length, _, each in matches:
            taken[length] += (b - a) * each
            rooms[room] -= b - a
            rooms[room - length * each] = rooms.get(room - length * each, 0) + b - a
        least = min((length for length in counts if counts[length] > taken[length]), default=capacity + 1)
        steps.append(common.written(_settled(_ranked(gaps, "room", "sequence_id", tasks).coalesce(tasks), matches, before, least), f"gaps{len(steps)}"))
        gaps = spark.read.schema(_STEP).parquet(steps[-1]).filter("left > 0").select("sequence_id", F.col("left").alias("room"))
        rooms = {room: n for room, n in rooms.items() if n and room >= least}
    if not steps:
        return spark.createDataFrame([], "length long, rank long, sequence_id long, offset long")
    placed = spark.read.schema(_STEP).parquet(*steps).filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return placed.select("length", (F.col("first") + F.col("i")).alias("rank"), "sequence_id", (capacity - F.col("room") + F.col("i") * F.col("length")).alias("offset"))


def pack(parts: DataFrame, capacity: int = 1024) -> DataFrame:
    """parts (rows with doc_id, piece, length of 1 to capacity, and more of any names) with sequence_id and offset.

    Pieces are ranked within their length by a number each row gets when parts is written; rank and length then find
    the row's place. Repeated rows are pieces of their own. An empty table gives an empty result; null lengths, and those
    out of range, are an error. Sequences are filled from offset 0 without gaps.
    """
    spark, names = parts.sparkSession, parts.columns
    own = common.keep(common.guarded(parts, "length").withColumn("length", F.col("length").cast("long")).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in own.groupBy("length").count().collect()}
    places = fill(spark, counts, capacity)
    out = _ranked(own, "length", "row", common.partitions(spark)).join(places, ["length", "rank"])
    kinds = dict(zip(names, (f.dataType for f in parts.schema), strict=True))
    columns = [F.col(c).cast(kinds["length"]) if c == "length" else F.col(c) for c in own.columns[:-1]]
    return out.select(*columns, "sequence_id", "offset").toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """pieces() of docs, packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    out = pack(pieces(docs, vocabulary, capacity, end_id, with_ids), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
