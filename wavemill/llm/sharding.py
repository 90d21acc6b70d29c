"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm import common

class CapacityTree:
    """Remaining capacities of open bins in a balanced (left-leaning AA) search tree, smallest first."""

    def __init__(self):
        self.root = None  # nodes are [key, level, left, right]

    @staticmethod
    def _skew(n):
        if n and n[2] and n[2][1] == n[1]:
            left = n[2]
            n[2], left[3] = left[3], n
            return left
        return n

    @staticmethod
    def _split(n):
        if n and n[3] and n[3][3] and n[1] == n[3][3][1]:
            right = n[3]
            n[3], right[2] = right[2], n
            right[1] += 1
            return right
        return n

    def add(self, key: tuple[int, int]) -> None:
        def into(n):
            if n is None:
                return [key, 1, None, None]
            n[2 if key < n[0] else 3] = into(n[2 if key < n[0] else 3])
            return self._split(self._skew(n))

        self.root = into(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def out(n, key):
            if n is None:
                return None
            if key == n[0]:
                if n[2] is None and n[3] is None:
                    return None
                if n[2] is None:
                    m = n[3]
                    while m[2]:
                        m = m[2]
                    n[0], n[3] = m[0], out(n[3], m[0])
                else:
                    m = n[2]
                    while m[3]:
                        m = m[3]
                    n[0], n[2] = m[0], out(n[2], m[0])
            else:
                side = 2 if key < n[0] else 3
                n[side] = out(n[side], key)
            low = min(n[2][1] if n[2] else 0, n[3][1] if n[3] else 0) + 1
            if low < n[1]:
                n[1] = low
                if n[3] and low < n[3][1]:
                    n[3][1] = low
            n = self._skew(n)
            if n[3]:
                n[3] = self._skew(n[3])
                if n[3][3]:
                    n[3][3] = self._skew(n[3][3])
            n = self._split(n)
            if n[3]:
                n[3] = self._split(n[3])
            return n

        self.root = out(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest (remaining, bin) that still takes `size`."""
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                n, best = n[2], n[0]
            else:
                n = n[3]
        return best


Run = tuple[int, int, int, int]


def best_fit_decreasing(sizes: dict[int, int], capacity: int, most: int | None = None) -> list[Run] | None:
    """sizes[s] items of size s for each s, to bins of `capacity`: the largest first, each into the tightest bin that takes
    it. Rows (size, first rank, one past the last rank, bin), ranks being any fixed order of the items of one size.

    A bin that has taken an item of a size is the tightest for the next one too, as long as it takes it. So the items of
    a size go to bins in runs, and the work grows with the sizes and bins that there are, never with the items. An item
    of over `capacity` has a bin of its own. None where more than `most` bins are needed.
    """
    tree, out, bins = CapacityTree(), [], 0
    for size in sorted(sizes, reverse=True):
        rank, total = 0, sizes[size]
        while rank < total:
            if found := tree.tightest(size):
                tree.remove(found)
                remaining, number = found
            else:
                if bins == most:
                    return None
                remaining, number, bins = max(capacity, size), bins, bins + 1
            n = min(total - rank, remaining // size) if size else total - rank
            out.append((size, rank, rank + n, number))
            rank += n
            if remaining > n * size:
                tree.add((remaining - n * size, number))
    return out


def balanced(sizes: dict[int, int], shards: int) -> list[Run]:
    """Items to `shards` bins at the smallest capacity with which best-fit decreasing needs no more, as it returns them.

    An item of over an even share of what is left has a bin of its own, so it doesn't loosen the others' capacity.
    """
    sizes, out, number, taken = dict(sizes), [], 0, {}
    total = sum(s * n for s, n in sizes.items())
    while sizes and shards - number > 1 and (top := max(sizes)) * (shards - number) > total:
        first = taken.get(top, 0)
        out.append((top, first, first + 1, number))
        taken[top], sizes[top], total, number = first + 1, sizes[top] - 1, total - top, number + 1
        if not sizes[top]:
            del sizes[top]
    left = shards - number
    if not sizes:
        return out
    low, high = max(max(sizes), -(-total // left)), total
    best = best_fit_decreasing(sizes, high, left)
    step = 1
    while low < high:
        # Nearly always the answer is just over an even share: capacities are tried from there on in doubling steps.
        capacity = min(low + step - 1, (low + high) // 2)
        if (bins := best_fit_decreasing(sizes, capacity, left)) is not None:
            best, high, step = bins, capacity, 1
        else:
            low, step = capacity + 1, 2 * step
    return out + [(s, a + taken.get(s, 0), b + taken.get(s, 0), number + k) for s, a, b, k in best]


def ranked(rows: DataFrame, by: list[str], order: list[str], rank: str) -> DataFrame:
    """rows with their rank (from 0, without gaps) within `by`, numbered within salts of `order`, so that no task sees all
    rows of a hot value."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(common.partitions(rows.sparkSession))))
    before = salted.groupBy(*by, "__salt").agg(F.count("*").alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*by).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    before = before.select(*by, "__salt", F.coalesce(earlier, F.lit(0)).alias("__before"))
    numbered = salted.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*order)))
    return numbered.join(before, [*by, "__salt"]).withColumn(rank, F.col("__before") + F.col("__k") - 1).drop("__salt", "__before", "__k")


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs(doc_id, text) to shards of near-equal bytes; equal texts stay together. One row per row: doc_id, size,
    text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes plus 1 (null text: 1, checksum of nothing); null and empty texts are one group, a
    group's size being that of all its rows. Groups of one size are ranked by (salt of the text's digest, digest), and
    every group enters the bin that best-fit decreasing finds for it. Only the count of groups of each size comes to the
    driver: distinct sizes whose sum is at most the bytes of all texts, so at most the root of twice those bytes.

    Slots count each shard's rows from 0 without gaps, by (salt, doc_id, checksum, size). Repeated rows have a slot each. A
    group larger than an even share can't be split and has a shard of its own. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = common.only(docs, doc_id="long", text="string")
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("text_key"))
    base = common.keep(base, "sizes")
    groups = common.keep(base.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("m")), "groups")
    counts = groups.groupBy("bytes").agg(F.count("*").alias("n"), F.sum("m").alias("rows")).toArrow()
    runs = balanced(dict(zip(counts.column("bytes").to_pylist(), counts.column("n").to_pylist(), strict=True)), shards)
    runs = np.array(sorted(runs), np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(runs)

    def place(batches):
        for batch in batches:
            found, rank = batch.column("bytes").to_numpy(), batch.column("rank").to_numpy()
            sizes, firsts, bins = shared.value[:, 0], shared.value[:, 1], shared.value[:, 3]
            at = np.searchsorted(sizes, found, "left")
            for _ in range(shards):  # a size has at most a run in each bin
                after = np.minimum(at + 1, len(sizes) - 1)
                at = np.where((sizes[after] == found) & (firsts[after] <= rank), after, at)
            yield pa.record_batch([batch.column("text_key"), batch.column("m"), pa.array(bins[at].astype(np.int32))], names=["text_key", "m", "shard"])

    placed = common.in_python(ranked(groups, ["bytes"], ["text_key"], "rank").select("text_key", "m", "bytes", "rank"), place, "text_key binary, m long, shard int")
    rows = common.with_classes(base, common.keep(placed, "placed"), ["text_key"], sum(counts.column("rows").to_pylist()))
    rows = common.keep(rows.select("doc_id", "size", "text_crc32", "shard"), "rows")
    rows = ranked(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
