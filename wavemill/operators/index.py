"""Frame tables: seek tables, chain checks, stream summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions import bits


def offsets(frames: DataFrame, stream: list[str], order: list[str], size: str) -> DataFrame:
    """frames with offset, the bytes before each in its stream, and k, its number from 0."""
    w = Window.partitionBy(*stream).orderBy(*order)
    before = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return frames.withColumns({"offset": F.coalesce(before, F.lit(0)), "k": F.row_number().over(w) - 1})


def toc(frames: DataFrame, stream: list[str], size: str, entries: int = 100) -> DataFrame:
    """A seek table of each stream, from rows with offset and k: entry i points at frame n * i / entries.

    Rows: stream, i, value in 1/256ths of the stream's bytes, at most 255. Streams without frames or bytes have none.
    """
    totals = frames.groupBy(*stream).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).filter("bytes > 0")
    wanted = totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(entries - 1)))).withColumn("k", F.floor(F.col("n") * F.col("i") / entries).cast("int"))
    found = wanted.join(frames.select(*stream, "k", "offset"), [*stream, "k"])
    return found.select(*stream, "i", F.least(F.lit(255), F.floor(256.0 * F.col("offset") / F.col("bytes"))).cast("int").alias("value"))


def padding_samples(frames: Column, samples: Column, delay: Column | int, is_1: Column | bool = True) -> Column:
    """Samples at a stream's end that are none of the input's."""
    per = F.when(F.lit(is_1) if isinstance(is_1, bool) else is_1, 1152).otherwise(576)
    return frames * per - samples - delay


def constant_rate(index: str) -> Column:
    """The one bit-rate index of a stream, 0 where it varies."""
    return F.when(F.min(index) == F.max(index), F.min(index)).otherwise(F.lit(0))


def rate_bounds(low: int, high: int, is_1: bool = True) -> tuple[int, int]:
    """The lowest index of at least `low` bit/s (14 if none) and the highest of at most `high` (1 if none)."""
    table = bits.BITRATES_1 if is_1 else bits.BITRATES_2
    return next((i for i in range(1, 15) if table[i] >= low), 14), next((i for i in range(14, 0, -1) if table[i] <= high), 1)


def rate_indices(low: Column, high: Column, is_1: Column) -> tuple[Column, Column]:
    """rate_bounds() as columns."""
    numbers = F.sequence(F.lit(1), F.lit(14))
    rate = lambda i: F.get(F.when(is_1, F.array(*map(F.lit, bits.BITRATES_1))).otherwise(F.array(*map(F.lit, bits.BITRATES_2))), i)
    return F.coalesce(F.array_min(F.filter(numbers, lambda i: rate(i) >= low)), F.lit(14)), F.coalesce(F.array_max(F.filter(numbers, lambda i: rate(i) <= high)), F.lit(1))


def chain_breaks(frames: DataFrame, stream: list[str], order: list[str], offset: str, size: str) -> DataFrame:
    """frames with linked: whether the frame before ends just here (for the first of a stream: whether it is at 0)."""
    before = F.lag(F.col(offset) + F.col(size)).over(Window.partitionBy(*stream).orderBy(*order))
    return frames.withColumn("linked", F.col(offset) == F.coalesce(before, F.lit(0)))


def preceded(frames: DataFrame, stream: list[str], offset: str, size: str) -> DataFrame:
    """The frames at which some frame of their stream ends."""
    ends = frames.select(*stream, (F.col(offset) + F.col(size)).alias(offset)).distinct()
    return frames.join(ends, [*stream, offset], "left_semi")


def heal(frames: DataFrame, fallback: DataFrame, stream: list[str], ok: str) -> DataFrame:
    """Streams of `frames` whose rows are all ok, and those of `fallback` for the others."""
    good = frames.groupBy(*stream).agg(F.min(F.col(ok).cast("int")).alias("__good")).filter("__good = 1").select(*stream)
    return frames.join(good, stream, "left_semi").unionByName(fallback.join(good, stream, "left_anti"))
