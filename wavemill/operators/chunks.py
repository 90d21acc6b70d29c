"""Overlapping chunks of ordered frames, and putting their results together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames of a chunk, and the overlap for frames of 1152 samples (4) and of 576 (8).
CHUNK = 128


def overlap_for(frame_size: int, workers: int = 2) -> int:
    return 0 if workers <= 1 else 4 * 1152 // frame_size


def chunk_ids(frame: Column, chunk: int = CHUNK, overlap: int = 4) -> Column:
    """The chunks that hold a frame: chunk c has frames from c * (chunk - overlap) on."""
    stride = chunk - overlap
    first = F.greatest(F.lit(0), F.ceil((frame - (chunk - 1)) / F.lit(float(stride)))).cast("long")
    return F.sequence(first, F.floor(frame / stride).cast("long"))


def explode_chunks(rows: DataFrame, frame: str, chunk: int = CHUNK, overlap: int = 4) -> DataFrame:
    """rows with chunk_id and pos (the frame's place in the chunk), once for each chunk that holds its frame.

    Narrow: no shuffle. Rows with a null frame give none.
    """
    out = rows.withColumn("chunk_id", F.explode(chunk_ids(F.col(frame), chunk, overlap)))
    return out.withColumn("pos", (F.col(frame) - F.col("chunk_id") * (chunk - overlap)).cast("int"))


def discard_overlap(chunked: DataFrame, overlap: int = 4) -> DataFrame:
    """Each frame once again: of every chunk but the first, the first `overlap` frames go."""
    return chunked.filter((F.col("chunk_id") == 0) | (F.col("pos") >= overlap))


def dispatch(chunked: DataFrame, workers: int) -> DataFrame:
    """The worker of each chunk, in turn."""
    return chunked.withColumn("worker", F.pmod(F.col("chunk_id"), F.lit(workers)).cast("int"))


def ranges(total: int, n: int, least: int = 1) -> list[tuple[int, int]]:
    """[0, total) in at most n equal ranges of at least `least`."""
    n = max(1, min(n, total // max(1, least)))
    return [(total * k // n, total * (k + 1) // n) for k in range(n)]


def range_of(position: Column, total: Column, n: int) -> Column:
    """The range that holds a position, where range k is from total * k / n on, rounded down."""
    return F.floor(((position + 1) * n - 1) / total.cast("double")).cast("int")


def deinterleave(rows: DataFrame, index: str, channels: int) -> DataFrame:
    """rows with frame and ch: element i is channel i mod channels of frame i / channels."""
    return rows.withColumns({"frame": F.floor(F.col(index) / channels).cast("long"), "ch": F.pmod(F.col(index), F.lit(channels)).cast("int")})


def interleave(rows: DataFrame, index: str, channels: int) -> DataFrame:
    """The inverse of deinterleave()."""
    return rows.withColumn(index, F.col("frame") * channels + F.col("ch"))
