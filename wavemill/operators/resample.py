"""Sample-rate conversion of streams held as rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear(samples: DataFrame, stream: str, index: str, value: str, source: int, target: int) -> DataFrame:
    """Linear interpolation: stream, index, value at the target rate; frames * target / source rows, rounded down.

    Each output sample lies between two input samples; both meet it by equi-joins on (stream, index), so a stream is
    spread over all tasks. Beyond the last sample its value is held. Indices of a stream run from 0 without gaps.
    """
    lengths = samples.groupBy(stream).agg((F.max(index) + 1).alias("n"))
    made = lengths.withColumn("m", F.floor(F.col("n") * target / source).cast("long")).filter("m > 0")
    made = made.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    made = made.withColumn("i", F.floor(F.col("j") * source / target).cast("long")).withColumn("frac", F.pmod(F.col("j") * source, F.lit(target)) / float(target))
    x = samples.select(F.col(stream), F.col(index).alias("i"), F.col(value).alias("x0"))
    y = samples.select(F.col(stream), (F.col(index) - 1).alias("i"), F.col(value).alias("x1"))
    out = made.join(x, [stream, "i"]).join(y, [stream, "i"], "left")
    return out.select(stream, F.col("j").alias(index), (F.col("x0") + (F.coalesce("x1", "x0") - F.col("x0")) * F.col("frac")).alias(value))


def kernel(source: int, target: int, zeros: int = 32) -> tuple[np.ndarray, int, int, int]:
    """A windowed-sinc filter bank: rows by phase, and (up, down, half width in input samples)."""
    common = math.gcd(source, target)
    up, down = target // common, source // common
    cut = min(1.0, up / down) * 0.97
    half = math.ceil(zeros / cut)
    t = np.arange(-half + 1, half + 1)[None, :] - (np.arange(up) / up)[:, None]
    window = np.i0(9.0 * np.sqrt(np.clip(1 - (t / half) ** 2, 0, 1))) / np.i0(9.0)
    bank = cut * np.sinc(cut * t) * window
    return bank / bank.sum(axis=1, keepdims=True), up, down, half


def convert(signal: np.ndarray, source: int, target: int, first: int = 0, last: int | None = None, offset: int = 0) -> np.ndarray:
    """Output samples first to last of a stream whose samples from `offset` on are in signal (silence around it).

    A sample depends on its place in the stream alone, so segments of a stream join without a seam.
    """
    if source == target:
        return signal.astype(float)[first - offset : None if last is None else last - offset]
    bank, up, down, half = kernel(source, target)
    if last is None:
        last = len(signal) * target // source
    j = np.arange(first, last, dtype=np.int64)
    centre, phase = j * down // up, j * down % up
    padded = np.concatenate([np.zeros(half), signal, np.zeros(half + 1)])
    at = centre[:, None] + np.arange(-half + 1, half + 1)[None, :] - offset + half
    inside = (at >= 0) & (at < len(padded))
    taps = np.where(inside, padded[np.clip(at, 0, len(padded) - 1)], 0.0)
    return (taps * bank[phase]).sum(axis=1)


def windowed_sinc(samples: DataFrame, stream: str, index: str, value: str, source: int, target: int, segment: int = 65536) -> DataFrame:
    """Band-limited conversion: stream, index, value, held within -1 and 1.

    Streams are cut into segments of output; each gets the input under its filter from both sides and is one task's
    work, so neither a long stream nor a hot one meets in one place. `segment` bounds what a task holds.
    """
    _, up, down, half = kernel(source, target)
    lengths = samples.groupBy(stream).agg((F.max(index) + 1).alias("n"))
    margin = half + 1
    first_of = lambda i: F.floor((i - margin) * up / (down * segment))
    last_of = lambda i: F.floor((i + margin) * up / (down * segment))
    pieces = samples.withColumn("seg", F.explode(F.sequence(F.greatest(F.lit(0), first_of(F.col(index))).cast("long"), F.greatest(F.lit(0), last_of(F.col(index))).cast("long"))))
    pieces = pieces.join(lengths, stream)
    schema = samples.select(stream, index).schema
    types = {f.name: f.dataType.simpleString() for f in schema}

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(index)
        n, seg = int(pdf["n"].iloc[0]), int(pdf["seg"].iloc[0])
        m = n * target // source
        first, last = seg * segment, min(m, (seg + 1) * segment)
        if first >= last:
            return pd.DataFrame({stream: pd.Series([], dtype=object), index: pd.Series([], dtype="int64"), value: pd.Series([], dtype=float)})
        made = np.clip(convert(pdf[value].to_numpy(float), source, target, first, last, int(pdf[index].iloc[0])), -1, 1)
        return pd.DataFrame({stream: pdf[stream].iloc[0], index: np.arange(first, last), value: made})

    return pieces.groupBy(stream, "seg").applyInPandas(run, f"`{stream}` {types[stream]}, `{index}` {types[index]}, `{value}` double")
