"""The chunked and the capped level over unbounded streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavemill.functions.signal import rms_db
from wavemill.operators import chunks


def windowed_db(samples: DataFrame, time: str, value: str, size: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Level of a stream of samples in dB by event-time window; rows later than `late` are dropped by the watermark."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    x = F.col(value)
    return samples.withWatermark(time, late).groupBy(window.alias("w")).agg(F.count("*").alias("n"), rms_db(x * x).alias("db")).select(F.col("w.start").alias("start"), "n", "db")


def overlapped(samples: DataFrame, frame: str, chunk: int = chunks.CHUNK, overlap: int = 4) -> DataFrame:
    """Chunks of a stream of frames: without state, since a frame's number says which chunks hold it."""
    return chunks.explode_chunks(samples, frame, chunk, overlap)


def capped_level(changes: DataFrame, stream: str, order: str, change: str, cap: int) -> DataFrame:
    """stream, order, level after each row: min(cap, level before + change), kept from batch to batch by stream.

    Within a batch rows go by `order`; a row that comes in a later batch than its successors counts where it comes.
    """

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        level = state.get[0] if state.exists else 0
        out = []
        for d in rows[change].tolist():
            level = min(cap, level + int(d))
            out.append(level)
        state.update((level,))
        yield pd.DataFrame({stream: key[0], order: rows[order].to_numpy(), "level": out})

    kinds = dict(changes.dtypes)
    schema = f"`{stream}` {kinds[stream]}, `{order}` {kinds[order]}, level long"
    return changes.groupBy(stream).applyInPandasWithState(fold, schema, "level long", "append", GroupStateTimeout.NoTimeout)
