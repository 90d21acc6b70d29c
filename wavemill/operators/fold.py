"""Running levels with a cap: a bit reservoir's accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a reservoir holds at most, in bytes, for MPEG-1 and for MPEG-2 and 2.5.
CAP_1, CAP_2 = 511, 255


def capped_level(rows: DataFrame, stream: list[str], order: list[str], change: str, cap: Column | int) -> DataFrame:
    """rows with level: min(cap, level before + change), from 0, in order within each stream.

    In closed form by two running windows over one sort: with S the running sum, level = S - max(0, max so far of
    (S - cap)). So a stream of any length needs no more memory than its sort.
    """
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("__s", F.sum(change).over(w))
    over = F.max(F.col("__s") - cap).over(w)
    return out.withColumn("level", F.col("__s") - F.greatest(F.lit(0), over)).drop("__s")


def fold_level(rows: DataFrame, stream: list[str], order: list[str], change: str, cap: int) -> DataFrame:
    """The last level of each stream where it is also held at 0 or above: an ordered fold over each stream.

    A stream is one row here; for long streams without a floor use capped_level().
    """
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(change).cast("long").alias("__d"))))
    level = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: F.least(F.lit(cap).cast("long"), F.greatest(F.lit(0).cast("long"), a + x["__d"])))
    return rows.groupBy(*stream).agg(level.alias("level"), F.count("*").alias("n"))


def excess(total: Column, threshold: Column | int) -> Column:
    """What is to be filled with padding: how far a total is above its threshold."""
    return F.greatest(F.lit(0), total - threshold)
