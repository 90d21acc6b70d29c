"""Statistics of benchmark runs and of test outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.signal import ratio


def bench_stats(runs: DataFrame, key: list[str], audio: float, threads: int) -> DataFrame:
    """One row a key from runs(run, wall, cpu, st_fallback).

    Fallback runs and, of several, the first don't count; where none is left the last run stands in, and is_fallback
    says whether it was one. Processor figures are those of the fastest run, the first of equals. The windows and the
    aggregation share one shuffle by key.
    """
    w = Window.partitionBy(*key)
    several = F.count("*").over(w) > 1
    first, last = F.min("run").over(w), F.max("run").over(w)
    counts = ~F.col("st_fallback") & ~(several & (F.col("run") == first))
    marked = runs.withColumns({"__counts": counts, "__last": F.col("run") == last}).withColumn("__any", F.max(F.col("__counts").cast("int")).over(w) == 1)
    valid = marked.filter(F.col("__counts") | (~F.col("__any") & F.col("__last")))
    best = F.min_by(F.struct("wall", "cpu", "st_fallback"), F.struct("wall", "run"))
    out = valid.groupBy(*key).agg(F.count("*").alias("n_runs"), F.min("wall").alias("wall_min"), F.median("wall").alias("wall_med"), F.avg("wall").alias("wall_mean"), best.alias("best"), F.max(~F.col("__any") & F.col("st_fallback")).alias("is_fallback"))
    wall, cpu = F.col("best.wall"), F.col("best.cpu")
    return out.select(*key, "n_runs", "wall_min", "wall_med", "wall_mean", cpu.alias("best_cpu"), ratio(F.lit(audio), wall).alias("play_wall"), ratio(F.lit(audio), cpu).alias("play_cpu"), ratio(cpu, wall).alias("par_eff"), ratio(100.0 * cpu, wall * threads).alias("par_eff_pct"), "is_fallback")


def stage_total(read: Column, resample: Column, encode: Column, piped: Column) -> Column:
    """Seconds of all stages; reading isn't counted where the input is a pipe."""
    return F.when(piped, F.lit(0.0)).otherwise(read) + resample + encode


def scaling(times: DataFrame, threads: str, seconds: str, audio: float) -> DataFrame:
    """Best time by thread count, speed-up over the smallest count, times real time, and efficiency in percent."""
    best = times.groupBy(threads).agg(F.min(seconds).alias("best"))
    base = best.agg(F.min_by("best", threads).alias("base"))
    speedup = F.col("base") / F.col("best")
    return best.crossJoin(F.broadcast(base)).select(threads, "best", speedup.alias("speedup"), (F.lit(audio) / F.col("best")).alias("realtime"), (100 * speedup / F.col(threads)).alias("efficiency"))


def outcome(code: Column) -> Column:
    """ok for exit code 0, handled for 1, crash for all else."""
    return F.when(code == 0, "ok").when(code == 1, "handled").otherwise("crash")
