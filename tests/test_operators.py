import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import signal
from wavemill.operators import chunks, fold, index, meta, resample, runs
from wavemill.plans import options


@pytest.mark.parametrize("n", [0, 1, 3, 4, 127, 128, 129, 252, 253, 1000])
@pytest.mark.parametrize("overlap", [0, 4, 8])
def test_chunks_cover_and_discard_restores(spark, n, overlap):
    rows = chunks.explode_chunks(spark.range(n).withColumnRenamed("id", "frame"), "frame", overlap=overlap)
    got = {(r["chunk_id"], r["pos"]): r["frame"] for r in rows.collect()}
    stride = 128 - overlap
    want = {(c, f - c * stride): f for f in range(n) for c in range(n // stride + 1) if 0 <= f - c * stride < 128}
    assert got == want
    assert sorted(r["frame"] for r in chunks.discard_overlap(rows, overlap).collect()) == list(range(n))


def test_ranges_are_disjoint_and_whole(spark):
    for total in (0, 1, 6, 7, 100, 65536):
        parts = chunks.ranges(total, 7)
        assert [a for a, _ in parts] == [0, *(b for _, b in parts[:-1])] and parts[-1][1] == total
    assert len(chunks.ranges(100, 7, 60)) == 1
    rows = spark.range(100).select(chunks.range_of(F.col("id"), F.lit(100), 7).alias("p")).groupBy("p").count().collect()
    assert {r["p"]: r["count"] for r in rows} == {k: b - a for k, (a, b) in enumerate(chunks.ranges(100, 7))}


def test_levels_match_a_loop(spark):
    rng = random.Random(2)
    data = [(s, k, rng.randint(-300, 300)) for s in range(5) for k in range(200)]
    df = spark.createDataFrame(data, "s int, k int, d long")
    got = {(r["s"], r["k"]): r["level"] for r in fold.capped_level(df, ["s"], ["k"], "d", 511).collect()}
    last = {r["s"]: r["level"] for r in fold.fold_level(df, ["s"], ["k"], "d", 511).collect()}
    for s in range(5):
        level = held = 0
        for _, k, d in (x for x in data if x[0] == s):
            level, held = min(511, level + d), min(511, max(0, held + d))
            assert got[s, k] == level
        assert last[s] == held


def test_nearest_rate(spark):
    cases = {44100: 44100, 88200: 44100, 96000: 48000, 66150: 22050, 72000: 24000, 44101: 44100, 9512: 8000, 9513: 11025, 38050: 32000, 1: 8000, 384000: 48000}
    rows = spark.createDataFrame([(k,) for k in cases], "r int").select("r", signal.nearest_rate(F.col("r")).alias("n")).collect()
    assert {r["r"]: r["n"] for r in rows} == cases


def test_silence_and_saturation(spark):
    assert spark.createDataFrame([(0.0,), (0.0,)], "e double").agg(signal.rms_db(F.col("e"))).first()[0] == -999
    assert spark.createDataFrame([], "e double").agg(signal.rms_db(F.col("e"))).first()[0] == -999
    rows = spark.createDataFrame([(1e9,), (-1e9,), (0.5,), (-0.5,)], "x double").select(signal.saturate16(F.col("x"))).collect()
    assert [r[0] for r in rows] == [32767, -32768, 1, 0]


def test_output_rate(spark):
    df = spark.createDataFrame([(16100, 32000, 44100), (None, 32000, 44100), (None, None, 88200)], "a int, e int, s int")
    assert [r[0] for r in df.select(signal.output_rate(F.col("a"), F.col("e"), F.col("s"))).collect()] == [16000, 32000, 44100]


def test_bench_rules(spark):
    data = [("a", 1, 9.0, 1.0, False), ("a", 2, 4.0, 5.0, False), ("a", 3, 4.0, 6.0, False), ("b", 1, 7.0, 7.0, True), ("b", 2, 8.0, 8.0, True), ("c", 1, 3.0, 0.0, False)]
    rows = {r["k"]: r for r in runs.bench_stats(spark.createDataFrame(data, "k string, run int, wall double, cpu double, st_fallback boolean"), ["k"], 120.0, 4).collect()}
    assert (rows["a"]["n_runs"], rows["a"]["best_cpu"], rows["a"]["wall_med"]) == (2, 5.0, 4.0)
    assert (rows["b"]["wall_min"], rows["b"]["is_fallback"]) == (8.0, True)
    assert (rows["c"]["n_runs"], rows["c"]["play_cpu"], rows["c"]["is_fallback"]) == (1, 0.0, False)


def test_sniffing(spark):
    blobs = {"wav": b"RIFF\0\0\0\0WAVE" + b"\0" * 32, None: b"RIFF\0\0\0\0WAVE", "aiff": b"FORM\0\0\0\0AIFF", "flac": b"fLaC", "mp3": b"ID3"}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()], "k string, b binary").select("k", meta.container(F.col("b")).alias("c")).collect()
    assert all(r["k"] == r["c"] for r in rows)
    pics = spark.createDataFrame([(bytearray(b"\xff\xd8\xff"),), (bytearray(b"\x89PNG\r\n\x1a\n"),), (bytearray(b"GIF8"),), (bytearray(b""),), (bytearray(b"\xff\xe3"),)], "b binary")
    assert [r[0] for r in pics.select(meta.cover_type(F.col("b"))).collect()] == ["image/jpeg", "image/png", None, None, None]
    assert [r[0] for r in pics.select(meta.mp3_like(F.col("b"))).collect()] == [False, False, False, False, True]


def test_admission(spark):
    df = spark.createDataFrame([(100, 24, True), (100, 16, False)], "n long, d int, r boolean")
    assert [r[0] for r in df.select(meta.peak_memory(F.col("n"), F.col("d"), F.col("r"))).collect()] == [568, 235]
    assert [r[0] for r in spark.createDataFrame([(5,), (4,), (3,)], "e long").select(meta.admission(F.col("e"), 4)).collect()] == ["refuse", "warn", "go"]


def test_toc_of_nothing(spark):
    assert index.toc(spark.createDataFrame([], "s int, k int, offset long, size long"), ["s"], "size").count() == 0


def test_rate_bounds():
    assert index.rate_bounds(8000, 320000) == (1, 14)
    assert index.rate_bounds(33000, 100000) == (2, 7)
    assert index.rate_bounds(10**6, 1) == (14, 1)


def test_resampling_keeps_a_tone_and_has_no_seams(spark):
    n, source, target = 6000, 44100, 48000
    x = np.sin(2 * np.pi * 997 * np.arange(n) / source) * 0.5
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)], "s string, i long, v double")
    out = resample.windowed_sinc(df, "s", "i", "v", source, target, segment=1000).orderBy("i").collect()
    y = np.array([r["v"] for r in out])
    assert [r["i"] for r in out] == list(range(n * target // source))
    want = np.sin(2 * np.pi * 997 * np.arange(len(y)) / target) * 0.5
    middle = slice(200, -200)
    assert 20 * np.log10(np.sqrt(np.mean((y - want)[middle] ** 2)) / 0.35) < -60
    assert np.abs(y - resample.convert(x, source, target)).max() < 1e-12


@pytest.mark.parametrize("n", [1, 2, 5])
def test_resampling_short_streams(spark, n):
    df = spark.createDataFrame([("s", k, 1.0) for k in range(n)], "s string, i long, v double")
    for source, target in ((44100, 16000), (8000, 48000)):
        assert resample.windowed_sinc(df, "s", "i", "v", source, target).count() == n * target // source
        assert resample.linear(df, "s", "i", "v", source, target).count() == n * target // source


def test_self_heal_prefers_whole_streams(spark):
    a = spark.createDataFrame([(1, True, "p"), (1, True, "p"), (2, True, "p"), (2, False, "p")], "s int, ok boolean, w string")
    b = spark.createDataFrame([(1, True, "q"), (2, True, "q")], "s int, ok boolean, w string")
    assert sorted((r["s"], r["w"]) for r in index.heal(a, b, ["s"], "ok").collect()) == [(1, "p"), (1, "p"), (2, "q")]


def test_options():
    job = options.parse(["in.wav", "out.mp3", "-V", "2", "-t", "4", "-V", "6", "--resample", "44.1"])
    assert (job.mode, job.vbr, job.threads, job.resample) == ("vbr", 60, 4, 44100)
    assert options.parse(["a", "--preset", "192"]).abr == 192
    assert options.parse(["a", "--bench"]).bench == 1
    for bad in (["a", "-bogus"], ["a", "-b", "999"], ["a", "b", "c"], ["a", "--preset", "loud"], ["a", "--bench=0"]):
        with pytest.raises((SystemExit, Exception)):
            options.parse(bad)
