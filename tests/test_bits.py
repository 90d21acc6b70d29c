from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill.functions import bits
from wavemill.sources import audio


def _one(spark, data: bytes, *columns):
    return spark.createDataFrame([(bytearray(data),)], "b binary").select(*columns).first()


def test_check_values(spark):
    b = F.col("b")
    assert tuple(_one(spark, b"123456789", bits.crc16_arc(b), bits.crc16_frame(b))) == (0xBB3D, 0xAEE7)
    assert tuple(_one(spark, b"", bits.crc16_arc(b), bits.crc16_frame(b))) == (0, 0xFFFF)
    chained = bits.crc16_arc(F.substring(b, 5, 5), bits.crc16_arc(F.substring(b, 1, 4)))
    assert _one(spark, b"123456789", chained)[0] == 0xBB3D


def test_known_frame(spark):
    w = F.col("w")
    row = spark.createDataFrame([(0xFFFB9064,)], "w long").select(bits.frame_size(w), bits.valid(w), bits.header_length(w), bits.side_info_length(w), bits.sample_rate(w), bits.bitrate(w)).first()
    assert tuple(row) == (417, True, 4, 32, 44100, 128000)


def test_matches_needs_the_same_kind(spark):
    rows = spark.createDataFrame([(0xFFFB9064, 0xFFFB9264), (0xFFFB9064, 0xFFFA9064), (0xFFFB9064, 0xFFFB9464)], "w long, r long")
    assert [r[0] for r in rows.select(bits.matches(F.col("w"), F.col("r"))).collect()] == [True, False, False]


def test_columns_agree_with_the_parser(spark):
    import random

    rng = random.Random(5)
    words = [0xFFE00000 | rng.getrandbits(21) for _ in range(3000)] + [rng.getrandbits(32) for _ in range(200)]
    w = F.col("w")
    got = spark.createDataFrame([(x,) for x in words], "w long").select("w", bits.valid(w).alias("ok"), bits.frame_size(w).alias("size"), bits.side_info_length(w).alias("side")).collect()
    for r in got:
        f = audio.frame_at(r["w"].to_bytes(4, "big"), 0)
        assert r["ok"] == (f is not None)
        if f:
            assert (r["size"], r["side"]) == (f.size, f.side)


def test_main_data_columns_agree_with_the_parser(spark):
    import random

    rng = random.Random(6)
    blobs = []
    while len(blobs) < 60:
        data = (0xFFE00000 | rng.getrandbits(21)).to_bytes(4, "big") + rng.randbytes(60)
        if audio.frame_at(data, 0):
            blobs.append(bytearray(data))
    b, w = F.col("b"), F.conv(F.hex(F.substring("b", 1, 4)), 16, 10).cast("long")
    one, head = bits.mode(w) == 3, bits.header_length(w)
    got = spark.createDataFrame([(x,) for x in blobs], "b binary").select("b", bits.main_data_offset(b, one, head), bits.main_data_length(b, one, bits.mono(w), head)).collect()
    for data, back, length in got:
        assert audio.main_data(bytes(data), audio.frame_at(bytes(data), 0)) == (back, length)


def test_setters_keep_the_rest(spark):
    w = F.col("w")
    row = spark.createDataFrame([(0xFFFB9064,)], "w long").select(bits.with_bitrate_index(w, F.lit(5)), bits.with_padding(w, F.lit(1))).first()
    assert tuple(row) == (0xFFFB5064, 0xFFFB9264)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=200))
def test_parsers_refuse_or_parse(data):
    for head in (b"", b"RIFF\0\0\0\0WAVEfmt ", b"FORM\0\0\0\0AIFF", b"fLaC", b"ID3", b"\xff\xfb\x90\x64"):
        for parse in (audio.parse_wav, audio.parse_aiff, audio.parse_flac_metadata):
            try:
                parse(head + data)
            except audio.Refused:
                pass
            except Exception as e:  # noqa: BLE001
                assert type(e).__name__ == "error", e
        audio.scan(head + data)
        audio.packets(head + data)
