import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.sources import audio, datasource


def wav(samples: np.ndarray, rate=44100, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples.astype(f"<i{width}").tobytes())
    return out.getvalue()


def riff(tag, channels, rate, depth, body, extra=b"", sub=None):
    fmt = struct.pack("<HHIIHH", tag, channels, rate, 0, 0, depth) + (b"\x16\0" + b"\0" * 6 + struct.pack("<H", sub) + b"\0" * 14 if sub else b"")
    inner = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(inner)) + inner


def aiff(body, depth=16, channels=1, rate=44100, kind=b"AIFF"):
    exponent = rate.bit_length() - 1
    ext = struct.pack(">HQ", 16383 + exponent, rate << 63 - exponent)
    comm = struct.pack(">HIH", channels, 0, depth) + ext
    inner = kind + b"COMM" + struct.pack(">I", 18) + comm + b"SSND" + struct.pack(">I", 8 + len(body)) + b"\0" * 8 + body
    return b"FORM" + struct.pack(">I", len(inner)) + inner


TONE = (np.sin(np.arange(2000) / 7)[:, None] * [12000, -9000]).astype(np.int16)


def test_wav_as_the_library_writes_it():
    clip = audio.parse_wav(wav(TONE))
    assert (clip.rate, clip.channels, clip.bits, clip.is_float) == (44100, 2, 16, False)
    assert (clip.samples == TONE).all()
    assert audio.render_wav(clip.samples, 44100) == wav(TONE)


@pytest.mark.parametrize(
    "data, want",
    [
        (riff(1, 1, 8000, 8, b"\x00\x80\xff" + b"\x80"), [-32768, 0, 32512, 0]),
        (riff(1, 1, 8000, 24, b"\xff\xff\x7f\x00\x00\x80"), [8388607 / 8388608, -1.0]),
        (riff(1, 1, 8000, 32, struct.pack("<ii", -(2**31), 2**30)), [-1.0, 0.5]),
        (riff(3, 1, 8000, 32, struct.pack("<ff", 2.5, -0.25)), [2.5, -0.25]),
        (riff(3, 1, 8000, 64, struct.pack("<dd", 0.125, -3.0)), [0.125, -3.0]),
        (riff(0xFFFE, 1, 8000, 16, struct.pack("<hh", 5, -6), sub=1), [5, -6]),
        (riff(1, 1, 8000, 16, struct.pack("<hh", 5, -6), extra=b"odd \x03\0\0\0abc\0"), [5, -6]),
        (aiff(struct.pack(">hh", 7, -8)), [7, -8]),
        (aiff(b"\x7f\xff\xff\x80\x00\x00", 24), [8388607 / 8388608, -1.0]),
    ],
)
def test_formats(data, want):
    clip = audio._parsed(data)[1]
    assert clip.samples[:, 0].tolist() == pytest.approx(want, abs=1e-6)


def test_a_size_beyond_the_end_is_cut():
    data = bytearray(riff(1, 1, 8000, 16, struct.pack("<hhhh", 1, 2, 3, 4)))
    data[40:44] = struct.pack("<I", 1 << 30)
    assert audio.parse_wav(bytes(data)).samples[:, 0].tolist() == [1, 2, 3, 4]


@pytest.mark.parametrize(
    "data",
    [b"", b"RIFF", riff(1, 3, 8000, 16, b"\0" * 12), riff(1, 1, 0, 16, b"\0" * 8), riff(1, 1, 384001, 16, b"\0" * 8), riff(1, 1, 8000, 12, b"\0" * 8), riff(2, 1, 8000, 16, b"\0" * 8), aiff(b"\0\0", kind=b"AIFC"), aiff(b"\0\0\0", 8), b"fLaC" + b"\0" * 60],
)
def test_refused(data):
    with pytest.raises(audio.Refused):
        audio._parsed(data)


def test_files_as_tables(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(TONE))
    (tmp_path / "b.aiff").write_bytes(aiff(struct.pack(">hhh", 1, 2, 3)))
    (tmp_path / "c.bin").write_bytes(b"nothing")
    files = audio.read_files(spark, str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in audio.clips(files).collect()}
    assert (rows["a.wav"]["n_frames"], rows["b.aiff"]["container"], rows["c.bin"]["rate"]) == (2000, "aiff", None)
    assert rows["c.bin"]["error"]
    got = audio.samples(files, block=300).filter("path like '%a.wav'").orderBy("frame", "ch").collect()
    assert [r["s16"] for r in got] == TONE.reshape(-1).tolist()
    datasource.register(spark)
    assert spark.read.format("wavemill_audio").load(str(tmp_path)).count() == 4003


def test_written_files_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("x.wav", bytearray(wav(TONE)))], "name string, content binary")
    audio.write_files(rows, str(tmp_path / "out"))
    assert (tmp_path / "out/x.wav").read_bytes() == wav(TONE)


def flac(comments=(), pictures=(), rate=44100, channels=2, depth=16, frames=1000):
    packed = rate << 44 | (channels - 1) << 41 | (depth - 1) << 36 | frames
    blocks = [(0, b"\0" * 10 + packed.to_bytes(8, "big") + b"\0" * 16)]
    text = struct.pack("<I", 0) + struct.pack("<I", len(comments)) + b"".join(struct.pack("<I", len(c)) + c for c in comments)
    blocks.append((4, text))
    for kind, mime, data in pictures:
        blocks.append((6, struct.pack(">II", kind, len(mime)) + mime + struct.pack(">I", 0) + b"\0" * 16 + struct.pack(">I", len(data)) + data))
    return b"fLaC" + b"".join(bytes([k | (0x80 if n == len(blocks) - 1 else 0)]) + len(b).to_bytes(3, "big") + b for n, (k, b) in enumerate(blocks))


def test_flac_metadata(spark):
    data = flac([b"TITLE=a", b"title=b", b"ARTIST=\xc3\xa9", b"none"], [(4, b"image/png", b"back"), (3, b"image/jpeg", b"front")])
    m = audio.parse_flac_metadata(data)
    assert (m["rate"], m["channels"], m["bits"], m["frames"]) == (44100, 2, 16, 1000)
    assert [c[1:] for c in m["comments"]] == [("TITLE", "a"), ("title", "b"), ("ARTIST", "é")]
    assert audio.parse_flac_metadata(flac(frames=10**9))["frames"] is None
    with pytest.raises(audio.Refused):
        audio.parse_flac_metadata(flac(depth=32))
    from wavemill.operators import meta

    table = audio.flac_metadata(spark.createDataFrame([("f", bytearray(data)), ("g", bytearray(b"x"))], "path string, content binary"))
    tags = meta.project_comments(table.select("path", F.explode("comments").alias("c")).select("path", "c.*"), "path", "key", "value", "ordinal").collect()
    assert [(t["title"], t["artist"], t["year"]) for t in tags] == [("b", "é", None)]
    best = meta.pick_picture(table.select("path", F.explode("pictures").alias("p")).select("path", "p.*"), "path", "kind", "ordinal").collect()
    assert [bytes(r["data"]) for r in best] == [b"front"]


def frame(main=b"", back=0, pad=0, length=0, size=417):
    side = bytearray(32)
    side[0], side[1] = back >> 1, (back & 1) << 7
    bits = length * 8
    side[2] |= bits >> 8
    side[3] = bits & 0xFF
    return (bytes([0xFF, 0xFB, 0x90 | 0, 0x64 if not pad else 0x64]) + bytes(side) + main).ljust(size, b"\0")


def test_frame_chain():
    good = frame() * 5
    frames, whole, truncated = audio.scan(b"ID3\4\0\0\0\0\0\5hello" + b"junk" + good)
    assert (len(frames), whole, truncated) == (5, True, False)
    assert audio.scan(good[:-10])[1:] == (True, True)
    assert audio.scan(good[:417] + b"x" * 417)[1] is False
    assert audio.scan(b"")[0] == []


def test_packets_gather_main_data():
    data = frame(b"AB" + b"." * 377 + b"CD") + frame(b"EF", back=2, length=4)
    found = audio.packets(data)
    assert [len(p) for p in found] == [417, 417]
    assert found[1][36:40] == b"CDEF"
    assert audio.main_data(found[1], audio.frame_at(found[1], 0))[0] == 0


def test_id3():
    tags = {"title": "Ü", "artist": "b", "track": "3/9", "comment": "c"}
    v2, v1 = audio.render_id3v2(tags, b"\xff\xd8\xff", "image/jpeg"), audio.render_id3v1(tags)
    assert audio.tag_size(v2) == len(v2) and b"APIC" in v2
    assert len(v1) == 128 and v1[126] == 3
    assert audio.render_id3v2({}) == b"" == audio.render_id3v1({})


def test_assemble(spark):
    row = spark.createDataFrame([(bytearray(b"T"), bytearray(b"B"), None)], "id3v2 binary, body binary, id3v1 binary")
    assert bytes(audio.assemble_mp3(row).first()["content"]) == b"TB"
