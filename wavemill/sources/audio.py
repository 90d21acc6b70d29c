"""Uncompressed audio, FLAC metadata and MP3 frames from bytes: plain parsers, and DataFrame readers over them."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions.bits import BITRATES_1, BITRATES_2, RATES

#: Fixed limits.
MAX_RATE, MAX_CHANNELS = 384000, 2


class Refused(ValueError):
    """Bytes that aren't the audio asked for, or that go beyond the limits."""


@dataclass
class Clip:
    """A decoded clip: samples by frame and channel, as int16 or as float32."""

    rate: int
    channels: int
    bits: int
    samples: np.ndarray = field(repr=False)

    @property
    def is_float(self) -> bool:
        return self.samples.dtype != np.int16


def _limits(rate: int, channels: int) -> None:
    if not 1 <= channels <= MAX_CHANNELS:
        raise Refused(f"{channels} channels")
    if not 1 <= rate <= MAX_RATE:
        raise Refused(f"{rate} Hz")


def _ints24(data: bytes, big: bool) -> np.ndarray:
    raw = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
    low, mid, high = (raw[:, 2], raw[:, 1], raw[:, 0]) if big else (raw[:, 0], raw[:, 1], raw[:, 2])
    return (high << 24) | (mid << 16) | (low << 8)


def _shape(samples: np.ndarray, channels: int) -> np.ndarray:
    return samples[: len(samples) // channels * channels].reshape(-1, channels)


def _chunks(data: bytes, start: int, order: str) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, size) of each chunk; a size beyond the end is cut, and chunks start at even places."""
    at = start
    while at + 8 <= len(data):
        size = min(struct.unpack_from(order + "I", data, at + 4)[0], len(data) - at - 8)
        yield data[at : at + 4], at + 8, size
        at += 8 + size + size % 2


def parse_wav(data: bytes) -> Clip:
    """PCM of 8, 16, 24 or 32 bits and floats of 32 or 64; extensible headers by their sub-format."""
    if len(data) < 44 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise Refused("not a WAV file")
    head, body = None, None
    for name, at, size in _chunks(data, 12, "<"):
        if name == b"fmt " and size >= 16:
            tag, channels, rate, _, _, depth = struct.unpack_from("<HHIIHH", data, at)
            if tag == 0xFFFE and size >= 26:
                tag = struct.unpack_from("<H", data, at + 24)[0]
            head = tag, channels, rate, depth
        elif name == b"data":
            body = data[at : at + size]
            break
    if head is None or body is None:
        raise Refused("no format or no samples")
    tag, channels, rate, depth = head
    _limits(rate, channels)
    whole = lambda n: body[: len(body) // n * n]
    if (tag, depth) == (1, 8):
        samples = ((np.frombuffer(body, np.uint8).astype(np.int16) - 128) << 8).astype(np.int16)
    elif (tag, depth) == (1, 16):
        samples = np.frombuffer(whole(2), "<i2").astype(np.int16)
    elif (tag, depth) == (1, 24):
        samples = (_ints24(body, False) / 2147483648.0).astype(np.float32)
    elif (tag, depth) == (1, 32):
        samples = (np.frombuffer(whole(4), "<i4") / 2147483648.0).astype(np.float32)
    elif (tag, depth) == (3, 32):
        samples = np.frombuffer(whole(4), "<f4").astype(np.float32)
    elif (tag, depth) == (3, 64):
        with np.errstate(over="ignore"):
            samples = np.frombuffer(whole(8), "<f8").astype(np.float32)
    else:
        raise Refused(f"format {tag} of {depth} bits")
    return Clip(rate, channels, depth, _shape(samples, channels))


def _extended(data: bytes) -> int:
    """An 80-bit extended number, rounded, as a sample rate is written."""
    sign_exponent, mantissa = struct.unpack(">HQ", data)
    power = (sign_exponent & 0x7FFF) - 16383 - 63
    if sign_exponent & 0x8000 or power > 0:
        return -1
    return (mantissa + (1 << -power >> 1)) >> -power if -power < 128 else 0


def parse_aiff(data: bytes) -> Clip:
    """Big-endian PCM of 16 or 24 bits; compressed variants are refused."""
    if len(data) < 12 or data[:4] != b"FORM" or data[8:12] != b"AIFF":
        raise Refused("not an AIFF file")
    head, body = None, None
    for name, at, size in _chunks(data, 12, ">"):
        if name == b"COMM" and size >= 18:
            channels, _, depth = struct.unpack_from(">HIH", data, at)
            head = channels, depth, _extended(data[at + 8 : at + 18])
        elif name == b"SSND" and size >= 8:
            skip = struct.unpack_from(">I", data, at)[0]
            if skip > size - 8:
                raise Refused("samples start beyond their chunk")
            body = data[at + 8 + skip : at + size]
    if head is None or body is None:
        raise Refused("no format or no samples")
    channels, depth, rate = head
    _limits(rate, channels)
    if depth == 16:
        samples = np.frombuffer(body[: len(body) // 2 * 2], ">i2").astype(np.int16)
    elif depth == 24:
        samples = (_ints24(body, True) / 2147483648.0).astype(np.float32)
    else:
        raise Refused(f"{depth} bits")
    return Clip(rate, channels, depth, _shape(samples, channels))


def render_wav(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit file with a header of 44 bytes."""
    samples = np.atleast_2d(samples.T).T.astype("<i2")
    body = samples.tobytes()
    if len(body) + 36 >= 1 << 32:
        raise Refused("more than 4 GB")
    channels = samples.shape[1]
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def parse_flac_metadata(data: bytes) -> dict:
    """Stream info, comments and pictures of a FLAC file; its audio isn't decoded."""
    if data[:4] != b"fLaC":
        raise Refused("not a FLAC file")
    out: dict = {"rate": None, "channels": None, "bits": None, "frames": None, "comments": [], "pictures": []}
    at, last = 4, False
    while not last and at + 4 <= len(data):
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0 and len(body) >= 18:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "frames": packed & (1 << 36) - 1}
        elif kind == 4 and len(body) >= 8:
            p = 4 + struct.unpack_from("<I", body)[0]
            count = struct.unpack_from("<I", body, p)[0] if p + 4 <= len(body) else 0
            p += 4
            for k in range(count):
                if p + 4 > len(body):
                    break
                n = struct.unpack_from("<I", body, p)[0]
                name, eq, value = body[p + 4 : p + 4 + n].decode("utf-8", "replace").partition("=")
                if eq:
                    out["comments"].append((k, name, value))
                p += 4 + n
        elif kind == 6 and len(body) >= 32:
            p, parts = 4, []
            for _ in range(2):
                n = struct.unpack_from(">I", body, p)[0] if p + 4 <= len(body) else 0
                parts.append(body[p + 4 : p + 4 + n])
                p += 4 + n
            p += 16
            n = struct.unpack_from(">I", body, p)[0] if p + 4 <= len(body) else 0
            out["pictures"].append((len(out["pictures"]), struct.unpack_from(">I", body)[0], parts[0].decode("ascii", "replace"), body[p + 4 : p + 4 + n]))
    if out["rate"] is None:
        raise Refused("no stream info")
    _limits(out["rate"], out["channels"])
    if out["bits"] > 24:
        raise Refused(f"{out['bits']} bits")
    if out["frames"] == 0 or out["frames"] > 512 * len(data):
        out["frames"] = None  # unknown, or not plausible
    return out


@dataclass(frozen=True)
class Frame:
    """An MP3 frame's header, read from its bytes."""

    offset: int
    mode: int
    bitrate_index: int
    rate_index: int
    padding: int
    mono: bool
    header: int
    side: int
    size: int

    @property
    def info(self) -> int:
        return self.header + self.side


def frame_at(data: bytes, at: int) -> Frame | None:
    """The frame that starts here, if one does; what is behind its header isn't looked at."""
    if at + 4 > len(data):
        return None
    w = int.from_bytes(data[at : at + 4], "big")
    mode, index, rate = w >> 19 & 3, w >> 12 & 15, w >> 10 & 3
    if w >> 21 != 0x7FF or mode == 1 or w >> 17 & 3 != 1 or index in (0, 15) or rate == 3:
        return None
    mono = w >> 6 & 3 == 3
    size = (144 if mode == 3 else 72) * (BITRATES_1 if mode == 3 else BITRATES_2)[index] // RATES[mode][rate] + (w >> 9 & 1)
    side = (17 if mono else 32) if mode == 3 else (9 if mono else 17)
    return None if size < 24 else Frame(at, mode, index, rate, w >> 9 & 1, mono, 4 if w >> 16 & 1 else 6, side, size)


def tag_size(data: bytes) -> int:
    """Bytes of a leading ID3v2 tag."""
    if len(data) <= 10 or data[:3] != b"ID3":
        return 0
    return 10 + sum((b & 0x7F) << 7 * k for k, b in enumerate(reversed(data[6:10])))


def scan(data: bytes) -> tuple[list[Frame], bool, bool]:
    """(frames, whole, truncated): the chain from the first frame on; whole if it runs to the end without a gap, and
    truncated if its last frame runs over the end."""
    at = tag_size(data)
    while at + 4 < len(data) and frame_at(data, at) is None:
        at += 1
    frames = []
    while at + 4 <= len(data) and (f := frame_at(data, at)):
        frames.append(f)
        at += f.size
    return frames, bool(frames) and at + 4 > len(data), bool(frames) and at > len(data)


def _field(data: bytes, start: int, at: int, n: int) -> int:
    first, skip = divmod(at, 8)
    width = -(-(skip + n) // 8)
    value = int.from_bytes(data[start + first : start + first + width].ljust(width, b"\0"), "big")
    return value >> 8 * width - skip - n & (1 << n) - 1


def main_data(data: bytes, f: Frame) -> tuple[int, int]:
    """(bytes back, length) of a frame's main data."""
    from wavemill.functions.bits import LENGTH_FIELDS

    head = f.offset + f.header
    back = _field(data, head, 0, 9 if f.mode == 3 else 8)
    return back, -(-sum(_field(data, head, at, 12) for at in LENGTH_FIELDS[f.mode == 3, f.mono]) // 8)


def packets(data: bytes) -> list[bytes]:
    """Each frame with its own main data behind its header, gathered from the frames before it, and pointing nowhere back.

    Main data that lies before the first frame reads as zeros. A packet is as long as its frame at least. Its bit-rate
    index is the one that all frames so far share, or 0.
    """
    out, gathered, shared = [], b"", None
    at = 0
    while at + 4 <= len(data):
        f = frame_at(data, at)
        if f is None:
            at += 1
            continue
        body = data[at + f.info : at + f.size]
        back, length = main_data(data, f)
        have = gathered[-back:] if back else b""
        own = (b"\0" * (back - len(have)) + have + body)[:length].ljust(length, b"\0")
        head = bytearray(data[at : at + f.info].ljust(f.info, b"\0"))
        shared = f.bitrate_index if shared in (None, f.bitrate_index) else 0
        head[2] = head[2] & 0x0F | shared << 4
        head[f.header] = 0
        if f.mode == 3:
            head[f.header + 1] &= 0x7F
        out.append((bytes(head) + own).ljust(f.size, b"\0"))
        gathered = (gathered + body)[-512:]
        at += f.size
    return out


#: The text frames of an ID3v2.4 tag by field.
ID3_FRAMES = {"title": b"TIT2", "artist": b"TPE1", "album": b"TALB", "year": b"TDRC", "track": b"TRCK", "genre": b"TCON"}


def _synchsafe(n: int) -> bytes:
    return bytes(n >> 7 * k & 0x7F for k in (3, 2, 1, 0))


def render_id3v2(tags: dict[str, str | None], art: bytes | None = None, mime: str | None = None) -> bytes:
    """An ID3v2.4 tag in UTF-8; empty where there is nothing to say."""
    body = b""
    for name, key in ID3_FRAMES.items():
        if tags.get(name):
            text = b"\x03" + tags[name].encode()
            body += key + _synchsafe(len(text)) + b"\0\0" + text
    if tags.get("comment"):
        text = b"\x03eng\0" + tags["comment"].encode()
        body += b"COMM" + _synchsafe(len(text)) + b"\0\0" + text
    if art:
        text = b"\0" + (mime or "image/jpeg").encode() + b"\0\x03\0" + art
        body += b"APIC" + _synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _synchsafe(len(body)) + body if body else b""


def render_id3v1(tags: dict[str, str | None]) -> bytes:
    """An ID3v1.1 tag of 128 bytes in Latin-1; empty where there is nothing to say. Named genres aren't written."""
    if not any(tags.values()):
        return b""
    cut = lambda name, n: (tags.get(name) or "").encode("latin-1", "replace")[:n].ljust(n, b"\0")
    track = int(t) if (t := (tags.get("track") or "").split("/")[0]).isdigit() and int(t) < 256 else 0
    return b"TAG" + cut("title", 30) + cut("artist", 30) + cut("album", 30) + cut("year", 4) + cut("comment", 28) + bytes([0, track, 255])


# DataFrames


CLIPS = "path string, container string, rate int, channels int, bits int, is_float boolean, n_frames long, error string"
SAMPLES = "path string, frame long, ch int, s16 short, f32 float"


def _parsed(content: bytes) -> tuple[str | None, Clip]:
    if content[:4] == b"FORM":
        return "aiff", parse_aiff(content)
    if content[:4] == b"fLaC":
        raise Refused("FLAC audio isn't decoded")
    return "wav", parse_wav(content)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, length, content); content is read only where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def clips(files: DataFrame) -> DataFrame:
    """One row a file(path, content): its format, or the error for which it was refused."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    kind, c = _parsed(bytes(content or b""))
                    rows.append((path, kind, c.rate, c.channels, c.bits, c.is_float, len(c.samples), None))
                except (Refused, struct.error) as e:
                    rows.append((path, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "container", "rate", "channels", "bits", "is_float", "n_frames", "error"]).astype({"rate": "Int32", "channels": "Int32", "bits": "Int32", "n_frames": "Int64"})

    return files.select("path", "content").mapInPandas(run, CLIPS)


def samples(files: DataFrame, block: int = 1 << 16) -> DataFrame:
    """A row for each sample of each file that parses; 16-bit samples in s16, others in f32. Blocks bound a batch."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    _, c = _parsed(bytes(content or b""))
                except (Refused, struct.error):
                    continue
                for at in range(0, len(c.samples), block):
                    part = c.samples[at : at + block]
                    n, channels = part.shape
                    flat = part.reshape(-1)
                    none = pd.Series([None] * len(flat))
                    yield pd.DataFrame({"path": path, "frame": np.repeat(np.arange(at, at + n), channels), "ch": np.tile(np.arange(channels, dtype=np.int32), n), "s16": none.astype("Int16") if c.is_float else pd.Series(flat).astype("Int16"), "f32": flat.astype(np.float32) if c.is_float else none.astype("Float32")})

    return files.select("path", "content").mapInPandas(run, SAMPLES)


def frames(files: DataFrame) -> DataFrame:
    """Frame table of MP3 files(path, content): a row for each frame of the chain, with whole and truncated."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found, whole, truncated = scan(bytes(content or b""))
                yield pd.DataFrame([(path, k, f.offset, f.size, f.mode, f.bitrate_index, f.rate_index, f.padding, f.mono, whole, truncated) for k, f in enumerate(found)], columns=["path", "k", "offset", "size", "mode", "bitrate_index", "rate_index", "padding", "mono", "whole", "truncated"])

    return files.select("path", "content").mapInPandas(run, "path string, k int, offset long, size int, mode int, bitrate_index int, rate_index int, padding int, mono boolean, whole boolean, truncated boolean")


def flac_metadata(files: DataFrame) -> DataFrame:
    """Stream info, comments and pictures of FLAC files(path, content), or the error."""
    schema = "path string, rate int, channels int, bits int, frames long, comments array<struct<ordinal: int, key: string, value: string>>, pictures array<struct<ordinal: int, kind: int, mime: string, data: binary>>, error string"

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    m = parse_flac_metadata(row["content"] or b"")
                    rows.append({"path": row["path"], **{k: m[k] for k in ("rate", "channels", "bits", "frames")}, "comments": [dict(zip(("ordinal", "key", "value"), c, strict=True)) for c in m["comments"]], "pictures": [dict(zip(("ordinal", "kind", "mime", "data"), p, strict=True)) for p in m["pictures"]], "error": None})
                except (Refused, struct.error) as e:
                    rows.append({"path": row["path"], "rate": None, "channels": None, "bits": None, "frames": None, "comments": [], "pictures": [], "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def assemble_mp3(streams: DataFrame, tag: str = "id3v2", body: str = "body", tail: str = "id3v1") -> DataFrame:
    """streams with content: tag, stream and trailing tag, one after the other; missing parts are empty."""
    empty = F.lit(b"")
    return streams.withColumn("content", F.concat(*(F.coalesce(F.col(c), empty) for c in (tag, body, tail))))


def unpack(files: DataFrame) -> DataFrame:
    """Packets of MP3 files(path, content), as packets() makes them: path, k, packet. A stream is one row, and so one task's work."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = packets(content.as_py() or b"")
                for at in range(0, len(found), 4096):
                    part = found[at : at + 4096]
                    yield pa.record_batch([pa.array([path] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int32()), pa.array(part, pa.binary())], names=["path", "k", "packet"])

    return files.select("path", "content").mapInArrow(run, "path string, k int, packet binary")


def wav_contents(samples_: DataFrame, rate: int) -> DataFrame:
    """16-bit files of samples(path, frame, ch, s16): path, content. A clip is one task's work, 4 GB at most."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["frame", "ch"])
        made = render_wav(pdf["s16"].to_numpy(np.int16).reshape(-1, int(pdf["ch"].max()) + 1), rate)
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [made]})

    return samples_.filter("s16 is not null").select("path", "frame", "ch", "s16").groupBy("path").applyInPandas(run, "path string, content binary")


def with_tags(rows: DataFrame) -> DataFrame:
    """rows(path, title, artist, album, year, comment, track, genre) with id3v2 and id3v1, rendered; null fields are missing."""
    import pyarrow as pa

    names = ("title", "artist", "album", "year", "comment", "track", "genre")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "id3v2 binary, id3v1 binary"])

    def run(batches):
        for batch in batches:
            tags = [dict(zip(names, values, strict=True)) for values in zip(*(batch.column(c).to_pylist() for c in names), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array([render_id3v2(t) for t in tags], pa.binary()), pa.array([render_id3v1(t) for t in tags], pa.binary())], names=[*batch.schema.names, "id3v2", "id3v1"])

    return rows.mapInArrow(run, schema)


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """One file a row in a folder that all executors reach, written by the tasks; a file appears when it is whole, and a
    task that is run again writes the same file again."""
    import pyarrow as pa

    def run(batches):
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for file, data in zip(batch.column(name).to_pylist(), batch.column(content), strict=True):
                part = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data.as_py() or b"")
                store.move(part, f"{base}/{file}")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    folder = folder if "://" in folder else folder.replace("file:", "", 1) if folder.startswith("file:") else folder
    rows.select(name, content).mapInArrow(run, "n long").agg({"n": "sum"}).collect()


_scratch: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """A new folder's name in the one that all executors share; without one, in a temporary folder, on one machine only."""
    import tempfile
    import uuid

    if base := spark.conf.get("spark.checkpoint.dir", None):
        return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _scratch:
        _scratch.append(tempfile.mkdtemp(prefix="files-"))
    return f"{_scratch[0]}/{uuid.uuid4().hex}"
