"""Container sniffing, tags, cover pictures, and encoder settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions import bits

#: Tag fields, and the names of Vorbis comments that fill them.
FIELDS = ("title", "artist", "album", "year", "comment", "track", "genre")
VORBIS = {"TITLE": "title", "ARTIST": "artist", "ALBUM": "album", "DATE": "year", "COMMENT": "comment", "TRACKNUMBER": "track", "GENRE": "genre"}

#: Named encoder settings; variable-rate qualities are in tenths, constant rates in kbit/s.
PRESETS = {"medium": ("vbr", 40), "standard": ("vbr", 20), "extreme": ("vbr", 0), "insane": ("cbr", 320)}

#: Bytes of art from which a v2 tag is written in any case, and from which a note is due.
LARGE_ART, NOTED_ART = 128 * 1024, 512 * 1024


def _starts(content: Column, *at: tuple[int, str]) -> Column:
    test = F.lit(True)
    for offset, text in at:
        test = test & (F.hex(F.substring(content, offset + 1, len(text))) == text.encode("latin-1").hex().upper())
    return test


def container(content: Column) -> Column:
    """aiff, flac, wav, mp3 or null, by leading bytes, in this order; a WAV file has 44 bytes or more."""
    out = F.when(_starts(content, (0, "FORM"), (8, "AIFF")), "aiff").when(_starts(content, (0, "fLaC")), "flac")
    out = out.when(_starts(content, (0, "RIFF"), (8, "WAVE")) & (F.octet_length(content) >= 44), "wav")
    return out.when(mp3_like(content), "mp3")


def mp3_like(content: Column) -> Column:
    """Not a RIFF/WAVE file, and headed by a tag or by eleven set bits."""
    synced = (bits.byte_at(content, 0) == 0xFF) & (bits.byte_at(content, 1) >= 0xE0)
    return F.coalesce(~_starts(content, (0, "RIFF"), (8, "WAVE")) & (_starts(content, (0, "ID3")) | synced), F.lit(False))


def cover_type(content: Column) -> Column:
    """image/jpeg, image/png or null."""
    return F.when(_starts(content, (0, "\xff\xd8\xff")), "image/jpeg").when(_starts(content, (0, "\x89PNG\r\n\x1a\n")), "image/png")


def kind_of_text(content: Column) -> Column:
    """container() or cover_type(), else html for markup, else other."""
    return F.coalesce(container(content), cover_type(content), F.when(_starts(content, (0, "<")), "html"), F.lit("other"))


def merge_tags(own: Column, embedded: Column) -> Column:
    """A field given by hand, unless it is empty, before the file's own; null where neither is there."""
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(embedded, F.lit("")))


def project_comments(comments: DataFrame, file: str, key: str, value: str, ordinal: str) -> DataFrame:
    """Vorbis comments as one row a file with the seven fields; keys in any case, the last of equal keys wins."""
    upper = F.upper(key)
    return comments.groupBy(file).agg(*(F.max_by(F.when(upper == name, F.col(value)), F.when(upper == name, F.col(ordinal))).alias(field) for name, field in VORBIS.items()))


def pick_picture(pictures: DataFrame, file: str, kind: str, ordinal: str) -> DataFrame:
    """One picture a file: the first front cover (type 3), else the first of all."""
    rank = F.struct((F.col(kind) != 3).alias("other"), F.col(ordinal).alias("ordinal"))
    names = pictures.columns
    best = F.min_by(F.struct(*names), rank)
    return pictures.groupBy(F.col(file).alias("__file")).agg(best.alias("best")).select("best.*")


def cover(own: Column, embedded: Column) -> Column:
    """The art to embed: by hand before embedded, if it is a JPEG or PNG picture."""
    art = F.coalesce(own, embedded)
    return F.when(cover_type(art).isNotNull(), art)


def needs_v2(size: Column, asked: Column) -> Column:
    return asked | F.coalesce(size > LARGE_ART, F.lit(False))


def plausible_frames(frames: Column, size: Column) -> Column:
    """A claimed number of frames, null (unknown) where it is above 512 times the file's bytes."""
    return F.when(frames <= 512 * size, frames)


def peak_memory(size: Column, depth: Column, resampled: Column) -> Column:
    """Bytes that encoding a file may take: input, samples, scratch of a resampler, and output."""
    samples = F.when(depth == 24, 4.0 / 3.0).otherwise(1.0)
    return F.floor(size * (1.35 + samples + F.when(resampled, 3.0).otherwise(0.0))).cast("long")


def admission(estimate: Column, available: Column | int) -> Column:
    """refuse above what is available, warn above three quarters of it, else go."""
    available = F.lit(available) if isinstance(available, int) else available
    return F.when(estimate > available, "refuse").when(estimate * 4 > available * 3, "warn").otherwise("go")


def preset(name: Column) -> Column:
    """Encoder settings of a preset, a struct of mode and value; null for an unknown one."""
    rate = name.try_cast("int")
    out = F.when(rate.between(8, 320), F.struct(F.lit("abr").alias("mode"), rate.alias("value")))
    for preset_name, (mode, value) in PRESETS.items():
        out = out.when(name == preset_name, F.struct(F.lit(mode).alias("mode"), F.lit(value).alias("value")))
    return out


def shown_quality(mode: Column, quality: Column) -> Column:
    """Qualities below 4 run as 4 unless the rate is variable."""
    return F.when((mode != "vbr") & quality.between(0, 3), 4).otherwise(quality)
