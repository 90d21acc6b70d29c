"""Column expressions over samples, levels and sample rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sample rates an MP3 stream may have.
LEGAL_RATES = (8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000)

#: The level of silence.
SILENCE_DB = -999.0


def saturate16(x: Column) -> Column:
    """Rounded to the nearest whole number, halves up, and held within 16 bits."""
    return F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.floor(x + 0.5).cast("double"))).cast("int")


def from_u8(x: Column) -> Column:
    return (x - 128) * 256


def normalise16(x: Column) -> Column:
    return x.cast("double") / 32768.0


def normalise24(x: Column) -> Column:
    """24-bit samples in the top bits of 32, over 2**31."""
    return x.cast("double") * 256.0 / 2147483648.0


def normalise32(x: Column) -> Column:
    return x.cast("double") / 2147483648.0


def clamp(x: Column) -> Column:
    """Held within -1 and 1, as a resampler's output is."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def rms_db(energy: Column) -> Column:
    """Level in dB of the aggregated squares of a column; SILENCE_DB where all are zero or there are none."""
    return F.when(F.coalesce(F.sum(energy), F.lit(0.0)) == 0, F.lit(SILENCE_DB)).otherwise(20 * F.log10(F.sqrt(F.avg(energy))))


def legal(rate: Column) -> Column:
    return rate.isin(*LEGAL_RATES)


def nearest_rate(rate: Column) -> Column:
    """The legal rate for an input rate: itself; its clock family's base for whole multiples of 44100 or 48000, and of
    their halves (of which the even ones are multiples of the base already); else the nearest, the lower of two."""
    near = F.array_min(F.array(*(F.struct(F.abs(rate - r).alias("d"), F.lit(r).alias("r")) for r in LEGAL_RATES)))["r"]
    out = F.when(legal(rate), rate)
    for base, of in ((44100, 44100), (48000, 48000), (22050, 22050), (24000, 24000)):
        out = out.when(F.pmod(rate, F.lit(base)) == 0, F.lit(of))
    return out.when(rate.isNotNull(), near)


def output_rate(asked: Column, encoder: Column, source: Column) -> Column:
    """A requested rate, snapped; else the encoder's own choice; else the nearest legal one for the source."""
    return F.coalesce(nearest_rate(asked), encoder, nearest_rate(source))


def resampled_length(frames: Column, source: Column, target: Column) -> Column:
    """Whole frames after resampling."""
    return F.floor(frames.cast("decimal(20,0)") * target / source).cast("long")


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d isn't above 0."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))
