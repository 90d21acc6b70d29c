"""Column expressions over packed frame headers and byte strings.

A header is a 32-bit word in a long column, its first byte the highest; bytes are addressed from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bit rates in bit/s by index, for MPEG-1 and for MPEG-2 and 2.5.
BITRATES_1 = (0, 32000, 40000, 48000, 56000, 64000, 80000, 96000, 112000, 128000, 160000, 192000, 224000, 256000, 320000, 0)
BITRATES_2 = (0, 8000, 16000, 24000, 32000, 40000, 48000, 56000, 64000, 80000, 96000, 112000, 128000, 144000, 160000, 0)

#: Sample rates by mode (0 MPEG-2.5, 2 MPEG-2, 3 MPEG-1; 1 is reserved) and index; 0 is invalid.
RATES = {0: (11025, 12000, 8000, 0), 1: (0, 0, 0, 0), 2: (22050, 24000, 16000, 0), 3: (44100, 48000, 32000, 0)}

#: The smallest frame.
MIN_FRAME = 24


def bits(word: Column, shift: int, mask: int) -> Column:
    return F.shiftright(word, shift).bitwiseAND(F.lit(mask).cast("long")).cast("int")


def sync(word: Column) -> Column:
    return bits(word, 21, 0x7FF)


def mode(word: Column) -> Column:
    return bits(word, 19, 3)


def layer(word: Column) -> Column:
    return bits(word, 17, 3)


def bitrate_index(word: Column) -> Column:
    return bits(word, 12, 15)


def rate_index(word: Column) -> Column:
    return bits(word, 10, 3)


def padding(word: Column) -> Column:
    return bits(word, 9, 1)


def mono(word: Column) -> Column:
    return bits(word, 6, 3) == 3


def with_bits(word: Column, shift: int, mask: int, value: Column) -> Column:
    """word with the masked field at shift replaced."""
    keep = ((1 << 32) - 1) & ~(mask << shift)
    return word.bitwiseAND(F.lit(keep).cast("long")).bitwiseOR(F.shiftleft(value.cast("long").bitwiseAND(F.lit(mask).cast("long")), shift))


def with_bitrate_index(word: Column, value: Column) -> Column:
    return with_bits(word, 12, 15, value)


def with_padding(word: Column, value: Column) -> Column:
    return with_bits(word, 9, 1, value)


def with_main_data_offset(side: Column, is_1: Column, value: Column) -> Column:
    """The first 16 bits of side info with the main-data offset replaced: 9 bits for MPEG-1, else 8."""
    return F.when(is_1, with_bits(side, 7, 511, value)).otherwise(with_bits(side, 8, 255, value))


def _table(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def bitrate(word: Column) -> Column:
    i = bitrate_index(word)
    return F.when(mode(word) == 3, F.get(_table(BITRATES_1), i)).otherwise(F.get(_table(BITRATES_2), i))


def sample_rate(word: Column) -> Column:
    return F.get(_table([r for m in range(4) for r in RATES[m]]), mode(word) * 4 + rate_index(word))


def frame_size(word: Column) -> Column:
    """Bytes of a frame; null where the header names no sample rate."""
    whole = F.when(mode(word) == 3, 144).otherwise(72) * bitrate(word)
    return F.when(sample_rate(word) > 0, F.floor(whole / sample_rate(word)).cast("int") + padding(word))


def header_length(word: Column) -> Column:
    """4, or 6 where a checksum follows (protection bit clear)."""
    return F.when(bits(word, 16, 1) == 1, 4).otherwise(6)


def side_info_length(word: Column) -> Column:
    return F.when(mode(word) == 3, F.when(mono(word), 17).otherwise(32)).otherwise(F.when(mono(word), 9).otherwise(17))


def valid(word: Column) -> Column:
    """Whether the word heads a frame: sync, a known mode, layer III, usable indices, and a size that holds a frame."""
    usable = (sync(word) == 0x7FF) & (mode(word) != 1) & (layer(word) == 1) & ~bitrate_index(word).isin(0, 15) & (rate_index(word) != 3)
    return F.coalesce(usable & (frame_size(word) >= MIN_FRAME), F.lit(False))


def matches(word: Column, reference: Column) -> Column:
    """valid(), and of the reference's mode, header length and sample rate."""
    return valid(word) & (mode(word) == mode(reference)) & (header_length(word) == header_length(reference)) & (rate_index(word) == rate_index(reference))


def byte_at(data: Column, i: Column | int) -> Column:
    """Byte i of a binary column as an int; null beyond its end."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.when(i < F.octet_length(data), F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int"))


def byte_array(data: Column) -> Column:
    """All bytes of a binary column as an array of ints, in one pass over its hexadecimal digits."""
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), 1), lambda pair: F.conv(pair, 16, 10).cast("int"))


def main_data_offset(data: Column, is_1: Column, head: Column) -> Column:
    """Bytes back from a frame at which its main data starts: 9 bits after the header for MPEG-1, else 8."""
    return F.when(is_1, byte_at(data, head) * 2 + F.shiftright(byte_at(data, head + 1), 7)).otherwise(byte_at(data, head))


#: Fixed positions of the 12-bit length fields, as the first bit's place after the header, by (MPEG-1, mono).
LENGTH_FIELDS = {(False, True): (9,), (False, False): (10, 73), (True, True): (18, 77), (True, False): (20, 79, 138, 197)}


def _twelve(data: Column, head: Column, at: int) -> Column:
    """The 12 bits from bit `at` after the header."""
    first, skip = divmod(at, 8)
    n = -(-(skip + 12) // 8)
    value = F.lit(0)
    for k in range(n):
        value = value * 256 + byte_at(data, head + first + k)
    return F.shiftright(value, 8 * n - skip - 12).bitwiseAND(F.lit(4095))


def main_data_length(data: Column, is_1: Column, is_mono: Column, head: Column) -> Column:
    """Bytes of a frame's main data: the sum of its granules' lengths in bits, rounded up."""
    out = None
    for (one, single), places in LENGTH_FIELDS.items():
        total = sum((_twelve(data, head, at) for at in places), F.lit(0))
        test = (is_1 == one) & (is_mono == single)
        out = F.when(test, total) if out is None else out.when(test, total)
    return F.ceil(out / 8.0).cast("int")


def _crc_table(step) -> list[int]:
    return [step(i) for i in range(256)]


def _reflected(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xA001 if i & 1 else 0)
    return i


def _straight(i: int) -> int:
    c = i << 8
    for _ in range(8):
        c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
    return c


#: Tables of both checksums, made by their rules.
REFLECTED, STRAIGHT = _crc_table(_reflected), _crc_table(_straight)


def crc16_arc(data: Column, start: Column | int = 0) -> Column:
    """CRC-16 of reflected polynomial 0xA001; start chains it to what came before."""
    table = _table(REFLECTED)
    first = F.lit(start) if isinstance(start, int) else start
    return F.aggregate(byte_array(data), first.cast("int"), lambda c, b: F.get(table, (c.bitwiseXOR(b)).bitwiseAND(F.lit(255))).bitwiseXOR(F.shiftright(c, 8)))


def crc16_frame(data: Column) -> Column:
    """CRC-16 of polynomial 0x8005 from 0xFFFF, highest bit first."""
    table = _table(STRAIGHT)
    return F.aggregate(byte_array(data), F.lit(0xFFFF), lambda c, b: F.shiftleft(c, 8).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.get(table, F.shiftright(c, 8).bitwiseXOR(b).bitwiseAND(F.lit(255)))))


def synchsafe(data: Column, at: int) -> Column:
    """Four bytes of seven bits each."""
    value = F.lit(0)
    for k in range(4):
        value = value * 128 + byte_at(data, at + k).bitwiseAND(F.lit(0x7F))
    return value
