"""Word hashes of texts, vectorised over whole buffers of bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Longest stretch of text that is hashed at once; arrays of eight bytes a character stay at some 8 MB.
BLOCK = 1 << 20

#: Words are stretches of anything but space, tab, newline, vertical tab, form feed and carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: Stretches of over so many bytes are hashed one by one.
LONG = 256

#: What of eight bytes counts where only so many are left.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEED = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a buffer on, as one little-endian number; zeros follow the end."""
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    return np.ndarray(len(text) + 1, "<u8", padded, strides=(1,))


def stretch_hashes(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of a buffer of bytes.

    Eight bytes at a time enter a chain that mixes after each; the length is where it starts. So no difference of two
    stretches cancels another one, and up to eight bytes never share a hash. Long stretches take a digest of their own.
    """
    long = np.flatnonzero(lengths > LONG)
    left = np.where(lengths > LONG, 0, lengths) if len(long) else lengths
    word, at, live = eights(text), starts, None
    h = lengths.astype(np.uint64) * _SEED
    out = h
    while True:
        h = mixed(h ^ (word[at] & _FIRST[np.minimum(left, 8)]))
        if live is None:
            out = h
        else:
            out[live] = h
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        live = more if live is None else live[more]
        h, at, left = h[more], at[more] + 8, left[more] - 8
    for k in long.tolist():
        a = int(starts[k])
        out[k] = int.from_bytes(hashlib.blake2b(text[a : a + int(lengths[k])].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(text: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a buffer of bytes; fold: A-Z count as a-z."""
    space = SPACE[text]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    return stretch_hashes(_LOWER[text] if fold else text, starts, ends - starts), starts


def span_hashes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash, never 0, of each stretch from one of starts (the first of which is 0) to the next."""
    return stretch_hashes(text, starts, np.diff(starts, append=len(text))) | np.uint64(1)


def pieces(text: bytes) -> Iterator[np.ndarray]:
    """A long text in stretches of about BLOCK bytes that end where a word does, as far as it has spaces."""
    whole = np.frombuffer(text, np.uint8)
    at = 0
    while at < len(whole):
        end = min(len(whole), at + BLOCK)
        while end < len(whole):
            window = np.flatnonzero(SPACE[whole[end : end + BLOCK]])
            if len(window):
                end += int(window[0])
                break
            end = min(len(whole), end + BLOCK)
        yield whole[at:end]
        at = end


def document_words(texts: list[bytes], fold: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, words per text) of runs of texts of about BLOCK bytes at most, in order."""
    k = 0
    while k < len(texts):
        if len(texts[k]) > BLOCK:
            found = [word_hashes(p, fold)[0] for p in pieces(texts[k])]
            hashes = np.concatenate(found)
            yield k, hashes, np.array([len(hashes)])
            k += 1
            continue
        to, size = k, 0
        while to < len(texts) and size + len(texts[to]) <= BLOCK:
            size += len(texts[to]) + 1
            to += 1
        joined = np.frombuffer(b"\n".join(texts[k:to]), np.uint8)
        hashes, starts = word_hashes(joined, fold) if len(joined) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        ends = np.cumsum([len(t) + 1 for t in texts[k:to]])
        yield k, hashes, np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
        k = to
