"""Byte-level BPE one pre-token at a time: each distinct pre-token is encoded once per worker by the library itself."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex

from wavemill.llm import common, hashing

#: Splits a text into pre-tokens; its matches cover every character.
PATTERN = public_tokenizers.PATTERN

#: Where the pattern's letter, number and space classes are the same in all Unicode versions in use; a text with any
#: other character goes through the library as a whole. Fixed ranges, checked over all code points.
_OTHER = re.compile("[^\u0000-՗ -₎ₐ-ₜ₠-⯿　-鿿가-힣]")

#: A blank between these starts a pre-token whatever the engine.
_SAFE = re.compile("(?<=[A-Za-z0-9.,])(?= [A-Za-z])")


_SAFE_BYTES = re.compile(rb"(?<=[A-Za-z0-9.,])(?= [A-Za-z])")


def stretches(text: bytes) -> Iterator[bytes]:
    """A long text in stretches of about hashing.BLOCK bytes that encode alone, as far as it has safe blanks to cut at."""
    at = 0
    while at < len(text):
        found = _SAFE_BYTES.search(text, at + hashing.BLOCK)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


def splitter():
    """A function from a text to stretches that each encode alone: its pre-tokens, or where it has characters on which
    engines differ, longer stretches, which the encoding library then splits itself."""
    split = regex.compile(PATTERN).findall
    return lambda text: split(text) if text.isascii() or not _OTHER.search(text) else [x for x in _SAFE.split(text) if x]


#: Pre-tokens a worker remembers; beyond that it starts over, which changes speed only.
REMEMBERED = 400_000


class _Memo(dict):
    """pre-token -> payload of its ids (little-endian, `width` bytes each)."""

    def __init__(self, encode, width: int):
        super().__init__()
        self.encode, self.width = encode, width

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(i.to_bytes(self.width, "little") for i in self.encode(word))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Payloads:
    """Texts to id payloads with the `tokenizers` library's vocabulary file at `path`, no special tokens added."""

    def __init__(self, path: str, width: int = 4):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # a special token's string in a text is ordinary text
        self.width = width
        self.memo = _Memo(lambda word: self.library.encode(word, add_special_tokens=False).ids, width)
        self.split = regex.compile(PATTERN).findall

    def __call__(self, text: str) -> bytes:
        if not text.isascii() and _OTHER.search(text):
            return b"".join(i.to_bytes(self.width, "little") for i in self.library.encode(text, add_special_tokens=False).ids)
        memo = self.memo
        return b"".join([memo[w] for w in self.split(text)])


#: Classes of bytes for splitting without a pattern: letters, numbers, other signs, space, newline, and bytes that only
#: the pattern can tell (other white space, apostrophes, and characters from U+0080 to U+00BF or from U+0280 on).
_LETTER, _NUMBER, _SIGN, _BLANK, _NEWLINE, _ASK = range(6)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
_CLASS[0x30:0x3A] = _NUMBER
_CLASS[0x20], _CLASS[0x0A] = _BLANK, _NEWLINE
_CLASS[[0x09, *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x27, 0xC2, *range(0xCA, 0x100)]] = _ASK


def plain_starts(text: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens start in texts laid end to end (at firsts), and which texts need the pattern itself.

    A text is plain if its blanks and newlines stand alone between other characters and it holds no byte to ask the
    pattern about (nor the two signs among the letters of U+00C0 to U+00FF). There a pre-token is a newline, or a run of
    one class with the blank before it.
    """
    kind = _CLASS[text]
    start, ask = np.ones(len(text), bool), kind == _ASK
    before, now = kind[:-1], kind[1:]
    start[1:] = (now >= _BLANK) | ((before != now) & (before != _BLANK))
    blanks = (now >= _BLANK) & (before >= _BLANK)
    within = np.ones(len(text), bool)
    within[firsts] = False
    ask[1:] |= blanks & within[1:]
    ask[1:] |= (text[:-1] == 0xC3) & ((text[1:] == 0x97) | (text[1:] == 0xB7))
    start[firsts] = True
    return np.flatnonzero(start), np.add.reduceat(ask, firsts) > 0


class Encoder:
    """Many texts to ids at once. Pre-tokens are split and hashed for whole buffers; each distinct one is encoded by the
    library's model when it is first met, and its ids are found by its 64-bit hash from then on, once its bytes have been
    compared: of two pre-tokens of one hash, the later one is looked for under the hash's own hash, and so on.

    Texts that aren't plain go through Payloads one by one.
    """

    #: Distinct pre-tokens that are remembered (some 200 bytes each with room to grow), their ids and their bytes: 40 MB or
    #: so, however much a worker reads. Beyond that it starts over, which changes speed only.
    MOST, MOST_IDS, MOST_BYTES = 200_000, 1 << 22, 1 << 23

    def __init__(self, path: str):
        self.one = Payloads(path, 4)
        self.model = self.one.library.model
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]  # bytes that stand for themselves
        self.spelling = {b: b if b in set(shown) else 256 + k for k, b in enumerate([*(b for b in range(256) if b not in shown), *shown])}
        self.clear()

    def clear(self) -> None:
        self.bits, self.count = 16, 0
        self.keys, self.entry = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 15, np.uint32), np.zeros(1 << 15, np.uint32)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.spelt, self.spelt_starts, self.spelt_sizes, self.spelt_used = np.zeros(1 << 18, np.uint8), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64), 0

    def _same(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Whether stretches of text have the bytes of the entries."""
        out = self.spelt_sizes[entries] == lengths
        mine, held = hashing.eights(text), np.ndarray(len(self.spelt) - 7, "<u8", self.spelt, strides=(1,))
        at, there, left, live = starts, self.spelt_starts[entries], lengths, np.arange(len(starts))
        while True:
            keep = np.flatnonzero(out[live] & (left > 0))
            if not len(keep):
                return out
            live, at, there, left = live[keep], at[keep], there[keep], left[keep]
            if int(left.max()) > hashing.LONG:
                for k in np.flatnonzero(left > hashing.LONG).tolist():
                    a, b, n = int(at[k]), int(there[k]), int(left[k])
                    out[live[k]] = np.array_equal(text[a : a + n], self.spelt[b : b + n])
                left = np.where(left > hashing.LONG, 0, left)
            out[live] &= (mine[at] ^ held[there]) & hashing._FIRST[np.minimum(left, 8)] == 0
            at, there, left = at + 8, there + 8, left - 8

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 where there is none."""
        mask, out = len(self.keys) - 1, np.full(len(hashes), -1, np.int32)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        hit = held == hashes
        out[hit] = self.entry[slot[hit]]
        left = np.flatnonzero(~hit & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            held = self.keys[slot[left]]
            hit = held == hashes[left]
            out[left[hit]] = self.entry[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def _put(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.entry[slot[won]] = hashes[won], entries[won]
            left = left[self.keys[slot[left]] != hashes[left]]
            slot[left] = (slot[left] + 1) & mask

    def _learn(self, hashes: np.ndarray, spelt: list[bytes]) -> None:
        """Adds distinct pre-tokens; the library's model encodes them."""
        tokenize, spelling = self.model.tokenize, self.spelling
        ids = [[t.id for t in tokenize(w.decode("latin-1").translate(spelling))] for w in spelt]
        sizes = np.array(list(map(len, ids)), np.int64)
        flat = np.array([i for w in ids for i in w], np.uint32)
        n, more = self.count + len(ids), self.used + len(flat)
        if n > len(self.starts):
            self.starts, self.sizes, self.spelt_starts, self.spelt_sizes = (np.concatenate([x, np.zeros(n, x.dtype)]) for x in (self.starts, self.sizes, self.spelt_starts, self.spelt_sizes))
        letters = np.frombuffer(b"".join(spelt), np.uint8)
        if self.spelt_used + len(letters) + 8 > len(self.spelt):
            self.spelt = np.concatenate([self.spelt, np.zeros(self.spelt_used + len(letters) + 8, np.uint8)])
        self.spelt[self.spelt_used : self.spelt_used + len(letters)] = letters
        self.spelt_sizes[self.count : n] = lengths = np.array(list(map(len, spelt)), np.int64)
        self.spelt_starts[self.count : n] = self.spelt_used + np.cumsum(lengths) - lengths
        self.spelt_used += len(letters)
        if more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(more, np.uint32)])
        self.flat[self.used : more] = flat
        self.sizes[self.count : n], self.starts[self.count : n] = sizes, self.used + np.cumsum(sizes) - sizes
        if 2 * n > len(self.keys):
            held = self.keys != 0
            keys, entries = self.keys[held], self.entry[held]
            while 2 * n > 1 << self.bits:
                self.bits += 1
            self.keys, self.entry = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(keys, entries)
        self._put(hashes, np.arange(self.count, n, dtype=np.int32))
        self.count, self.used = n, more

    def _plain(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens at starts, end to end, and where each pre-token's end."""
        if self.count > self.MOST or self.used > self.MOST_IDS or self.spelt_used > self.MOST_BYTES:
            self.clear()
        hashes, lengths = hashing.span_hashes(text, starts), np.diff(starts, append=len(text))
        found, todo = np.full(len(starts), -1, np.int32), np.arange(len(starts))
        while len(todo):
            entries = self._find(hashes[todo])
            new = todo[entries < 0]
            if len(new):
                distinct, first = np.unique(hashes[new], return_index=True)
                at = new[first]
                self._learn(distinct, [text[a : a + n].tobytes() for a, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)])
                entries = self._find(hashes[todo])
            ok = self._same(text, starts[todo], lengths[todo], entries)
            found[todo[ok]] = entries[ok]
            todo = todo[~ok]
            hashes[todo] = hashing.mixed(hashes[todo]) | np.uint64(1)
        n = self.sizes[found].astype(np.int64)
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]), dtype=np.int64)
        at += np.repeat(self.starts[found] - (ends - n), n)
        return self.flat[at], ends

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids (uint32) of each text."""
        out: list[np.ndarray] = []
        k = 0
        while k < len(texts):
            if len(texts[k]) > hashing.BLOCK:
                out.append(np.concatenate([self._run([part])[0] for part in stretches(texts[k])]))
                k += 1
                continue
            to, size = k + 1, len(texts[k])
            while to < len(texts) and size + len(texts[to]) <= hashing.BLOCK:
                size += len(texts[to])
                to += 1
            out += self._run(texts[k:to])
            k = to
        return out

    def _run(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [np.zeros(0, np.uint32) if not t else None for t in texts]
        some = [k for k, t in enumerate(texts) if t]
        if not some:
            return out
        text = np.frombuffer(b"".join(texts[k] for k in some), np.uint8)
        lengths = np.array([len(texts[k]) for k in some])
        firsts = np.cumsum(lengths) - lengths
        starts, ask = plain_starts(text, firsts)
        if ask.any():
            for k in np.flatnonzero(ask).tolist():
                out[some[k]] = np.frombuffer(self.one(texts[some[k]].decode()), np.uint32)
            some = [k for k, asks in zip(some, ask.tolist(), strict=True) if not asks]
            if not some:
                return out
            text = np.frombuffer(b"".join(texts[k] for k in some), np.uint8)
            lengths = lengths[~ask]
            firsts = np.cumsum(lengths) - lengths
            starts, _ = plain_starts(text, firsts)
        ids, ends = self._plain(text, starts)
        bounds = np.concatenate([[0], ends])[np.searchsorted(starts, np.append(firsts, len(text)))]
        for k, a, b in zip(some, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[k] = ids[a:b]
        return out


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return common.held(("encoder", path), lambda: Encoder(path))


def ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: token bytes to id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def rank_encoding(path: str):
    """The tiktoken encoding of a .tiktoken file, without special tokens; one per worker process."""
    import tiktoken

    return common.held(("ranks", path), lambda: tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={}))
