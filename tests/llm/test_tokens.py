import hashlib
import random
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from conftest_llm import EDGE, LONG
from wavemill.llm import bpe, packing, token_files, words

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

PIECES = ["a", "B", "é", "ß", "1", "2", " ", "\n", "'", "s", "t", "  ", "\t", ".", ",", "!", "×", "÷", "–", "’", "日本", "ª", "½", "²", "'ll", "|", "\r\n", "ñ", "Ж", "\x1c", "<|endoftext|>", "ǅ", "՘", "\U00010940", " ", "\xa0", "\x85"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def by_ranks():
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks(RANKS), special_tokens={})
    return lambda text: e.encode_ordinary(text or "")


def test_encoder_is_the_library(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(4000)] + [t or "" for _, t in EDGE]
    assert [ids.tolist() for ids in words.Encoder(JSON)([t.encode() for t in texts])] == [library(t) for t in texts]


def test_encoder_forgets_and_goes_on(library, monkeypatch):
    monkeypatch.setattr(words.Encoder, "MOST", 50)
    e = words.Encoder(JSON)
    for k in range(5):
        texts = [f"word{k}x{n} and {n}" for n in range(60)]
        assert [ids.tolist() for ids in e([t.encode() for t in texts])] == [library(t) for t in texts]


TWINS = [bytes(b"ab"[(bin(i).count("1") + k) & 1] for i in range(2048)).decode() for k in (0, 1)]  # Thue-Morse words


def test_encoder_cuts_long_texts_at_safe_blanks(library, monkeypatch):
    monkeypatch.setattr(words.hashing, "BLOCK", 60)
    rng = random.Random(4)
    few = ["a b", "x. y", "7 z", ", w", *PIECES]
    texts = ["".join(rng.choice(few) for _ in range(rng.randrange(400))) for _ in range(300)] + ["z" * 500, " " * 500, " a" * 500, ""]
    assert all(b"".join(words.stretches(t.encode())) == t.encode() for t in texts)
    assert max(len(list(words.stretches(t.encode()))) for t in texts) > 5
    assert [ids.tolist() for ids in words.Encoder(JSON)([t.encode() for t in texts])] == [library(t) for t in texts]


@pytest.mark.parametrize("cap", ["MOST_IDS", "MOST_BYTES"])
def test_encoder_forgets_ids_and_bytes(library, monkeypatch, cap):
    monkeypatch.setattr(words.Encoder, cap, 40)
    e, texts = words.Encoder(JSON), [f"{k} word{k * k} again" for k in range(300)]
    for t in texts:
        assert [ids.tolist() for ids in e([t.encode()])] == [library(t)]
    assert e.count < 20


def test_encoder_tells_words_of_one_hash_apart(library, monkeypatch):
    assert [ids.tolist() for ids in words.Encoder(JSON)([t.encode() for t in TWINS])] == [library(t) for t in TWINS]
    monkeypatch.setattr(words.hashing, "span_hashes", lambda text, starts: (np.diff(starts, append=len(text)) % 3).astype(np.uint64) << np.uint64(60) | np.uint64(1))
    texts = ["".join(random.Random(k).choice(["a", "bc", " ", "def", "1"]) for _ in range(30)) + " " * (k % 2) for k in range(60)] + TWINS
    e = words.Encoder(JSON)
    for _ in range(2):
        assert [ids.tolist() for ids in e([t.encode() for t in texts])] == [library(t) for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_round_trip(spark, small, small_rows, library, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write(small, path, JSON, shard_bytes=4000)
    want, start = {}, 0
    for i, t in sorted(small_rows):
        ids = [*library(t), 0]
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in token_files.read(spark, path).collect()} == want
    asked = spark.createDataFrame([(3,), (5,), (10**6,), (None,), (5,)], "doc_id long")
    got = sorted((r["doc_id"], list(r["ids"])) for r in token_files.lookup(spark, path, asked).collect())
    texts = dict(small_rows)
    assert got == [(i, [*library(texts[i]), 0]) for i in (3, 5, 5)]


def test_files_edges(spark, edge, nothing, library, tmp_path):
    token_files.write(edge, str(tmp_path / "a"), JSON)
    rows = token_files.read(spark, str(tmp_path / "a")).collect()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((len(library(t)) + 1, crc([*library(t), 0])) for _, t in EDGE)
    assert sorted(r["start"] for r in rows)[0] == 0 and len({r["start"] for r in rows}) == len(EDGE)
    token_files.write(nothing, str(tmp_path / "b"), JSON)
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


def test_files_keep_rows_without_a_key(spark, library, tmp_path):
    rows = [(None, "alpha beta gamma"), (0, "zero"), (5, "five"), (None, None), (5, "five again"), (-3, "minus")]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), str(tmp_path / "a"), JSON)
    got = token_files.read(spark, str(tmp_path / "a")).collect()
    assert sorted(str((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in got) == sorted(str((i, len(library(t)) + 1, crc([*library(t), 0]))) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    found = token_files.lookup(spark, str(tmp_path / "a"), spark.createDataFrame([(0,), (None,), (7,), (-3,), (-4,)], "doc_id long"))
    assert sorted((r["doc_id"], list(r["ids"])) for r in found.collect()) == [(-3, [*library("minus"), 0]), (0, [*library("zero"), 0])]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    h = token_files.PerfectHash.from_bytes(token_files.PerfectHash.build(keys).to_bytes())
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))


def check_packing(rows, docs, encode, capacity=1024):
    ids = {i: [*encode(t), 2] for i, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    for i, found in by_doc.items():
        found.sort(key=lambda r: r["piece"])
        n, at = len(ids[i]), 0
        assert [r["piece"] for r in found] == list(range(-(-n // capacity)))
        for r in found:
            assert r["start"] == at and r["length"] == ((n - 1) % capacity + 1 if not at else capacity)
            at += r["length"]
        assert at == n
    for spans in by_seq.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= capacity
    assert set(by_doc) == set(ids)
    return len(by_seq), sum(map(len, ids.values()))


def test_packing(small, small_rows, library):
    sequences, tokens = check_packing(packing.pack_documents(small, JSON).collect(), small_rows, library)
    assert sequences <= -(-tokens // 1024) * 1.01 + 1


def test_packing_edges(spark, edge, nothing, library):
    rows = packing.pack_documents(edge, JSON).collect()
    assert sum(r["length"] for r in rows) == sum(len(library(t)) + 1 for _, t in EDGE)
    assert packing.pack_documents(nothing, JSON).count() == 0
    with_ids = packing.pack_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), JSON, with_ids=True).first()
    assert np.frombuffer(with_ids["ids"], "<u4").tolist() == [*library("a b"), 2]


@pytest.mark.parametrize("seed", range(6))
def test_sweep_takes_the_tightest_gap(seed):
    rng = random.Random(seed)
    rooms = {n: rng.randrange(1, 20) for n in rng.sample(range(1, 40), 20)} | {40: 2000}
    waiting = {n: rng.randrange(1, 30) for n in rng.sample(range(1, 41), 15)}
    found = Counter()
    for room, a, b, length, rank, each in packing.sweep(rooms, waiting, 0):
        assert each == 1 and rank == sum(n for (_, m), n in found.items() if m == length) and b <= rooms[room]
        found[room, length] += b - a
    left, want = sorted(Counter(rooms).elements()), Counter()
    for length in sorted(Counter(waiting).elements(), reverse=True):
        room = left.pop(bisect_left(left, length))
        want[room, length] += 1
    assert found == want


def test_sweep_fills_few_gaps_with_many_pieces():
    assert packing.sweep({10: 2}, {3: 6}, 0) == [(10, 0, 2, 3, 0, 3)]
    assert packing.sweep({10: 2}, {3: 3}, 0) == [(10, 0, 1, 3, 0, 2), (10, 1, 2, 3, 2, 1)]
    assert packing.sweep({10: 2}, {3: 5, 2: 1}, 2) == [(10, 0, 1, 3, 0, 3), (10, 1, 2, 3, 3, 2)]
    assert packing.sweep({}, {3: 5}, 0) == packing.sweep({2: 5}, {3: 5}, 0) == []


@pytest.mark.parametrize("seed", range(3))
def test_fill_is_near_best_fit_decreasing(spark, seed):
    rng = random.Random(seed)
    capacity = 40
    counts = {n: rng.randrange(1, 300) for n in rng.sample(range(1, capacity + 1), 15)}
    left = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        fit = min(((r, k) for k, r in enumerate(left) if r >= n), default=None)
        if fit is None:
            left.append(capacity - n)
        else:
            left[fit[1]] -= n
    rows = packing.fill(spark, counts, capacity).collect()
    assert sorted((r["length"], r["rank"]) for r in rows) == sorted((n, k) for n, c in counts.items() for k in range(c))
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= capacity
    assert len(by) <= 1.01 * len(left) + 1


def test_pack_takes_columns_of_its_own_names(spark):
    names = ["doc_id", "rank", "salt", "before", "length", "row", "room", "Length", "n", "sequence_id"]
    rows = [(None if k % 3 else k // 9, "r", k % 2, None, 1 + k % 9, 5, None, 7, 1, "s") for k in range(60)]
    out = packing.pack(spark.createDataFrame(rows * 2, "a long, b string, c int, d string, e int, f int, g string, h int, i int, j string").toDF(*names), 10)
    assert out.columns == [*names, "sequence_id", "offset"]
    found = out.collect()
    assert sorted(map(str, (tuple(r)[:10] for r in found))) == sorted(map(str, rows * 2))
    taken = sorted((r[10], p) for r in found for p in range(r[11], r[11] + r[4]))
    assert len(taken) == len(set(taken)) and max(p for _, p in taken) < 10
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 11)], "doc_id long, length int"), 10)


def test_bpe(spark, small, small_rows, by_ranks):
    rng = random.Random(2)
    odd = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(300)]
    rows = small_rows + [(1000 + k, t) for k, t in enumerate([*(t for _, t in EDGE), *odd])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (len(ids := by_ranks(t)), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t in rows}
    assert {r["doc_id"]: tuple(r)[1:] for r in bpe.encode_decode(df, RANKS, block_bytes=50_000).collect()} == want


def test_bpe_edges(spark, edge, nothing):
    rows = bpe.encode(edge, RANKS).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), bytes(r["text"])) for r in rows) == sorted(((i is None, i or 0), (t or "").encode()) for i, t in EDGE)
    assert bpe.encode(nothing, RANKS).count() == 0
    back = bpe.decode(bpe.encode(edge, RANKS).select("doc_id", "ids"), RANKS)
    assert sorted(bytes(r["text"]) for r in back.collect()) == sorted((t or "").encode() for _, t in EDGE)
    assert bpe.decode(spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x7f")), (2, None)], "doc_id long, ids binary"), RANKS).orderBy("doc_id").collect() == [(1, None), (2, b"")]
    assert LONG
