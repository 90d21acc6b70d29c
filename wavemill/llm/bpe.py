"""Byte-level BPE over the distinct words of the corpus: encode each once, join the ids back, reassemble by position."""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm import common, words

#: Bytes of text in a block: documents whose pre-tokens share one list of distinct words; one longer text is a block.
BLOCK_BYTES = 8 << 20

#: Words whose ids a task of the encoding stage remembers; beyond that it starts over, which changes speed only.
REMEMBERED = 400_000

#: Pre-tokens that are turned into ids and bytes at once, as far as documents end there.
RUN = 1 << 18

_BLOCKS = {"block": pa.int64(), "n_words": pa.int64(), "ids": pa.binary(), "counts": pa.binary(), "places": pa.binary(), "ranks": pa.binary(), "parts": pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary())]))}
_BLOCKS_SCHEMA = "block long, n_words long, ids binary, counts binary, places binary, ranks binary, parts array<struct<part: int, words: binary>>"
_ENCODED = {"doc_id": pa.int64(), "ids": pa.binary(), "text": pa.binary()}


class _Places(dict):
    """word -> its place in the block's list of distinct words."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _pack(items: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(items), *map(len, items)], "<u4").tobytes() + b"".join(items))


def _unpack(blob: bytes) -> list[bytes]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)
    starts = np.concatenate([[4 * (n + 1)], ends[:-1]]) if n else ends
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, all their lowest bytes first: small numbers, which are the most frequent, take least."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack_numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _parts_of(listed: list[str], parts: int) -> np.ndarray:
    """The part of each word: by checksum, so that every block sends equal words to one place."""
    return np.array([zlib.crc32(w.encode()) % parts for w in listed], np.int64)


def _blocks(docs: DataFrame, parts: int, block_bytes: int) -> DataFrame:
    """Pre-tokens with their positions, by block: each document a run of places in the block's list of distinct words."""

    def run(batches):
        split = words.splitter()
        ids, counts, places, index, size, number = [], [], [], _Places(), 0, 0

        def block():
            listed = list(index)
            part = _parts_of(listed, parts)
            order = np.argsort(part, kind="stable")  # replies come back part by part: rank is where a place's is among them
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            sent = [{"part": p, "words": _pack([listed[i].encode() for i in order[bounds[p] : bounds[p + 1]].tolist()])} for p in range(parts) if bounds[p] < bounds[p + 1]]
            keys = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is not None for i in ids], bool).tobytes()
            where = np.concatenate(places)
            return common.record(_BLOCKS, [TaskContext.get().partitionId() << 32 | number], [len(listed)], [keys], [np.array(counts, "<u4").tobytes()], [_pack_numbers(where)], [_pack_numbers(rank)], [sent])

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py() or ""
                length = len(text) if text.isascii() else len(text.encode())
                if ids and size + length > block_bytes:
                    made = block()
                    ids, counts, places, index, size, number = [], [], [], _Places(), 0, number + 1
                    yield made
                    del made
                found = split(text)
                ids.append(doc_id)
                counts.append(len(found))
                places.append(np.fromiter(map(index.__getitem__, found), np.uint32, len(found)))
                size += length
                del found
        if ids:
            yield block()

    return common.in_python(docs, run, _BLOCKS_SCHEMA)


def _encode_words(sent: DataFrame, ranks_path: str) -> DataFrame:
    """(block, part, words) to (block, part, reply): each distinct word of a part is encoded once, for all its blocks.

    A part's rows stream by, a block at a time; what stays in memory is the part's distinct words, REMEMBERED at most.
    """

    def run(batches):
        encode = words.rank_encoding(ranks_path).encode_ordinary
        known: dict[bytes, bytes] = {}
        last = None
        for row in common.rows_of(batches):
            if row["part"] != last or len(known) > REMEMBERED:
                known, last = {}, row["part"]
            reply = []
            for word in _unpack(row["words"]):
                if word not in known:
                    known[word] = np.array(encode(word.decode()), "<u4").tobytes()
                reply.append(known[word])
            yield common.record({"block": pa.int64(), "part": pa.int32(), "reply": pa.binary()}, [row["block"]], [row["part"]], [_pack(reply)])

    ordered = sent.repartition(common.partitions(sent.sparkSession), "part").sortWithinPartitions("part", "block")
    return common.in_python(ordered, run, "block long, part int, reply binary", holds="ranks")


def _gather(starts: np.ndarray, lengths: np.ndarray, which: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches `which` of flat, end to end, and where each ends."""
    n = lengths[which]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    at += np.repeat(starts[which] - (ends - n), n)
    return flat[at], ends


def _token_table(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, and each rank's start and size; one per worker process and vocabulary."""

    def make():
        pieces = sorted(words.ranks(ranks_path).items(), key=lambda x: x[1])
        sizes = np.zeros(pieces[-1][1] + 1 if pieces else 1, np.int64)
        for piece, rank in pieces:
            sizes[rank] = len(piece)
        return np.frombuffer(b"".join(p for p, _ in pieces), np.uint8), np.cumsum(sizes) - sizes, sizes

    return common.held(("ranks", ranks_path, "table"), make)


def _reassemble(joined: DataFrame, ranks_path: str, out: dict, schema: str, make) -> DataFrame:
    """Blocks with their replies to documents: ids by position, and bytes from the token table."""

    def run(batches):
        token_bytes, token_starts, sizes = _token_table(ranks_path)
        for row in common.rows_of(batches):
            encoded = [w for r in sorted(row["replies"] or [], key=lambda r: r["part"]) for w in _unpack(r["reply"])]
            flat = np.frombuffer(b"".join(encoded), "<u4")
            lengths = np.array([len(w) // 4 for w in encoded], np.int64)
            del encoded
            starts = np.cumsum(lengths) - lengths
            counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
            n = len(counts)
            keys, known = np.frombuffer(row["ids"], "<i8", n), np.frombuffer(row["ids"], bool, n, 8 * n)
            places, ranks = _unpack_numbers(row["places"]), _unpack_numbers(row["ranks"])
            starts, lengths = starts[ranks], lengths[ranks]
            ends = np.cumsum(counts)
            first = 0
            while first < n:  # runs of documents of some RUN pre-tokens
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + RUN, "right")))
                lo, hi = int(ends[first] - counts[first]), int(ends[last - 1])
                ids, word_ends = _gather(starts, lengths, places[lo:hi], flat)
                cut = np.concatenate([[0], word_ends])[ends[first:last] - lo]
                text, token_ends = _gather(token_starts, sizes, ids, token_bytes)
                text_cut = np.concatenate([[0], token_ends])[cut]
                raw, spelt = ids.astype("<u4").tobytes(), text.tobytes()
                a, ta = 0, 0
                rows = []
                for k in range(first, last):
                    b, tb = int(cut[k - first]), int(text_cut[k - first])
                    rows.append(make(int(keys[k]) if known[k] else None, raw[4 * a : 4 * b], spelt[ta:tb]))
                    a, ta = b, tb
                yield common.record(out, *map(list, zip(*rows, strict=True)))
                first = last

    return common.in_python(joined, run, schema, holds="ranks")


def _encoded(docs: DataFrame, ranks_path: str, block_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    parts = common.partitions(spark)
    rows = common.only(docs, doc_id="long", text="string")
    name = f"wavemill_{uuid.uuid4().hex}"
    path = f"{common.shared_dir(spark)}/{name}"
    common.forget_at_exit(spark, path)
    common.forget_table_at_exit(spark, name)
    # Bucketed by block, so that the words' ids come to the blocks and the blocks themselves are never shuffled.
    _blocks(rows, parts, block_bytes).write.format("parquet").option("path", path).bucketBy(parts, "block").sortBy("block").saveAsTable(name)
    blocks = spark.table(name)
    sent = blocks.select("block", F.explode("parts").alias("p")).select("block", "p.part", "p.words")
    replies = _encode_words(sent, ranks_path).groupBy("block").agg(F.collect_list(F.struct("part", "reply")).alias("replies"))
    return blocks.select("block", "ids", "counts", "places", "ranks").join(replies, "block", "left")


def encode(docs: DataFrame, ranks_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), text (the ids' bytes, decoded) of docs(doc_id, text).

    Ids are those of the tiktoken library with the ranks at `ranks_path` and the usual pattern, without special tokens.
    Null text is empty; repeated rows and null doc_ids have a row each; an empty table gives an empty result.

    Documents are dealt to blocks as they are read. A block's pre-tokens are positions in its list of distinct words;
    the lists are shuffled by word, each distinct word of the corpus is encoded once, and its ids go back to the blocks
    that asked. A frequent word is one entry a block, so no task gets more of it than there are blocks.
    """
    return _reassemble(_encoded(docs, ranks_path, block_bytes), ranks_path, _ENCODED, "doc_id long, ids binary, text binary", lambda *row: row)


def encode_decode(docs: DataFrame, ranks_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """encode() in digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def digest(doc_id, ids, text):
        return doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    return _reassemble(_encoded(docs, ranks_path, block_bytes), ranks_path, out, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """tokens(doc_id, ids binary) to (doc_id, text binary), by the token-byte table, which each worker holds (its size is
    the vocabulary's). An id without an entry makes its document's text null; null ids are empty."""
    rows = common.only(tokens, doc_id="long", ids="binary").withColumn("ids", F.coalesce("ids", F.lit(b"")))
    out = {"doc_id": pa.int64(), "text": pa.binary()}

    def run(batches):
        token_bytes, token_starts, sizes = _token_table(ranks_path)
        for row in common.rows_of(batches):
            ids = np.frombuffer(row["ids"], "<u4")
            known = not len(ids) or (int(ids.max()) < len(sizes) and bool((sizes[ids] > 0).all()))
            text = _gather(token_starts, sizes, ids, token_bytes)[0].tobytes() if known else None
            yield common.record(out, [row["doc_id"]], [text])

    return common.in_python(rows, run, "doc_id long, text binary", holds="ranks")
