"""Quality classifier: averaged embeddings of hashed words and character n-grams, softmax output, stochastic gradient descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm import common, hashing

#: Buckets of words and of n-grams (powers of two), bytes of an n-gram, dimensions of a vector.
WORDS, GRAMS, N, DIMS = 1 << 15, 1 << 16, 4, 16

#: Bounds of the training sample: labelled rows, and distinct features of their texts in all (four bytes each, which is
#: what comes to the driver). Rows are drawn by hash of their id.
SAMPLE_ROWS, SAMPLE_FEATURES = 6000, 8 << 20

#: LIFT: an average spreads each step over hundreds of features, so their vectors move by so much more.
EPOCHS, RATE, LIFT, SEED = 8, 0.5, 60.0, 7

#: predicted is 1 from this score on.
THRESHOLD = 0.3

#: The word bucket of a word that repeats the one before it.
_REPEAT = WORDS - 1


@dataclass(frozen=True)
class Model:
    """weights: what a feature adds to the log-odds of label 1 where it is all of a document; bias: of an empty one."""

    weights: np.ndarray
    bias: float


def _word_features(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    out = (hashes >> np.uint64(49)).astype(np.int64)
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
    same[firsts[firsts < len(same)]] = False
    out[same] = _REPEAT
    return out


def _gram_features(text: np.ndarray) -> np.ndarray:
    """Buckets of the N bytes from each place on; text has N - 1 bytes more than places."""
    n = len(text) - N + 1
    value = np.zeros(n, np.uint32)
    for k in range(N):
        value |= text[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    value *= np.uint32(2654435761)
    return (value >> np.uint32(32 - 16)).astype(np.int64) + WORDS


def features(text: bytes) -> np.ndarray:
    """All features of one text, with repeats."""
    found = [_word_features(h, np.zeros(1, np.int64)) for _, h, _ in hashing.document_words([text], fold=False)]
    grams = [_gram_features(np.frombuffer(text[at : at + hashing.BLOCK + N - 1].ljust(min(len(text) - at, hashing.BLOCK) + N - 1, b"\0"), np.uint8)) for at in range(0, len(text), hashing.BLOCK)]
    return np.concatenate([*found, *grams]) if grams else np.zeros(0, np.int64)


def sums(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Mean weight of each text's features; 0 for a text without any."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for first, hashes, per in hashing.document_words(texts, fold=False):
        ends = np.cumsum(per)
        value = np.concatenate([[0.0], np.cumsum(weights[_word_features(hashes, ends - per)], dtype=np.float64)])
        total[first : first + len(per)] += value[ends] - value[ends - per]
        count[first : first + len(per)] += per
    k = 0
    while k < len(texts):
        if len(texts[k]) > hashing.BLOCK:
            for at in range(0, len(texts[k]), hashing.BLOCK):
                part = texts[k][at : at + hashing.BLOCK + N - 1].ljust(min(len(texts[k]) - at, hashing.BLOCK) + N - 1, b"\0")
                total[k] += weights[_gram_features(np.frombuffer(part, np.uint8))].sum(dtype=np.float64)
            count[k] += len(texts[k])
            k += 1
            continue
        to, size = k, 0
        while to < len(texts) and size + len(texts[to]) <= hashing.BLOCK:
            size += len(texts[to]) + N - 1
            to += 1
        joined = b"".join(t + b"\0" * (N - 1) for t in texts[k:to]) + b"\0" * (N - 1)
        value = np.concatenate([[0.0], np.cumsum(weights[_gram_features(np.frombuffer(joined, np.uint8))], dtype=np.float64)])
        lengths = np.array([len(t) for t in texts[k:to]])
        starts = np.cumsum(lengths + N - 1) - (lengths + N - 1)
        total[k:to] += value[starts + lengths] - value[starts]
        count[k:to] += lengths
        k = to
    return total / np.maximum(count, 1)


def score(texts: list[bytes], model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-(sums(texts, model.weights) + model.bias)))


def packed(text: bytes) -> bytes:
    """A text's distinct features and their shares, four bytes each: count of words, largest share, then 16 bits for each
    word bucket, for each n-gram bucket, and for each share as part of the largest."""
    found, times = np.unique(features(text), return_counts=True)
    most = int(times.max(initial=1))
    head = np.array([np.searchsorted(found, WORDS)], "<u4").tobytes() + np.array([most / max(1, int(times.sum()))], "<f4").tobytes()
    return head + np.where(found < WORDS, found, found - WORDS).astype("<u2").tobytes() + (times / most).astype("<f2").tobytes()


def unpacked(blob: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """(features, shares) of packed()."""
    n = (len(blob) - 8) // 4
    found = np.frombuffer(blob, "<u2", n, 8).astype(np.int32)
    found[int(np.frombuffer(blob, "<u4", 1)[0]) :] += WORDS
    return found, np.frombuffer(blob, "<f2", n, 8 + 2 * n).astype(np.float32) * np.frombuffer(blob, "<f4", 1, 4)[0]


def fit(docs: list[bytes | pa.Buffer], labels: list[int]) -> Model:
    """Feature vectors and a softmax layer over their average, trained one document, as packed() has it, after the other.

    For two classes the softmax of a linear layer over an average of vectors is a logistic function of an average of
    numbers, one for each feature; those are what is kept. Without any labels, every score is a half.
    """
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (WORDS + GRAMS, DIMS)).astype(np.float32)
    layer, bias = np.zeros((2, DIMS), np.float32), np.zeros(2, np.float32)
    if len(set(labels)) < 2:
        return Model(np.zeros(WORDS + GRAMS, np.float32), float(8 * (labels[0] - 0.5)) if labels else 0.0)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            found, share = unpacked(docs[k])
            mine = vectors[found]
            mean = share @ mine
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            down = p @ layer
            layer -= rate * np.outer(p, mean)
            bias -= np.float32(0.1) * rate * p
            vectors[found] = mine - (rate * np.float32(LIFT)) * share[:, None] * down
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def in_fold(column: str) -> F.Column:
    """True for rows held out: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


_SAMPLE = {"doc_id": pa.int64(), "quality": pa.int32(), "draw": pa.int64(), "n": pa.int64(), "features": pa.binary()}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most SAMPLE_ROWS labelled rows outside the held-out fold, of at most SAMPLE_FEATURES in all.

    docs(doc_id, text), labels(doc_id, quality 0 or 1). Rows are taken by hash of doc_id, whole texts only; null ids and
    labels of other values aren't used, and a row labelled twice counts by its smallest label. Scores see texts alone.
    Tasks turn the drawn texts into features, and only those of the chosen rows come to the driver.
    """
    known = common.only(labels, doc_id="long", quality="int").filter("doc_id is not null and quality in (0, 1)").filter(~in_fold("doc_id"))
    drawn = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = common.only(docs, doc_id="long", text="string").join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "text", F.xxhash64("doc_id").alias("draw"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [packed(t) for t in common.blobs(batch.column("text"))]
        return common.record(_SAMPLE, *(batch.column(c) for c in ("doc_id", "quality", "draw")), [len(f) // 4 - 2 for f in found], found)

    sample = common.keep(common.over_texts(texts, run, "doc_id long, quality int, draw long, n long, features binary"), "sample")
    order = ("draw", "doc_id", "n")
    sizes = sample.select(*order).orderBy(*order).limit(SAMPLE_ROWS).toArrow()
    keys = list(zip(*(sizes.column(c).to_pylist() for c in order), strict=True))
    while sum(n for *_, n in keys) > SAMPLE_FEATURES:
        keys.pop()
    if not keys:
        return fit([], [])
    draw, doc_id, n = keys[-1]
    chosen = sample.filter(F.struct(*order) <= F.struct(*(F.lit(x).cast("long").alias(c) for c, x in zip(order, (draw, doc_id, n), strict=True)))).orderBy(*order, "features").limit(len(keys)).select("quality", "features").toArrow()
    model = fit([f.as_buffer() for f in chosen.column("features")], chosen.column("quality").to_pylist())
    del chosen
    common.trim()
    return model


def classify(docs: DataFrame, model: Model, pass_on: list[str]) -> DataFrame:
    """docs' columns pass_on, with score (double) and predicted (int); a row for each row of docs(text string).

    Null and empty texts get the score of the bias. Repeated rows get equal scores.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights
    rows = docs.select(*pass_on, *["text"] * ("text" not in pass_on))
    place = rows.columns.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(pass_on)]), "score double, predicted int"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = score(common.blobs(batch.column(place)), shared.value)
        return pa.record_batch([*(batch.column(k) for k in range(len(pass_on))), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*pass_on, "score", "predicted"])

    return common.over_texts(rows, run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, by a model that train() makes.

    Empty tables give empty results; without usable labels every score is a half.
    """
    scored = classify(common.only(docs, doc_id="long", text="string"), train(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(in_fold("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't rejected (predicted 0), with their columns."""
    names = docs.columns
    placed = common.guarded(docs, "text")
    scored = classify(placed, train(docs, labels), placed.columns)
    return scored.filter("predicted = 1").drop("score", "predicted").toDF(*names)
