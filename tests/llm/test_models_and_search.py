import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from conftest_llm import EDGE, SMALL
from duck import same
from wavemill.llm import pii, quality, queries, topk


def test_top_k_small(spark):
    same(queries.op4_exact_top_k(spark, SMALL), queries.SQL["op4_exact_top_k"], SMALL)


def plain_top(vectors, queries_, k):
    out = []
    for qi, q in queries_:
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != qi))[:k]
        out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("tiles", [(16384, 2048), (40, 3)])
@pytest.mark.parametrize("size", [6, 40000, 2**28])
def test_top_k_with_ties_and_sizes(spark, monkeypatch, tiles, size):
    monkeypatch.setattr(topk, "CANDIDATES", tiles[0])
    monkeypatch.setattr(topk, "QUERIES", tiles[1])
    rng = random.Random(size)
    vectors = [(k, [rng.randrange(-size, size) // rng.choice((1, 1, 9)) for _ in range(20)]) for k in range(150)]
    vectors += [(200 + k, v) for k, (_, v) in enumerate(vectors[:20])]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.top_k(df.filter("vec_id % 10 = 0"), df, 7).collect())
    assert got == plain_top(vectors, [x for x in vectors if x[0] % 10 == 0], 7)


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.5, -0.0004]), (None, [1.0, 1.0]), (100, [1.0, 1.0]), (5, [0.5, -0.0004]), (6, [])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted((r["vec_id"], r["v"]) for r in v.collect()) == [(0, [1024, 2048]), (5, [512, -1]), (5, [512, -1]), (6, []), (100, [1024, 1024])]
    got = [tuple(r) for r in topk.top_k(v.filter("vec_id % 100 = 0"), v, 10).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(0, 1, 100, 1024 * 3072), (0, 2, 5, 512 * 1024 - 2048), (0, 3, 5, 512 * 1024 - 2048), (0, 4, 6, 0)]
    empty = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(empty, empty).count() == 0


def test_top_k_takes_clashing_columns_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 8)
    rows = [(k % 30, [k % 7, -k, 3], k, "x", 0.5) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, query_id long, score string, floor double").repartition(3)
    queries_ = {}
    for i, v, *_ in rows:
        if i % 10 == 0:
            queries_[i] = min(v, queries_.get(i, v))
    got = sorted(tuple(r) for r in topk.top_k(df.filter("vec_id % 10 = 0"), df, 5).collect())
    assert got == plain_top([r[:2] for r in rows], list(queries_.items()), 5)


KINDS = ("email", "ip", "card", "phone")


def plain_pii(text):
    """The patterns just as they are stated."""
    text = text or ""
    luhn = lambda s: sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, s[::-1]))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = random.Random(8)
    parts = ["a", "Z9", ".", "@", "-", "%", "+", " ", "1", "12", "255", "256", "4041 8949 7460 8795", "4041894974608795", "+1 (555) 123-4567", "(", ")", "é", "\n", "a.b@c.de", "@@", "10.0.0.1", "000", "x@y"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == plain_pii(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 4000 + "." + "2" * 4000, "a@" * 100_000, "+1" + "(" * 300_000, "1." * 100_000, "a@b." * 50_000):
        pii.candidates(text)


def rows_of(texts):
    out = []
    for i, t in texts:
        spans = plain_pii(t)
        named = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        out.append((i, *(sum(k == n for _, k, _ in spans) for n in range(4)), hashlib.sha256(named.encode()).hexdigest()))
    return sorted(map(str, out))


def test_pii_rows(small, small_rows, edge, nothing):
    for df, rows in ((small, small_rows), (edge, EDGE)):
        got = pii.find(df).collect()
        assert sorted(str(tuple(r)[:6]) for r in got) == rows_of(rows)
    assert pii.find(nothing).count() == 0


def test_labelers_add_spans_that_others_speak_for(spark):
    texts = [(k, f"please call phone 555-0{k:02d}-1234 or +1 (555) 222-{1000 + k}, mail x{k}@mail.com or y{k} [at] mail [dot] com") for k in range(60)]
    texts += [(100 + k, f"plain 123 456 7890 and a.b at c, nothing (at) all {k}") for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert sorted(str(tuple(r)[:6]) for r in rows.values()) == rows_of(texts)
    assert all(rows[k]["spans"].count("phone:") == 2 for k in range(60))
    assert all(rows[100 + k]["spans"] == "" for k in range(60))


def planted_pii(n, seed):
    """(text, its loose spans that are personal data, those that aren't), of all four kinds."""
    rng = random.Random(seed)
    card = "4041894974608795"
    rows = []
    for _ in range(n):
        real = [f"{rng.choice(('mail', 'contact', 'write to'))} {rng.choice('abc')}x{rng.randrange(99)} [at] site{rng.randrange(9)} [dot] {rng.choice(('com', 'org', 'net'))}"[:],
                f"{rng.choice(('server', 'host', 'login'))} {rng.randrange(1, 255)}[.]{rng.randrange(255)}[.]{rng.randrange(255)}[.]{rng.randrange(255)}",
                f"{rng.choice(('card', 'visa', 'payment'))} {rng.choice('._/').join(card[k : k + 4] for k in range(0, 16, 4))}",
                f"{rng.choice(('phone', 'call', 'fax'))} {rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"]
        fake = [f"{rng.choice(('version', 'part', 'ref'))} {rng.randrange(1, 9)}. {rng.randrange(9)}. {rng.randrange(9)}. {rng.randrange(9)}",
                f"{rng.choice(('order', 'serial', 'invoice'))} {rng.randrange(1000, 2000)}/{rng.randrange(1000, 9999)}/{rng.randrange(1000, 9999)}/{rng.randrange(100, 999)}",
                f"{rng.choice(('order', 'invoice', 'ref'))} 1{rng.randrange(10, 99)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"]
        base = rng.sample([f"mail q{rng.randrange(99)}@mail.com", "ip 10.1.2.3", f"card {card}", "phone +1 (555) 222-1000"], rng.randrange(3))
        r, f = rng.sample(real, rng.randrange(3)), rng.sample(fake, rng.randrange(2))
        parts = r + f + base
        rng.shuffle(parts)
        rows.append((". Then the ".join(["So", *parts, "end"]), len(r), len(f), len(base)))
    return rows


def test_added_spans_precision_and_recall(spark):
    rows = planted_pii(1500, 6)
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "doc_id long, text string")
    right = wrong = missed = 0
    for r in pii.find(df).collect():
        text, real, fake, base = rows[r["doc_id"]]
        spans = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s]
        added = [s for s in spans if s not in {(a, b) for a, _, b in plain_pii(text)}]
        lead = re.compile("(version|part|ref|order|serial|invoice) ?$")
        bad = sum(bool(lead.search(text[:a])) for a, _ in added)
        right, wrong, missed = right + len(added) - bad, wrong + bad, missed + real - (len(added) - bad)
    precision, recall = right / (right + wrong), right / (right + missed)
    print(f"precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.95 and recall > 0.95


def test_redaction(spark, edge):
    df = spark.createDataFrame([(1, "to a@b.cc now, 4041894974608795 and 10.0.0.1!", "x"), (2, None, "y"), (3, "none", None)], "doc_id long, text string, extra string")
    assert [tuple(r) for r in pii.redact(df).orderBy("doc_id").collect()] == [(1, "to <EMAIL> now, <CARD> and <IP>!", "x"), (2, None, "y"), (3, "none", None)]
    assert pii.redact(edge).columns == edge.columns and pii.redact(edge).count() == len(EDGE)


def test_features_of_pieces_and_of_the_whole_agree(monkeypatch):
    rng = np.random.default_rng(2)
    weights = rng.normal(size=quality.WORDS + quality.GRAMS).astype(np.float32)
    texts = [b"", b"a", b"ab cd", b"x y x y y y " * 40, "héé wörld ".encode() * 70, b"q" * 900, b"one two two three"]
    whole = [weights[quality.features(t)].mean(dtype=np.float64) if t else 0.0 for t in texts]
    assert np.allclose(quality.sums(texts, weights), whole, atol=1e-6)
    monkeypatch.setattr(quality.hashing, "BLOCK", 64)
    assert np.allclose(quality.sums(texts[:5] + texts[6:], weights), whole[:5] + whole[6:], atol=0.02)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op3_quality_classifier(spark, folder).collect()
    assert len(rows) == 10000
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    good, bad = [s for s, q, _ in held if q == 1], [s for s, q, _ in held if q == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.97
    assert sum(p == q for _, q, p in held) / len(held) > 0.95


def test_scores_against_a_plain_version(spark, small, small_rows):
    """Words and n-grams one by one, and a training loop over dictionaries."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    rows = dict(small_rows)

    def bucket_counts(text):
        raw, out, before = text.encode(), {}, None
        for word in re.findall(rb"[^\x20\x09-\x0D]+", raw):
            h = int(quality.hashing.word_hashes(np.frombuffer(word, np.uint8), False)[0][0])
            out_key = quality.WORDS - 1 if word == before else h >> 49
            out[out_key] = out.get(out_key, 0) + 1
            before = word
        for at in range(len(raw)):
            gram = int.from_bytes(raw[at : at + 4].ljust(4, b"\0"), "little") * 2654435761 % 2**32 >> 16
            out[quality.WORDS + gram] = out.get(quality.WORDS + gram, 0) + 1
        return out

    draw = {r["doc_id"]: r["d"] for r in small.selectExpr("doc_id", "xxhash64(doc_id) as d").collect()}
    order = sorted((i for i in known if i in rows), key=lambda i: (draw[i], i))
    rng = np.random.default_rng(quality.SEED)
    vectors = rng.uniform(-1 / quality.DIMS, 1 / quality.DIMS, (quality.WORDS + quality.GRAMS, quality.DIMS))
    layer, bias, done = np.zeros((2, quality.DIMS)), np.zeros(2), 0
    for _ in range(quality.EPOCHS):
        for k in rng.permutation(len(order)):
            rate = quality.RATE * (1 - done / (quality.EPOCHS * len(order)))
            done += 1
            counts = bucket_counts(rows[order[k]])
            total = sum(counts.values())
            mean = sum(n / total * vectors[f] for f, n in counts.items())
            z = layer @ mean + bias
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum() - np.eye(2)[known[order[k]]]
            down = p @ layer
            layer, bias = layer - rate * np.outer(p, mean), bias - 0.1 * rate * p
            for f, n in counts.items():
                vectors[f] -= rate * quality.LIFT * n / total * down
    got = {r["doc_id"]: r["score"] for r in quality.quality(small, labels).collect()}
    for i, text in rows.items():
        counts = bucket_counts(text)
        mean = sum(n * vectors[f] for f, n in counts.items()) / max(1, sum(counts.values()))
        z = (layer[1] - layer[0]) @ mean + bias[1] - bias[0] if counts else bias[1] - bias[0]
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 0.02, i


def test_packed_features_keep_their_shares():
    for text in (b"", b"a", b"one two one " * 500, bytes(range(256)) * 9):
        found, share = quality.unpacked(quality.packed(text))
        want, times = np.unique(quality.features(text), return_counts=True)
        assert found.tolist() == want.tolist() and np.allclose(share, times / max(1, times.sum()), rtol=1e-3)


def test_quality_edges(spark, edge, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality(edge, none).collect()} == {0.5}
    labels = spark.createDataFrame([(k, k % 2) for k in range(-12, 12)] + [(None, 1), (5, None), (6, 9)], "doc_id long, quality int")
    rows = quality.quality(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality(nothing, labels).count() == 0
    assert quality.keep_good(edge, labels).columns == edge.columns
