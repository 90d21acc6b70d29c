import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest_llm import EDGE, LONG, SMALL
from duck import same
from wavemill.llm import exact_dedup, line_dedup, queries, sharding


def lower(t):
    return (t or "").encode().lower()


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[lower(t)]
        best = max((x for x in g if x is not None), default=None)
        out.append((i, best, len(g), i == best, hashlib.sha256(lower(t)).hexdigest()))
    return sorted(map(str, out))


def test_exact_small(spark):
    same(queries.op7_exact_dedup(spark, SMALL), queries.SQL["op7_exact_dedup"], SMALL)


def test_exact_edges(edge, nothing):
    assert sorted(str(tuple(r)) for r in exact_dedup.exact_groups(edge).collect()) == plain_groups(EDGE)
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_exact_long_prefixes(spark):
    body = "Abc " * 4000
    rows = [(k, body + s) for k, s in enumerate(["", "x", "X", "y", "yy", "x"])] + [(10 + k, body[:n]) for k, n in enumerate((31, 32, 33, 544, 544, 545, 8736, 8736, 31))] + [(30, body), (30, body + "x"), (None, "é" * 40), (31, "É" * 40), (32, "é" * 39 + "e"), (33, "é" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in exact_dedup.exact_groups(df).collect()) == plain_groups(rows)


def test_exact_when_the_filter_lets_all_rows_through(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_filter", lambda groups, n: np.full(4, -1))
    rows = [(k, f"text {k // 2}" * (k // 10)) for k in range(60)]
    assert sorted(str(tuple(r)) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == plain_groups(rows)


def plain_lines(rows, min_words=8):
    places = []
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n") if t is not None else []):
            places.append(((i is not None, i or 0), n, line.strip(" \t\r"), i))
    places.sort(key=lambda x: x[:2])

    def near(a, b):
        if a == b:
            return True
        x, y = a.split(" "), b.split(" ")
        if min(len(x), len(y)) < min_words or abs(len(x) - len(y)) > 1:
            return False
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y)) <= 1
        long, short = (x, y) if len(x) > len(y) else (y, x)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    gone, seen = set(), []
    for key, n, form, i in places:
        if form and any(near(form, f) for f, k in seen if k != (key, n)):
            gone.add((i, n))
        seen.append((form, (key, n)))
    return gone


def test_lines_small(spark):
    same(queries.op2_line_dedup(spark, SMALL), queries.SQL["op2_line_dedup"], SMALL)


@pytest.mark.parametrize("min_words", [8, 3, 2])
def test_lines_against_a_loop(spark, min_words):
    rng = random.Random(4)
    base = ["a b c d e f g h i", "a b c d e f g h", "one two three", "x " * 9 + "x", "", "  "]

    def line():
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(words) + 1)
            words[k : k + rng.randrange(2)] = [rng.choice("xyz")] * rng.randrange(2)
        return " ".join(words)

    rows = [(k, "\n".join(line() for _ in range(6))) for k in range(40)]
    gone = plain_lines(rows, min_words)
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_words).collect()}
    for i, t in rows:
        kept = [x for n, x in enumerate(t.split("\n")) if (i, n) not in gone]
        assert out[i]["text"] == "\n".join(kept)
        assert out[i]["n_kept"] == sum(bool(x.strip(" \t\r")) for x in kept)


def test_lines_of_one_word_have_no_neighbourhood(nothing):
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(nothing, 1)


def test_lines_edges(edge, nothing):
    out = line_dedup.dedup_lines(edge)
    assert out.columns == ["doc_id", "text", "lang", "node", "score", "key", "Text", "n_lines", "n_kept"]
    rows = [tuple(r) for r in out.collect()]
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append((r[1], r[-2], r[-1]))
    assert len(rows) == len(EDGE)
    assert by[1] == [(None, 0, 0)] and by[2] == [("", 0, 0)] and by[3] == [(" \n\t ", 0, 0)]
    assert by[7] == [(LONG, 1, 1)] * 2
    assert by[10] == [("same line here with eight words or more\n\nshort", 3, 2)]
    assert by[11] == [("", 2, 0)]
    assert by[5][0][2] == 1 and by[6] == [("", 1, 0)]  # one word apart
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_shards(spark, small):
    rows = sharding.shard_by_bytes(small, 8).collect()
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    bytes_, slots, where = Counter(), defaultdict(list), {}
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        assert where.setdefault(t, r["shard"]) == r["shard"]
        bytes_[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(bytes_) == set(range(8)) and len(rows) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(bytes_.values()) <= 1.02 * sum(bytes_.values()) / 8


def plain_best_fit(items, capacity, most):
    """Sizes from large to small, each to the fullest bin that takes it; the bin of each, or None."""
    left, out = [], []
    for size in sorted(items, reverse=True):
        fits = [(r, k) for k, r in enumerate(left) if r >= size]
        if fits:
            k = min(fits)[1]
            left[k] -= size
        elif len(left) == most:
            return None
        else:
            k = len(left)
            left.append(max(capacity, size) - size)
        out.append((size, k))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_plain_best_fit_decreasing(seed):
    rng = random.Random(seed)
    items = [rng.choice((1, 2, 3, 7, rng.randrange(1, 60), rng.randrange(1, 300))) for _ in range(rng.randrange(1, 200))]
    for capacity, most in ((rng.randrange(40, 400), None), (-(-sum(items) // 8), 8), (-(-sum(items) // 3) + 5, 3)):
        runs = sharding.best_fit_decreasing(dict(Counter(items)), capacity, most)
        want = plain_best_fit(items, capacity, most)
        assert (runs and [(s, k) for s, a, b, k in runs for _ in range(a, b)]) == want


def plain_shards(items, shards):
    """Bins of each size, by trying every capacity."""
    items, out = sorted(items, reverse=True), []
    while items and shards > 1 and items[0] * shards > sum(items):
        out.append([items.pop(0)])
        shards -= 1
    capacity = max([*items[:1], -(-sum(items) // shards)])
    while items and (found := plain_best_fit(items, capacity, shards)) is None:
        capacity += 1
    bins = defaultdict(list)
    for size, k in found if items else []:
        bins[k].append(size)
    return sorted(map(sorted, [*out, *bins.values()]))


def test_shards_are_plain_best_fit_decreasing(spark, small):
    rng = random.Random(5)
    made = [(k, f"{rng.randrange(60)}" * rng.randrange(1, 40)) for k in range(300)] + [(900 + k, None if k % 2 else "") for k in range(9)] + [(950, "z" * 2500), (951, "é" * 4000)]
    for df in (small, spark.createDataFrame(made, "doc_id long, text string").repartition(5)):
        texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        sizes = Counter()
        for _, t in texts:
            sizes[t] += len(t.encode()) + 1
        text_of = dict(texts)
        shard_of = {text_of[r["doc_id"]]: r["shard"] for r in sharding.shard_by_bytes(df, 8).collect()}
        bins = defaultdict(list)
        for t, k in shard_of.items():
            bins[k].append(sizes[t])
        got, want = sorted(map(sorted, bins.values())), plain_shards(list(sizes.values()), 8)
        assert sorted(map(sum, got)) == sorted(map(sum, want)) and got == want


def test_shards_edges(edge, nothing):
    rows = sharding.shard_by_bytes(edge, 8).collect()
    assert len(rows) == len(EDGE)
    assert len({r["shard"] for r in rows if r["size"] == 1}) == 1
    assert sharding.shard_by_bytes(nothing, 8).count() == 0


def test_a_hot_group_has_its_own_shard():
    placed = sharding.balanced({1000: 1, 10: 70}, 8)
    hot = [k for s, a, b, k in placed if s == 1000]
    assert len(hot) == 1 and all(k != hot[0] for s, _, _, k in placed if s == 10)
    assert sorted((k, b - a) for s, a, b, k in placed if s == 10) == [(k, 10) for k in sorted(set(range(8)) - set(hot))]


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing_as_a_list_would_do_it(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 60) for k in range(300)]
    bins, left = [], []
    for size in sorted(sizes, reverse=True):
        fit = min(((r, k) for k, r in enumerate(left) if r >= size), default=None)
        if fit is None:
            bins.append([size])
            left.append(100 - size)
        else:
            bins[fit[1]].append(size)
            left[fit[1]] -= size
    got = defaultdict(list)
    for s, a, b, k in sharding.best_fit_decreasing(dict(Counter(sizes)), 100):
        got[k] += [s] * (b - a)
    assert [got[k] for k in range(len(bins))] == bins
