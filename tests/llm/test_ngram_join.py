import random
import re

import pytest

from conftest_llm import EDGE
from wavemill.llm import ngram_join


def brute(rows, words, num, den):
    sets = {}
    for i, t in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(found[k : k + words]) for k in range(len(found) - words + 1)} or ({tuple(found)} if found else set())
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("words, num, den", [(4, 85, 100), (5, 80, 100), (3, 1, 2)])
def test_small_table(small, small_rows, words, num, den):
    assert result(ngram_join.components(small, words, num, den)) == brute(small_rows, words, num, den)


def altered(rng, base, n):
    words = list(base)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(("the", "of", "to", f"w{rng.randrange(99)}"))
    return " ".join(words)


@pytest.mark.parametrize("rare, probe, hot", [(32, 64, 64), (2, 64, 64), (32, 1, 3), (2, 1, 12)])
def test_groups_of_altered_copies_and_shared_passages(spark, rare, probe, hot, monkeypatch):
    """Pairs of frequent tokens from a few rows on, and hot tokens from a few nodes on."""
    for name, value in (("RARE", rare), ("PROBE", probe), ("HOT_ROWS", hot)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(3)
    bases = [[f"b{k}x{rng.randrange(400)}" for _ in range(n)] for k, n in enumerate((12, 60, 150, 420))]
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [altered(rng, b, rng.randrange(len(b) // 12)) for b in bases for _ in range(60)]
    rows += [passage + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(ngram_join.components(df, 4, 85, 100)) == brute(rows, 4, 85, 100)


def test_edges(spark, edge, nothing):
    got = edge and sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.components(edge, 4, 85, 100).collect())
    assert len(got) == len(EDGE)
    by = {(i, n): c for none, i, n, c in got if not none}
    assert by[1, 0] == 1 and by[2, 0] == 2 and by[3, 0] == 3 and by[4, 1] == 4
    assert by[5, 7] == by[6, 7] == 5
    assert {c for (i, n), c in by.items() if i == 7} == {7}
    assert ngram_join.components(nothing).count() == 0


def test_one_of_each_stays(small, small_rows):
    want = {i for i, (_, c) in brute(small_rows, 5, 80, 100).items() if i == c}
    kept = ngram_join.one_each(small)
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == small.columns


def test_columns_clash(edge):
    assert ngram_join.one_each(edge).columns == edge.columns


def test_long_chains_become_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["component"] for r in ngram_join.connected(links).collect()} == {k: 0 for k in range(1, 41)} | {101: 100}


def brute_links(rows, words, num, den):
    """Rows of another set that each row is linked with, over all pairs."""
    sets = []
    for _, t in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(found[k : k + words]) for k in range(len(found) - words + 1)} or ({tuple(found)} if found else set()))
    near = lambda x, y: x != y and bool(x & y) and den * len(x & y) >= num * len(x | y)
    return sorted((i, sum(near(x, y) for y in sets)) for (i, _), x in zip(rows, sets, strict=True))


@pytest.mark.parametrize("nodes, slab", [(256, 4096), (7, 50)])
def test_every_link_is_counted(spark, nodes, slab, monkeypatch):
    """Links within a component too, between members that aren't its hub, and to every row of a repeated text."""
    monkeypatch.setattr(ngram_join, "PART_NODES", nodes)
    monkeypatch.setattr(ngram_join, "SLAB", slab)
    rng = random.Random(5)
    bases = [[f"b{k}x{rng.randrange(400)}" for _ in range(n)] for k, n in enumerate((20, 60, 150))]
    texts = [altered(rng, b, rng.randrange(len(b) // 12)) for b in bases for _ in range(40)]
    rows = list(enumerate([*texts, *texts[::5], texts[45], texts[45].upper(), "alone in here with its own words", "", None]))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = ngram_join.components(df, 4, 85, 100)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    want = brute_links(rows, 4, 85, 100)
    assert sum(n for _, n in want) > 2 * len(rows)
    assert sorted((r["doc_id"], r["n_links"]) for r in out.collect()) == want
    assert result(out) == brute(rows, 4, 85, 100)


def test_links_of_small_table(small, small_rows):
    got = sorted((r["doc_id"], r["n_links"]) for r in ngram_join.components(small, 5, 80, 100).collect())
    assert got == brute_links(small_rows, 5, 80, 100)


def test_links_of_a_single_frequent_token(spark):
    """At 1/2, {a} is linked with every {a, b}, though a is in too many sets to be a key at first."""
    rows = [(0, "a b c d")] + [(k, f"a b c d w{k}") for k in range(1, 41)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.components(df, 4, 1, 2)
    assert result(got) == brute(rows, 4, 1, 2) == {0: (1, 0)} | {k: (2, 0) for k in range(1, 41)}
    assert sorted((r["doc_id"], r["n_links"]) for r in got.collect()) == brute_links(rows, 4, 1, 2)


def test_components_are_never_returned_unfinished(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        ngram_join.connected(links, most=1)


def test_words_of_a_linear_hash_are_told_apart(spark):
    """Thue-Morse words, whose sums of bytes times powers of one odd number agree modulo 2**64."""
    twins = [bytes(b"ab"[(bin(i).count("1") + k) & 1] for i in range(2048)).decode() for k in (0, 1)]
    rows = [(k + 1, t) for k, t in enumerate(twins)]
    assert result(ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)) == {1: (1, 1), 2: (1, 2)}
