"""N-gram Jaccard join: token-combination prefixes, then exact verification, then connected components.

Vocabulary: a document's set holds the hashes (64 bits) of its distinct shingles; documents of equal sets are one node,
named by a digest of the set. Two nodes are linked if their sets' Jaccard similarity reaches the threshold t.

Candidates. For nodes of similar size a universe of shingles is fixed (all whose hash is below a bound), and a node's
tokens are those of its shingles that lie in it. If x and y are linked, at most tau tokens of x are missing from y:
n - ceil(t n) of the larger, and no more than n - ceil(2 t n / (1 + t)) of the smaller. Take any global order of tokens and any partition into classes, class c with
k_c-token combinations: if a prefix of x holds n_c tokens of class c with sum(max(0, n_c - k_c + 1)) > tau, then some
class has k_c tokens that y shares, and y's own prefix holds them too (whichever prefix ends first, all it shares with
the other lies in the other's). So linked nodes share a combination within their prefixes. Here tokens that no other node
has are a class that needs no index, tokens of up to RARE rows are single keys, and frequent tokens are spread by hash
over small classes of pairs; the order goes from rare to frequent. So a passage that many documents hold is hardly ever
in a prefix, and where it is, it takes two of its tokens to make a key.

Tokens that a large share of nodes have are told beforehand by the nodes whose digest falls in a fixed share. They count
as the most frequent ones and skip the counting, so that their rows, spread by node, never meet in one task.

This is done twice. First for all nodes, in universes that hold just as many shingles as prefixes need; nodes that share
no key are done. Then for the nodes that are left, with all of their shingles, counted among themselves: what tells
altered copies apart is rare there, so that prefixes of those that aren't linked hardly reach what they have in common.

Links. Nodes of one key are first verified against the key's hub only, its node whose tokens are the most frequent (the
original of a group of altered copies rather than one of them): copies meet in a few links, never in all pairs. Only nodes of one key that are still in different components are then compared with each other, unless the
triangle inequality of the Jaccard distance, by way of the hub, rules a link out. No link that could join two
components is left out.

These links only span the components. Where links are to be counted, all pairs of nodes of one component are compared,
since no link leaves a component: a component is cut into parts, and each two parts are one tile, whose pairs meet in a
task as a product of matrices and leave as counts. So rows grow with a component's nodes times its parts, never with its pairs.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wavemill.llm import common, hashing

#: Tokens of at most so many rows are single keys.
RARE = 32

#: One node in PROBE shows which tokens are hot: those of at least HOT_ROWS of them, and of one in HOT_SHARE. So there are
#: at most HOT_SHARE times as many hot tokens as an average node has tokens. ROWS is the row count they are given.
PROBE, HOT_ROWS, HOT_SHARE, ROWS = 64, 64, 500, 1 << 40

#: Sizes of sets below which nodes share a universe, for the first; each later one spans GROWTH times as much.
FIRST, GROWTH, LEVELS = 16, 4, 16

#: Nodes that a task remembers to have sent.
SEEN = 500_000

#: Nodes and shingles of one part of a component, on average at most; shingles that are counted at once in a tile.
PART_NODES, PART_SHINGLES, SLAB = 256, 1 << 20, 1 << 12


@dataclass(frozen=True)
class Level:
    number: int
    low: int  # smallest and one past the largest set
    high: int
    bound: int  # shingles of the universe are below
    classes: int  # of frequent tokens


@dataclass(frozen=True)
class Measure:
    """Shingles of `words` words; linked from num / den on."""

    words: int
    num: int
    den: int
    whole: bool = False  # universes hold all shingles
    single: bool = False  # frequent tokens are one class, so that prefixes are always long enough

    def tau(self, n: int) -> int:
        """Shingles of a set that one no larger may miss."""
        return n - -(-self.num * n // self.den)

    def tau_small(self, n: int) -> int:
        """Shingles of a set that one no smaller may miss."""
        return n - -(-2 * self.num * n // (self.num + self.den))

    def may(self, x: str, y: str):
        """Whether nodes of one key can be linked, by the columns n, alone and small of each.

        The key must lie in the prefix of the smaller one as such (of both, if they are equally large), and what each
        may share at most, all but the tokens it has alone, must reach what a link takes.
        """
        nx, ny, ax, ay, sx, sy = (F.col(c) for c in (f"n{x}", f"n{y}", f"alone{x}", f"alone{y}", f"small{x}", f"small{y}"))
        role = F.when(nx < ny, sx).when(nx > ny, sy).otherwise(sx & sy)
        reach = lambda n, alone: F.lit(self.num + self.den) * (n - alone) >= F.lit(self.num) * (nx + ny)
        return role & reach(nx, ax) & reach(ny, ay) & (F.lit(self.den) * F.least(nx, ny) >= F.lit(self.num) * F.greatest(nx, ny))

    @property
    def least(self) -> int:
        """The smallest set that can be linked with a different one."""
        return -(-self.num // (self.den - self.num)) if self.num < self.den else 1 << 60

    def levels(self) -> list[Level]:
        out, low, high, t = [], 0, FIRST, 1 - self.num / self.den
        for k in range(LEVELS):
            share = 1.0 if self.whole or not low else min(1.0, 2.2 * t + 1.2 / math.sqrt(max(low * t, 1e-9)))
            classes = 1 if self.single else max(1, int(high * share / 16))
            out.append(Level(k, low, high if k < LEVELS - 1 else 1 << 62, int(share * (1 << 64)) if share < 1 else 1 << 64, classes))
            low, high = -(-high * self.num // self.den), high * GROWTH
        return out

    def of(self, n: int, levels: list[Level]) -> list[Level]:
        return [v for v in levels if v.low <= n < v.high] if n >= self.least else []


_ODD = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C3B1A4F7E2D5C61, 0xD6E8FEB86659FD93)]


def _combine(columns: list[np.ndarray], seed: int) -> np.ndarray:
    total = np.uint64(seed)
    for k, c in enumerate(columns):
        total = total + hashing.mixed(c + np.uint64(k + 1)) * _ODD[k % 8]
        total = total ^ (total >> np.uint64(29))
    return hashing.mixed(total)


def shingles(texts: list[bytes], words: int):
    """The sorted distinct shingle hashes of each text, in order."""
    with np.errstate(over="ignore"):
        for _, hashes, per in hashing.document_words(texts):
            n = len(hashes) - words + 1
            all_ = _combine([hashes[k : k + n] for k in range(words)], 0) if n > 0 else np.zeros(0, np.uint64)
            at = 0
            for m in per.tolist():
                if m >= words:
                    yield np.unique(all_[at : at + m - words + 1])
                elif m:
                    yield _combine([hashes[at + k : at + k + 1] for k in range(m)], m)
                else:
                    yield np.zeros(0, np.uint64)
                at += m


def _digest(found: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = hashing.mixed(found).sum(dtype=np.uint64) + np.uint64(len(found))
        b = hashing.mixed(found ^ _ODD[0]).sum(dtype=np.uint64) * _ODD[1]
    return int(a.astype(np.int64)), int(b.astype(np.int64))


_SETS = {"doc_id": pa.int64(), "n": pa.int64(), "node": pa.int64(), "twin": pa.int64(), "sizes": pa.list_(pa.int64()), "probe": pa.list_(pa.int64())}


def _texts(docs: DataFrame) -> DataFrame:
    return common.only(docs, doc_id="long", text="string")


def _sets(docs: DataFrame, measure: Measure) -> DataFrame:
    levels = measure.levels()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, node, twin, sizes, probe = [], [], [], [], []
        for found in shingles(common.blobs(batch.column("text")), measure.words):
            a, b = _digest(found)
            n.append(len(found))
            node.append(a)
            twin.append(b)
            of = measure.of(len(found), levels)
            sizes.append([int(np.searchsorted(found, np.uint64(v.bound))) if v.bound < 1 << 64 else len(found) for v in of])
            probe.append(np.concatenate([_salted(_marked(found, v).view(np.int64), 0, np.zeros(0, np.int64)) for v in of]) if of and b % PROBE == 0 else None)
        return common.record(_SETS, batch.column("doc_id"), n, node, twin, sizes, probe)

    return common.over_texts(docs, run, "doc_id long, n long, node long, twin long, sizes array<long>, probe array<long>")


def _hot(nodes: DataFrame) -> np.ndarray:
    """The hot tokens, sorted, by nodes(probe): few enough to send to every task."""
    probes = nodes.filter("probe is not null").select("probe")
    least = max(HOT_ROWS, -(-probes.count() // HOT_SHARE))
    found = probes.select(F.explode("probe").alias("token")).groupBy("token").count().filter(F.col("count") >= least)
    return np.array(sorted(r["token"] for r in found.select("token").collect()), np.int64)


def _salted(tokens: np.ndarray, node: int, hot: np.ndarray) -> np.ndarray:
    """Tokens as they are counted: a hot one by its number among them, with a salt of the node and its level.

    Those have eight set bits in front, which no other token has: 0xFF, number (36 bits), salt (16), level (4).
    """
    front = np.int64(-1 << 56)
    taken = (tokens >= front) & (tokens < 0)
    tokens = np.where(taken, tokens & np.int64((1 << 56) - 1), tokens)
    if not len(hot):
        return tokens
    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
    named = front | (at.astype(np.int64) << np.int64(20)) | np.int64((node & 0xFFFF) << 4) | (tokens & np.int64(15))
    return np.where(hot[at] == tokens, named, tokens)


def _marked(found: np.ndarray, level: Level) -> np.ndarray:
    """Shingles as tokens of a level."""
    with np.errstate(over="ignore"):
        mixed = hashing.mixed(found + _ODD[2] * np.uint64(level.number + 1))
    return (mixed & ~np.uint64(15)) | np.uint64(level.number)


_TOKENS = {"token": pa.int64(), "node": pa.int64()}


def _tokens(docs: DataFrame, measure: Measure, hot: np.ndarray) -> DataFrame:
    """Rows of _TOKENS of every node, once a task at least; a token's last four bits are its level."""
    levels = measure.levels()

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, common.BATCH_ROWS):
                tokens, nodes = [], []
                for found in shingles(common.blobs(batch.slice(at, common.BATCH_ROWS).column("text")), measure.words):
                    of = measure.of(len(found), levels)
                    if not of:
                        continue
                    node = _digest(found)[0]
                    if node in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()  # nodes met again send their tokens again, which are counted alike by all that have them
                    seen.add(node)
                    for v in of:
                        mine = found[: np.searchsorted(found, np.uint64(v.bound))] if v.bound < 1 << 64 else found
                        tokens.append(_salted(_marked(mine, v).view(np.int64), node, hot))
                        nodes.append(np.full(len(mine), node, np.int64))
                if tokens:
                    yield common.record(_TOKENS, np.concatenate(tokens), np.concatenate(nodes))

    return common.in_python(docs.select("text"), run, "token long, node long")


def keys_of(n: int, sizes: list[int], tokens: np.ndarray, rows: np.ndarray, measure: Measure, levels: list[Level], rare: int = RARE) -> tuple[list[tuple[int, int, bool]], bool]:
    """A node's keys, and whether they are enough: (key, tokens it has alone, in its prefix as the smaller of a pair).

    tokens: those that other nodes have too, with their row counts.
    """
    keys: list[tuple[int, int, bool]] = []
    enough = True
    level_of = tokens & 15
    for level, size in zip(measure.of(n, levels), sizes, strict=True):
        mine = level_of == level.number
        alone = size - int(np.count_nonzero(mine))
        need, need_small = measure.tau(n) + 1 - alone, measure.tau_small(n) + 1 - alone
        if need <= 0:
            continue
        own, count = tokens[mine], rows[mine]
        order = np.lexsort((own, count))
        classes: dict[int, list[int]] = {}
        for frequent, token in zip((count[order] > rare).tolist(), own[order].tolist(), strict=True):
            if need <= 0:
                break
            small = need_small > 0
            if not frequent:
                keys.append((token, alone, small))
                counts = 1
            else:
                members = classes.setdefault((((token * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> 32) % level.classes, [])
                for other in members:
                    x = ((token ^ 0x5851F42D4C957F2D) * (other | 1) + (other ^ token) * 0x14057B7EF767814F + (other + token)) & (2**64 - 1)
                    x = ((x ^ (x >> 31)) * 0x7FB5D329728EA185) & (2**64 - 1)
                    keys.append(((x ^ (x >> 27)) - (1 << 63), alone, small))
                counts = bool(members)
                members.append(token)
            need, need_small = need - counts, need_small - counts
        if need > 0 and measure.single:
            # Sets of which one shingle is enough for a link: pairs don't fill their prefix, which is all their tokens.
            keys += [(token, alone, True) for token in own[count > rare].tolist()]
            need = 0
        enough = enough and need <= 0
    return keys, enough


_KEYS = {"key": pa.int64(), "node": pa.int64(), "n": pa.int64(), "alone": pa.int64(), "small": pa.bool_(), "rank": pa.int64(), "enough": pa.bool_()}


def _keys(nodes: DataFrame, shared: DataFrame, measure: Measure) -> DataFrame:
    """Rows of _KEYS: one for each key, and one without a key for a node whose keys aren't enough.

    rank is low for a node whose tokens are frequent on average, those of its own counting 1.
    """
    levels, rare = measure.levels(), RARE
    lists = shared.groupBy("node").agg(F.collect_set(F.struct("token", "rows")).alias("shared"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        found = batch.column("shared")
        flat = found.flatten()
        tokens, counts = flat.field("token").to_numpy(zero_copy_only=False), flat.field("rows").to_numpy(zero_copy_only=False)
        ends = np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        for node, n, sizes, end in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("sizes").to_pylist(), ends.tolist(), strict=True):
            keys, enough = keys_of(n, sizes, tokens[at:end], counts[at:end], measure, levels, rare)
            if keys or not enough:
                size = max(1, sum(sizes))
                rank = -(1000 * (int(np.minimum(counts[at:end], 1 << 20).sum()) + size - (end - at)) // size)
                made += [(key, node, n, alone, small, rank, enough) for key, alone, small in (keys if enough else [(None, 0, True)])]
            at = end
        return common.record(_KEYS, *(zip(*made, strict=True) if made else [[]] * len(_KEYS)))

    return common.over_texts(nodes.join(lists, "node").select("node", "n", "sizes", "shared"), run, "key long, node long, n long, alone long, small boolean, rank long, enough boolean")


def _verify(pairs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """pairs(a, b) with both (shared shingles) and either (of the union)."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    out = {"a": pa.int64(), "b": pa.int64(), "both": pa.int64(), "either": pa.int64()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both, either = [], []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            n = len(np.intersect1d(x, y, assume_unique=True))
            both.append(n)
            either.append(len(x) + len(y) - n)
        return common.record(out, batch.column("a"), batch.column("b"), both, either)

    return common.over_texts(pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b"), run, "a long, b long, both long, either long")


def _tile_links(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, weights: np.ndarray, num: int, den: int, slab: int) -> np.ndarray:
    """For each set, the weights of those it is linked with, of pairs of a `first` and a `second` one (indices; the same ones or none in common)."""
    n = np.array([len(x) for x in sets], np.int64)
    _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, several = np.repeat(np.arange(len(sets)), n), seen > 1
    row, token = row[several[token]], (np.cumsum(several) - 1)[token[several[token]]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    both = np.zeros((len(first), len(second)), np.int64)
    for at in range(0, int(several.sum()), slab):
        lo, hi = np.searchsorted(token, [at, at + slab])
        holds = np.zeros((len(sets), int(token[hi - 1]) + 1 - at), np.float32)
        holds[row[lo:hi], token[lo:hi] - at] = 1
        both += (holds[first] @ holds[second].T).astype(np.int64)
    linked = (both > 0) & (den * both >= num * (n[first][:, None] + n[second][None, :] - both))
    out = np.zeros(len(sets), np.int64)
    if np.array_equal(first, second):
        np.fill_diagonal(linked, False)
        out[first] = linked @ weights[first]
    else:
        out[first], out[second] = linked @ weights[second], linked.T @ weights[first]
    return out


def link_counts(full: DataFrame, comps: DataFrame, weights: DataFrame, measure: Measure) -> DataFrame:
    """(node, n_links) of all nodes of components(node, component): the weights(node, weight) of all nodes each is linked with."""
    num, den, slab = measure.num, measure.den, SLAB
    member = comps.select("node", "component").unionByName(comps.select(F.col("component").alias("node"), "component").distinct())
    member = common.keep(member.join(full.select("node", "n"), "node"), "grouped")
    parts = F.ceil(F.greatest(F.count("*") / PART_NODES, F.sum("n") / PART_SHINGLES)).cast("int")
    member = member.join(member.groupBy("component").agg(parts.alias("parts")), "component")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tiles = member.select("node", "component", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiles = tiles.select("node", "component", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    rows = tiles.join(weights, "node").join(full.select("node", "set"), "node").select("component", "lo", "hi", "part", "node", "weight", "set")
    rows = rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    out = {"node": pa.int64(), "n_links": pa.int64()}

    def counted(tile, found) -> pa.RecordBatch:
        part, node, weight, sets = zip(*found, strict=True)
        part = np.array(part)
        first, second = np.flatnonzero(part == tile[1]), np.flatnonzero(part == tile[2])
        return common.record(out, node, _tile_links(list(sets), first, second, np.array(weight, np.int64), num, den, slab))

    def run(batches):
        tile, found = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "lo", "hi", "part", "node", "weight")]
            for component, lo, hi, part, node, weight, data in zip(*columns, batch.column("set"), strict=True):
                if (component, lo, hi) != tile:
                    if found:
                        yield counted(tile, found)
                    tile, found = (component, lo, hi), []
                found.append((part, node, weight, np.frombuffer(data.as_buffer(), "<u8")))
        if found:
            yield counted(tile, found)

    return common.in_python(rows, run, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def connected(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component) of links(a, b): the smallest node each can reach; nodes without a link have no row.

    Alternates two steps on the links, each of which hangs every node's neighbours on its smallest one, until nothing
    changes; beyond `most` rounds it is an error. Links only are shuffled; each round is written to the shared folder.
    """
    edges = common.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for done in itertools.count():
        if done == most:
            raise RuntimeError(f"links still change after {most} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        hung = wide.join(low, "u")
        edges = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = common.keep(edges, "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _counted(tokens: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """Keys of nodes(node, n, sizes) from rows of _TOKENS."""
    by_token = Window.partitionBy("token")
    counted = tokens.select("token", "node", F.count("*").over(by_token).alias("rows"), F.min("node").over(by_token).alias("lo"), F.max("node").over(by_token).alias("hi"))
    is_hot, unsalted = F.col("token") >= (-1 << 56), F.col("token").bitwiseAND(F.lit(~(0xFFFF << 4)))
    is_hot = is_hot & (F.col("token") < 0)
    shared = counted.filter((F.col("lo") != F.col("hi")) | is_hot)
    shared = shared.select(F.when(is_hot, unsalted).otherwise(F.col("token")).alias("token"), "node", F.when(is_hot, ROWS).otherwise(F.col("rows")).alias("rows"))
    shared = common.keep(shared, "shared")
    return common.keep(_keys(nodes, shared, measure), "keys")


def _members(keyed: DataFrame, measure: Measure) -> DataFrame:
    """Nodes of keys on which some node may be linked with a smaller or equal one: node and hub (_b) of each key."""
    several = keyed.groupBy("key").agg(F.min(F.struct("rank", "node", "n", "alone", "small")).alias("hub"), F.count("*").alias("m"), F.max("small").alias("some")).filter("m > 1 and some")
    several = common.keep(several.select("key", *(F.col(f"hub.{c}").alias(f"{c}_b") for c in ("node", "n", "alone", "small"))), "groups")
    return common.keep(keyed.join(common.small(several, 2 * several.count()), "key").select("key", "node", "n", "alone", "small", "node_b", "n_b", "alone_b", "small_b"), "members")


def _all_tokens(full: DataFrame, measure: Measure, hot: np.ndarray) -> DataFrame:
    """Rows of _TOKENS of full(node, set), all shingles of each."""
    levels = measure.levels()

    def run(batches):
        for batch in batches:
            for node, data in zip(batch.column("node").to_pylist(), batch.column("set").to_pylist(), strict=True):
                found = np.frombuffer(data, "<u8")
                for v in measure.of(len(found), levels):
                    yield common.record(_TOKENS, _salted(_marked(found, v).view(np.int64), node, hot), np.full(len(found), node, np.int64))

    return common.in_python(full, run, "token long, node long")


def node_components(docs: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(sets of all rows, full(node, n, set) of the nodes that may be linked, components(node, component)); the last two None without any."""
    docs = _texts(docs)
    sets = common.keep(_sets(docs, measure), "sets")
    nodes = common.keep(sets.filter(F.size("sizes") > 0).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sizes").alias("sizes"), F.first("probe").alias("probe")), "nodes")
    hot = _hot(nodes)
    keyed = _counted(_tokens(docs, measure, hot), nodes, measure)
    if not measure.single and keyed.filter("not enough").limit(1).count():
        return node_components(docs, Measure(measure.words, measure.num, measure.den, True, True))
    wanted = _members(keyed, measure).select("node").distinct()
    chosen = common.keep(nodes.join(wanted, "node").select(F.col("doc_id").alias("id"), F.col("node").alias("want")), "chosen")
    count = chosen.count()
    if not count:
        return sets, None, None

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(shingles(common.blobs(batch.column("text")), measure.words))
        return common.record({"node": pa.int64(), "want": pa.int64(), "set": pa.binary()}, [_digest(s)[0] for s in found], batch.column("want"), [s.astype("<u8").tobytes() for s in found])

    texts = docs.join(common.small(chosen, count), docs["doc_id"].eqNullSafe(chosen["id"])).select("text", "want")
    full = common.keep(common.over_texts(texts, whole, "node long, want long, set binary").filter("node = want").select("node", F.expr("length(set) div 8").alias("n"), "set").dropDuplicates(["node"]), "full")

    left = nodes.join(chosen.select(F.col("want").alias("node")), "node", "left_semi")
    for single in (False, True):
        again = Measure(measure.words, measure.num, measure.den, True, single)
        # A node has all its shingles in each universe that it is in.
        sized = left.select("node", "n", F.transform("sizes", lambda _: F.col("n")).alias("sizes"))
        keyed = _counted(_all_tokens(full, again, hot), sized, again)
        if single or not keyed.filter("not enough").limit(1).count():
            break
    members = _members(keyed, measure)
    pairs = members.filter(F.col("node") != F.col("node_b")).filter(measure.may("", "_b")).select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
    stars = common.keep(_verify(pairs, full, measure), "stars")
    linked = F.lit(measure.den) * F.col("both") >= F.lit(measure.num) * F.col("either")
    links = stars.filter(linked)
    comps = connected(links)

    # Nodes of one key in different components; d is the distance from the hub where it has been measured.
    part = comps.select("node", "component")
    far = stars.select(F.col("a").alias("node"), F.col("b").alias("node_b"), (1 - F.col("both") / F.col("either")).alias("d"))
    placed = members.join(part, "node", "left").join(far, ["node", "node_b"], "left")
    placed = placed.select("key", "node", "n", "alone", "small", F.coalesce("component", "node").alias("component"), "d", (F.col("node") == F.col("node_b")).alias("is_hub"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).filter("lo <> hi and m > 2").select("key")
    rest = common.keep(placed.join(open_, "key").filter("not is_hub"), "rest")
    y = rest.select("key", *(F.col(c).alias(f"{c}_y") for c in ("node", "n", "alone", "small", "component", "d")))
    limit = 1 - measure.num / measure.den + 1e-9
    apart = F.coalesce(F.abs(F.col("d") - F.col("d_y")) <= limit, F.lit(True))
    more = rest.join(y, "key").filter((F.col("node") > F.col("node_y")) & (F.col("component") != F.col("component_y")) & apart & measure.may("", "_y"))
    more = more.select(F.col("node").alias("a"), F.col("node_y").alias("b"))
    more = common.keep(more.distinct(), "more")
    if more.limit(1).count():
        found = common.keep(_verify(more, full, measure).filter(linked), "found")
        if found.limit(1).count():
            links = links.unionByName(found)
            comps = connected(links)
    return sets, full, comps


def components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, the smallest doc_id that links reach, and n_links.

    n_links is the number of rows with a different set that the row is linked with, each counted, whatever component it's in.

    A set holds the distinct shingles of `words` words of the whole text, A-Z lower-cased; with fewer words, the whole
    sequence is one. Rows without words (null and empty texts too) have an empty set and are linked with nothing. Equal
    sets are linked; different ones from num / den on, num < den. Repeated rows are linked with themselves; a null
    doc_id is never a component's smallest unless all are null. An empty table gives an empty result.
    """
    return _components(docs, Measure(words, num, den), True)


def _components(docs: DataFrame, measure: Measure, count: bool) -> DataFrame:
    """components(), with n_links only if they are to be counted."""
    sets, full, comps = node_components(docs, measure)
    links = F.lit(0).cast("long").alias("n_links")
    classes = sets.filter("n > 0").groupBy("node", "twin").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("m"))
    if comps is not None:
        named = classes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        lowest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
        joined = named.filter(F.col("node") != F.col("component")).select("component").distinct()
        # Only components of several nodes need their smallest document looked up.
        several = named.join(joined, "component").join(lowest, "component").select("node", "twin", "component_id")
        if count:
            weights = classes.groupBy("node").agg(F.sum("m").alias("weight"))
            several = several.join(link_counts(full, comps, weights, measure), "node")
            links = F.coalesce("n_links", F.lit(0)).alias("n_links")
        classes = classes.join(several, ["node", "twin"], "left").select("node", "twin", F.coalesce("component_id", "smallest").alias("smallest"), "m", links)
    else:
        classes = classes.withColumn("n_links", links)
    classes = common.keep(classes.select("node", "twin", "m", "smallest", "n_links"), "classes")
    out = common.with_classes(sets.filter("n > 0").select("doc_id", "n", "node", "twin"), classes, ["node", "twin"], sets.count())
    columns = ["doc_id", "n_shingles", "component_id"] + ["n_links"] * count
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"), "n_links")
    none = sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(none).select(*columns)


def one_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their component; of rows equal in doc_id and text, one."""
    stay = _components(docs, Measure(words, num, den), False).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("stays")).agg(F.count("*").alias("__times"))
    stay = common.keep(stay, "stay")
    rows = common.guarded(docs, "doc_id", "text")
    own = rows.columns
    kept = rows.join(common.small(stay), rows["doc_id"].cast("long").eqNullSafe(stay["stays"]))
    again = kept.filter("__times > 1").withColumn("__sha", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", "__sha"])
    return kept.filter("__times = 1").select(*own).unionByName(again.select(*own)).toDF(*docs.columns)
