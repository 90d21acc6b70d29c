"""Exact top-k inner-product search by columnar branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wavemill.llm import common

#: Rows of a tile of candidates and of queries; dimensions of a vertical block.
CANDIDATES, QUERIES, BLOCK = 16384, 2048, 8

#: Sums of products up to here are exact in doubles.
_EXACT = float(1 << 53)

_OUT = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vectors(vec_id, embedding) as (vec_id long, v array<long>) with v = floor(scale * x), x as double.

    Rows that are null, hold a null or non-finite component, or have a null vec_id, take no part.
    """
    rows = common.only(vectors, vec_id="long", embedding="array<double>").withColumnRenamed("embedding", "x").filter("vec_id is not null and x is not null")
    rows = rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * float(scale)).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vertical layout: a row for each dimension; shorter vectors are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((width, len(lists)), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), lengths)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), rows] = flat
    return out


def search(query: np.ndarray, query_id: int, columns: np.ndarray, tails: np.ndarray, ids: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The tile's k best (ids, scores) for one query, best first.

    Scores accumulate dimension block by dimension block over the candidates that survive. After a block, a candidate's
    score can still move by at most the product of the norms of what is left of both vectors (tails has the
    candidates'); those whose most is below the k-th largest least, or below floor, a score that k candidates reach
    somewhere, are dropped and the rest compacted. Before the first block, that is a bound by whole norms.
    """
    width = len(columns)
    left = np.sqrt(np.concatenate([np.cumsum((query * query)[::-1])[::-1], [0.0]]))
    alive = np.flatnonzero((ids != query_id) & (left[0] * tails[0] * (1 + 1e-9) + 1e-6 >= floor))
    partial = np.zeros(len(alive))
    for n, at in enumerate(range(0, width, BLOCK)):
        to = min(width, at + BLOCK)
        part = columns[at:to] if len(alive) == columns.shape[1] else columns[at:to, alive]
        partial = partial + query[at:to] @ part
        if len(alive) > k and to < width:
            slack = left[to] * tails[n + 1][alive] * (1 + 1e-9) + 1e-6
            least = partial - slack
            bar = max(floor, np.partition(least, len(least) - k)[len(least) - k])
            stay = partial + slack >= bar
            alive, partial = alive[stay], partial[stay]
    stay = partial >= floor
    alive, partial = alive[stay], partial[stay]
    order = np.lexsort((ids[alive], -partial))[:k]
    return ids[alive[order]], partial[order]


def _tile(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    q_ids, ids = queries.column("vec_id").to_numpy(), candidates.column("vec_id").to_numpy()
    width = max((int(c.combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for c in (queries.column("v"), candidates.column("v")) if len(c)), default=0)
    floors = queries.column("floor").to_numpy(zero_copy_only=False).astype(float)
    floors = np.where(np.isnan(floors), -np.inf, floors)
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    if len(q_ids) and len(ids):
        q, c = _matrix(queries.column("v"), width), _matrix(candidates.column("v"), width)
        if float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(1, width) < _EXACT:
            columns = c.astype(np.float64)
            squares = np.add.reduceat(columns * columns, np.arange(0, width, BLOCK), axis=0) if width else np.zeros((0, len(ids)))
            tails = np.sqrt(np.concatenate([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, len(ids)))]))
            for j, query_id in enumerate(q_ids.tolist()):
                best, scores = search(q[:, j].astype(np.float64), query_id, columns, tails, ids, k, floors[j])
                found.append((query_id, best, scores.astype(np.int64)))
        else:  # too large for doubles: whole numbers of any size, and scores that a long can't hold at its ends
            whole = c.astype(object)
            for j, query_id in enumerate(q_ids.tolist()):
                scores = [max(-(2**63), min(2**63 - 1, int(s))) for s in q[:, j].astype(object) @ whole]
                order = sorted((i for i in range(len(ids)) if ids[i] != query_id), key=lambda i: (-scores[i], ids[i]))[:k]
                found.append((query_id, ids[order], np.array([scores[i] for i in order], np.int64)))
    return pa.table({
        "query_id": pa.array([i for i, best, _ in found for _ in best], pa.int64()),
        "vec_id": pa.array(np.concatenate([b for _, b, _ in found]) if found else [], pa.int64()),
        "score": pa.array(np.concatenate([s for _, _, s in found]) if found else [], pa.int64()),
    })


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """The k candidates of highest inner product for each query: query_id, rank (from 1), vec_id, score.

    Both sides hold (vec_id long, v array<long>), as quantised() gives. Candidates of the query's own vec_id are left
    out; ties go to the smaller vec_id; a query with fewer candidates gets them all. Shorter vectors count as filled up
    with zeros. Repeated rows are rows of their own as candidates; a vec_id counts once as a query, with its smallest
    vector. Other columns are ignored. Queries and candidates are dealt into tiles of bounded size and every pair of tiles
    is one task's work, so no side has to fit in one place; all start from the floor that the largest vectors set.
    """
    spark = queries.sparkSession
    queries = common.only(queries, vec_id="long", v="array<long>").groupBy("vec_id").agg(F.min("v").alias("v"))
    candidates = common.only(candidates, vec_id="long", v="array<long>")
    n_queries, n_candidates = queries.count(), candidates.count()
    q_tiles, c_tiles = max(1, -(-n_queries // QUERIES)), max(1, -(-n_candidates // CANDIDATES))
    tile = lambda tiles, *by: F.pmod(F.xxhash64(*by), F.lit(tiles)).cast("int")
    common.ship(spark)
    schema = "query_id long, vec_id long, score long"
    if c_tiles > 1:
        # The largest vectors come first: each query's k-th best score among them is a floor that all tiles start from.
        norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
        head = common.keep(candidates.orderBy(norm.desc(), "vec_id").limit(CANDIDATES).select("vec_id", "v"), "head")
        asked = queries.withColumn("floor", F.lit(None).cast("double")).withColumn("q_tile", tile(q_tiles, "vec_id"))
        met = head.crossJoin(F.broadcast(spark.range(q_tiles).select(F.col("id").cast("int").alias("q_tile"))))
        first = asked.groupBy("q_tile").cogroup(met.groupBy("q_tile")).applyInArrow(lambda a, b: _tile(a, b, k), schema)
        floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).filter(F.col("n") == k)
        queries = common.keep(queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "floor"), "floors")
    else:
        queries = queries.withColumn("floor", F.lit(None).cast("double"))
    # Repeated rows of one vector are dealt out too: a tile's number comes from a row's place, not from what it holds.
    left = queries.withColumn("q_tile", tile(q_tiles, "vec_id")).withColumn("c_tile", F.explode(F.sequence(F.lit(0), F.lit(c_tiles - 1))))
    right = candidates.withColumn("c_tile", F.pmod(F.monotonically_increasing_id() + F.shiftrightunsigned(F.monotonically_increasing_id(), 33), F.lit(c_tiles)).cast("int"))
    right = common.keep(right, "candidates").withColumn("q_tile", F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1))))
    pairs = left.groupBy("q_tile", "c_tile").cogroup(right.groupBy("q_tile", "c_tile"))
    found = pairs.applyInArrow(lambda a, b: _tile(a, b, k), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
