"""Exact top-k inner-product search with ball trees.

Rows are dealt to shards of about `shard_rows` vectors. A shard's ball tree is
built once and written as one row; queries are sent to the trees and answered by
best-first branch and bound: nodes are taken in the order of their inner-product
upper bound q.c + |q| r, and a search ends when the best open bound is below the
current k-th score. Shards share that score: a query first visits one shard (a
different one for each query), then a few more with the score found there, then
all others with the best score so far.

A task holds one tree at a time and reads its queries as a stream, `query_rows`
of them; more queries meet copies of the tree in other tasks.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, settle

#: Shards that a query visits in its first rounds; the last round is the rest.
ROUNDS = (1, 4)
_LONG = 2**63 - 1
#: The k-th score of a query that has none yet.
NO_FLOOR = -_LONG


class BallTree:
    """Nodes in arrays; the points of node i are order[low[i]:high[i]]."""

    def __init__(self, points: np.ndarray, leaf: int = 128):
        self.points, self.order = points, np.arange(len(points))
        self.low, self.high, self.left, self.right, centres, radii = [], [], [], [], [], []
        todo = [(0, len(points), -1, False)]
        while todo:
            low, high, parent, is_right = todo.pop()
            at, mine = len(self.low), points[self.order[low:high]]
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = at
            centre = mine.mean(axis=0)
            away = np.sqrt(((mine - centre) ** 2).sum(axis=1))
            self.low.append(low)
            self.high.append(high)
            self.left.append(-1)
            self.right.append(-1)
            centres.append(centre)
            radii.append(away.max())
            if high - low <= leaf or not away.max():
                continue
            first = mine[away.argmax()]
            second = mine[((mine - first) ** 2).sum(axis=1).argmax()]
            middle = (high - low) // 2
            split = np.argpartition(mine @ (second - first), middle)
            self.order[low:high] = self.order[low:high][split]
            todo += [(low, low + middle, at, False), (low + middle, high, at, True)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product, queries x nodes, rounded up."""
        size = np.sqrt((queries**2).sum(axis=1))[:, None]
        exact = queries @ self.centres.T + size * self.radii
        room = size * (np.sqrt((self.centres**2).sum(axis=1)) + self.radii)
        return exact + 1e-9 * room + 0.5


def _matrix(column: pd.Series) -> np.ndarray:
    out = np.array(column.tolist(), dtype=np.int64)
    return out.reshape(len(column), -1)


def _scores(points: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products: by floats while every sum is exact in them."""
    if exact:
        return (points @ query).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(p, query)) for p in points], dtype=object)


def _built(shard: pd.DataFrame) -> pd.DataFrame:
    ints = _matrix(shard["vector"])
    tree = BallTree(ints.astype(float))
    raw = pickle.dumps((shard["vec_id"].to_numpy(), ints, tree), protocol=5)
    return pd.DataFrame({"size": shard["size"].iloc[:1].to_numpy(), "shard": shard["shard"].iloc[:1].to_numpy(), "tree": [raw]})


def _answers(ids: np.ndarray, ints: np.ndarray, tree: BallTree, block: pd.DataFrame, k: int) -> pd.DataFrame:
    queries = _matrix(block["vector"])
    points, floats = tree.points, queries.astype(float)
    exact = float(np.abs(points).max(initial=0)) * float(np.abs(floats).max(initial=0)) * max(1, points.shape[1]) < 2**53
    bounds = tree.bounds(floats)
    out_q, out_n, out_v, out_s = [], [], [], []
    for n, (own, number, floor) in enumerate(zip(block["vec_id"], block["query"], block["floor"])):
        kth = shared = None if abs(int(floor)) >= _LONG else int(floor)
        best_s, best_v = np.empty(0, np.int64), np.empty(0, np.int64)
        heap = [(-bounds[n, 0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if kth is not None and -bound < kth:
                break
            if tree.left[node] >= 0:
                for child in (tree.left[node], tree.right[node]):
                    heapq.heappush(heap, (-bounds[n, child], child))
                continue
            at = tree.order[tree.low[node] : tree.high[node]]
            at = at[ids[at] != own]
            scores = _scores(points[at] if exact else ints[at], floats[n] if exact else queries[n], exact)
            if shared is not None:
                at, scores = at[scores >= shared], scores[scores >= shared]
            best_s, best_v = np.concatenate([best_s, scores]), np.concatenate([best_v, ids[at]])
            top = np.lexsort((best_v, -best_s))[:k]
            best_s, best_v = best_s[top], best_v[top]
            if len(best_s) == k:
                kth = int(best_s[-1]) if kth is None else max(kth, int(best_s[-1]))
        out_q += [own] * len(best_s)
        out_n += [number] * len(best_s)
        out_v += best_v.tolist()
        out_s += [max(-_LONG, min(_LONG, int(x))) for x in best_s]
    return pd.DataFrame({"query_id": out_q, "query": out_n, "vec_id": out_v, "score": out_s}).astype("int64")


def _search(k: int):
    """Reads rows sorted so that a tree comes before its queries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for frame in frames:
            keys = list(zip(frame["size"], frame["shard"], frame["part"]))
            low = 0
            while low < len(keys):
                high = low + 1
                while high < len(keys) and keys[high] == keys[low]:
                    high += 1
                some = frame.iloc[low:high]
                for raw in some["tree"].dropna():
                    key, held = keys[low], pickle.loads(raw)
                asked = some[some["tree"].isna()]
                if len(asked) and key == keys[low]:
                    yield _answers(*held, asked, k)
                low = high

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of every component x, as longs.

    Rows with a null id, a null vector or a null or non-finite component go.
    """
    x = F.col(vector_col)
    odd = F.exists(x, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~odd)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 8192, query_rows: int = 65536) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products.

    Both inputs have (vec_id, vector of longs). Every row is a candidate except
    rows with the query's own id; ties go to the smaller vec_id; fewer than k
    candidates are all returned; vectors meet vectors of their own length only.
    Repeated rows are candidates of their own, but one query; rows of one id and
    different vectors are queries of their own, ranked apart. Scores beyond a
    long are cut to the largest. Empty tables give no rows.
    """
    if k < 1:
        raise ValueError("k must be positive")
    bounded_batches(vectors.sparkSession)  # a tree is a batch of its own
    shards = max(1, ceil(vectors.count() / shard_rows))
    deal = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    rows = vectors.select("vec_id", "vector", F.size("vector").alias("size"), deal(shards).alias("shard"))
    trees = settle(rows.groupBy("size", "shard").applyInPandas(_built, "size int, shard int, tree binary"))
    asked = queries.select("vec_id", "vector").distinct()
    asked = settle(asked.select("vec_id", "vector", F.size("vector").alias("size"), F.xxhash64("vec_id", "vector").alias("query")))
    parts = max(1, ceil(asked.count() / query_rows))
    home, part = F.pmod("query", F.lit(shards)), F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")

    def visit(asked: DataFrame, low: int, high: int) -> DataFrame:
        """The answers of the shards `low` to `high` - 1 after a query's own."""
        shard = F.explode(F.transform(F.sequence(F.lit(low), F.lit(high - 1)), lambda n: F.pmod(home + n, F.lit(shards)).cast("int")))
        spread = asked.select("size", shard.alias("shard"), part.alias("part"), "vec_id", "query", "vector", "floor", F.lit(None).cast("binary").alias("tree"))
        copies = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
            "size", "shard", "part", F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("query"),
            F.lit(None).cast("array<bigint>").alias("vector"), F.lit(NO_FLOOR).alias("floor"), "tree",
        )  # fmt: skip  (no null in a column of longs: pandas would make them floats, which round)
        keys = ("size", "shard", "part")
        met = copies.unionByName(spread).repartition(*keys).sortWithinPartitions(*keys, F.col("tree").isNull())
        found = met.mapInPandas(_search(k), "query_id long, query long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")

    asked, low, best = asked.withColumn("floor", F.lit(NO_FLOOR)), 0, None
    for high in sorted({min(n, shards) for n in (*ROUNDS, shards)}):
        found = visit(asked, low, high)
        best = found if best is None else best.unionByName(found)
        if high < shards:
            best = settle(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"))
            kth = best.groupBy("query_id", "query").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") == k)
            asked = asked.drop("floor").join(kth.select(F.col("query_id").alias("vec_id"), "query", "kth"), ["vec_id", "query"], "left")
            asked = asked.select("vec_id", "vector", "size", "query", F.coalesce("kth", F.lit(NO_FLOOR)).alias("floor"))
        low = high
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
