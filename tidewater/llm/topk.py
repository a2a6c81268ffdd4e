"""Exact top-k by inner product: a ball tree on each shard, searched by branch and bound.

Rows are dealt over shards. A shard builds its ball tree once, in one task of bounded size, and stores it; a query visits
the tree's nodes in the order of their upper bound (q.c + |q| r) and stops when the bound falls below its k-th best score
so far.

The k-th score is shared twice: along the nodes of one shard, and among shards. A first pass takes, from each shard,
the scores of the few balls with the highest bounds; the k-th best of them all is a true lower bound for the answer,
and the second pass starts with it, so that most shards are left after a look at their roots.

Queries are worked off in blocks of at most `block` rows, each sent to all shards; vectors are never paired by a join. Each block
reads the stored trees where they lie, without a shuffle, one file for a shard; they are written uncompressed, so that the bound of
a reader's split bounds what a task holds. A block's answers are stored, so the plan doesn't grow with the number of blocks.
Identical vectors share a leaf, of which the k+1 smallest ids are enough, as ties go to the smaller id.

Defined results: vectors that are null, or hold null or non-finite parts, take no part; vectors of different lengths
are not compared; rows that repeat a vec_id are candidates each, and never answer the query of their own id. A null
vec_id takes no part. Fewer than k candidates: all of them. Components are longs (floor gives the ends of a long beyond them).
Scores are exact, also where doubles no longer are; those beyond a long are given, and compared, as its ends.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from math import floor as floor_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import slices, stored

_LEAF = 96
_LONG = 2**63


class BallTree:
    """Balls over rows of one length. Leaves list rows; nodes have centre, radius and smallest id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = _LEAF):
        self.ids, self.vectors = ids, vectors
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.least: list[int] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        if len(ids):
            pending = [(self._node(np.arange(len(ids))), np.arange(len(ids)))]
            while pending:
                at, rows = pending.pop()
                halves = self._split(rows, leaf, at)
                if halves is None:
                    self.rows[at] = rows
                    continue
                kids = tuple(self._node(h) for h in halves)
                self.children[at] = kids
                pending += zip(kids, halves, strict=True)
        self.centres_, self.radii_ = np.array(self.centres), np.array(self.radii)
        self.most = float(np.abs(vectors).max(initial=0.0))

    def __getstate__(self) -> dict:
        """Vectors are kept in single precision where that holds them exactly."""
        with np.errstate(over="ignore"):
            short = self.vectors.astype(np.float32)
        return self.__dict__ | ({"vectors": short} if (short == self.vectors).all() else {})

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.vectors = self.vectors.astype(np.float64)

    def _node(self, rows: np.ndarray) -> int:
        x = self.vectors[rows]
        c = x.mean(axis=0)
        self.centres.append(c)
        self.radii.append(float(np.sqrt(((x - c) ** 2).sum(axis=1).max(initial=0.0))))
        self.least.append(int(self.ids[rows].min()))
        self.children.append(None)
        self.rows.append(rows[:0])
        return len(self.centres) - 1

    def _split(self, rows: np.ndarray, leaf: int, at: int) -> tuple[np.ndarray, np.ndarray] | None:
        x = self.vectors[rows]
        if len(rows) <= leaf or (x == x[0]).all():
            return None
        a = x[((x - self.centres[at]) ** 2).sum(axis=1).argmax()]
        b = x[((x - a) ** 2).sum(axis=1).argmax()]
        side = x @ (b - a)
        half = side > np.median(side)
        if not half.any() or half.all():
            half = ((x - a) ** 2).sum(axis=1) > ((x - b) ** 2).sum(axis=1)
        if not half.any() or half.all():
            half = np.arange(len(rows)) < len(rows) // 2
        return rows[~half], rows[half]

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products; by Python's integers where a double might not hold a sum."""
        if self.most * float(np.abs(q).max(initial=0.0)) * len(q) < 2**53:
            return self.vectors[rows] @ q
        parts = [int(x) for x in q]
        return np.array([min(max(sum(int(a) * b for a, b in zip(v, parts, strict=True)), -_LONG), _LONG - 1) for v in self.vectors[rows]], dtype=object)

    def search(self, q: np.ndarray, own: int, k: int, floor: float, balls: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, that reach floor; only `balls` leaves if given."""
        if not len(self.ids):
            return []
        norm = float(np.sqrt((q**2).sum()))
        slack = 1e-9 * (1 + norm * self.most * len(q))
        bounds = self.centres_ @ q + norm * self.radii_ + slack
        queue = [(-bounds[0], 0)]
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        left = balls
        while queue:
            bound, at = heapq.heappop(queue)
            most = min(floor_(-bound), _LONG - 1)  # scores are integers
            if most < floor or len(best) == k and most < best[0][0]:
                break
            if len(best) == k and most == best[0][0] and self.least[at] > -best[0][1]:
                continue
            kids = self.children[at]
            if kids is not None:
                for kid in kids:
                    heapq.heappush(queue, (-bounds[kid], kid))
                continue
            rows = self.rows[at]
            scores = self._scores(rows, q)
            reach = max(floor, best[0][0]) if len(best) == k else floor
            hit = (scores >= reach).nonzero()[0]
            if len(hit) > 4 * k:  # of equal scores the smaller ids are enough
                hit = hit[self.ids[rows[hit]] != own]
                if scores.dtype == object:
                    hit = sorted(hit, key=lambda i: (-scores[i], self.ids[rows[i]]))[:k]
                else:
                    hit = hit[np.lexsort((self.ids[rows[hit]], -scores[hit]))[:k]]
            for i in hit:
                item = (int(scores[i]), -int(self.ids[rows[i]]))
                if -item[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if left is not None:
                left -= 1
                if not left:
                    break
        return [(s, -i) for s, i in best]


def _vectors(batches: Iterator[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(vec_id, parts) of a partition, by length."""
    ids, sizes, flat = [], [], []
    for b in batches:
        column = b.column(1)
        ids.append(b.column(0).to_numpy(zero_copy_only=False))
        sizes.append(column.value_lengths().to_numpy(zero_copy_only=False))
        flat.append(column.flatten().to_numpy(zero_copy_only=False))
    if not ids:
        return {}
    i, n, x = np.concatenate(ids), np.concatenate(sizes), np.concatenate(flat).astype(np.float64)
    begins = np.concatenate([[0], np.cumsum(n)[:-1]])
    return {int(d): (i[n == d], x[begins[n == d][:, None] + np.arange(d)] if d else np.zeros(((n == d).sum(), 0))) for d in np.unique(n)}


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, parts) of a shard to its trees, one for each length of vectors."""
    trees = [(d, pickle.dumps(BallTree(*x), protocol=5)) for d, x in _vectors(batches).items()]
    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in trees], pa.int64()), pa.array([t for _, t in trees], pa.binary())], names=["length", "tree"])


def _search(queries, k: int, balls: int | None):
    """(length, tree) to (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            length, tree = batch.column(0)[0].as_py(), pickle.loads(batch.column(1)[0].as_py())
            out = [(qid, i, s) for qid, d, q, floor in queries.value if d == length for s, i in tree.search(q, qid, k, floor, balls)]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def quantised(x: Column, scale: int) -> Column:
    return F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, shard_rows: int = 20_000, block: int = 10_000) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query holds for, the k best other rows by integer inner product."""
    spark = vectors.sparkSession
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select("vec_id", quantised(F.col("embedding"), scale).alias("x"))
    rows = stored(rows, "vectors")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    shards = max(1, -(-total["n"] // shard_rows), min(total["n"] // 1000, spark.sparkContext.defaultParallelism))
    # Round robin: a shard has no more rows than shard_rows.
    trees = stored(rows.repartition(int(shards)).mapInArrow(_grow, "length long, tree binary"), "trees", "none")
    asking = stored(rows.filter(is_query), "queries")
    blocks = max(1, -(-2 * total["q"] // block))  # half full on average, so that a block stays under its bound
    found: list[str] = []
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for b in range(blocks):
        mine = asking.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if not mine:
            continue
        asked = {(r["vec_id"], len(r["x"]), tuple(r["x"])) for r in mine}
        first = spark.sparkContext.broadcast([(i, d, np.array(x), -np.inf) for i, d, x in asked])
        probe = trees.mapInArrow(_search(first, k, 2), "query_id long, vec_id long, score long")
        kth = probe.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_id", "score").collect()
        floors = {r["query_id"]: r["score"] for r in kth}
        if len({i for i, _, _ in asked}) < len(asked):  # an id with several vectors: its probes are mixed
            floors = {}
        second = spark.sparkContext.broadcast([(i, d, np.array(x), floors.get(i, -np.inf)) for i, d, x in asked])
        hits = trees.mapInArrow(_search(second, k, None), "query_id long, vec_id long, score long")
        ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found.append(stored(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "answers")._scratch_path)
        first.unpersist()
        second.unpersist()
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
