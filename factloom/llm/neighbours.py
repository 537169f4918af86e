"""Approximate nearest neighbours: a vantage-point tree per shard, pruned by the triangle inequality.

Cosine order is the order of chord distance between unit vectors, which is a metric.
A tree node keeps a vantage point and the ranges of distances from it of its near
and far half; a half is skipped if, by the triangle inequality, it cannot hold
anything nearer than what a query has found.  ``relax`` scales that bound: 1 gives
exact search, more skips more.  In a leaf, every row within rounding of a query's k-th
best is scored in double precision, and the k best by score and vec_id stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard, and of a leaf of its tree.
SHARD_ROWS, LEAF_ROWS = 16_384, 128
#: Queries that go through a tree together.
QUERY_ROWS = 2048
#: Numbers of rows that are scored at once.
SCORE_CELLS = 1 << 22


class Tree:
    def __init__(self, unit: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 5, raw: np.ndarray | None = None) -> None:
        self.unit, self.leaf_rows = unit, leaf_rows
        self.raw = unit if raw is None else raw
        # rounding of a cosine at most, and of a distance and the bounds it is held against
        self.slack = (unit.shape[1] + 8) * 2.0**-51
        self.eps = 4 * np.sqrt(2 * self.slack)
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(unit)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf_rows:
            return at
        v = self.unit[at[self.rng.integers(len(at))]]
        d = _chord(self.unit[at] @ v)
        order = np.argsort(d, kind="stable")
        half = len(at) // 2
        near, far = order[:half], order[half:]
        return (v, d[near].min(), d[near].max(), d[far].min(), d[far].max(), self._build(at[near]), self._build(at[far]))

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, relax: float, raw: np.ndarray | None = None) -> np.ndarray:
        """Rows (-1: none) of the k nearest of each query, its own id left out, by score and then id."""
        self.q, self.own, self.ids, self.relax = queries, own, ids, relax
        self.raw_q = queries if raw is None else raw
        self.best = np.full((len(queries), k), -np.inf)
        self.row = np.full((len(queries), k), -1)
        self._visit(self.root, np.arange(len(queries)))
        return self.row

    def _scores(self, qs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        step = max(1, SCORE_CELLS // self.unit.shape[1])
        return np.concatenate([cosines(self.raw_q[qs[a : a + step]], self.raw[rows[a : a + step]]) for a in range(0, len(qs), step)])

    def _visit(self, node, qs: np.ndarray) -> None:
        if not len(qs):
            return
        if isinstance(node, np.ndarray):
            k = self.best.shape[1]
            c = self.q[qs] @ self.unit[node].T
            c[self.own[qs][:, None] == self.ids[node][None, :]] = -np.inf
            kth = np.partition(np.hstack([self.best[qs], c]), -k, axis=1)[:, -k]
            i, j = np.nonzero((c >= (kth - 2 * self.slack)[:, None]) & (c > -np.inf))
            if not len(i):
                return
            old_i, old_j = np.nonzero(self.row[qs] >= 0)
            at = np.concatenate([self.row[qs[old_i], old_j], node[j]])
            score = np.concatenate([self.best[qs[old_i], old_j], self._scores(qs[i], node[j])])
            i = np.concatenate([old_i, i])
            order = np.lexsort((self.ids[at], -score, i))
            i, at, score = i[order], at[order], score[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            keep = rank < k
            self.best[qs[i[keep]], rank[keep]] = score[keep]
            self.row[qs[i[keep]], rank[keep]] = at[keep]
            return
        v, near_lo, near_hi, far_lo, far_hi, near, far = node
        d = _chord(self.q[qs] @ v)
        gap_near = np.maximum(np.maximum(d - near_hi, near_lo - d), 0)
        gap_far = np.maximum(np.maximum(d - far_hi, far_lo - d), 0)
        near_first = gap_near <= gap_far
        for first, gap, side in ((near_first, gap_near, near), (~near_first, gap_far, far), (near_first, gap_far, far), (~near_first, gap_near, near)):
            worst = self.best[qs, -1]
            tau = np.where(worst > -np.inf, _chord(worst), np.inf)
            self._visit(side, qs[first & (gap * self.relax <= tau + self.eps)])


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of rows, in double precision, summed in the same way for every row."""
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _search(k: int, relax: float, leaf_rows: int):
    """Rows (shard, kind, vec_id, vector) sorted by shard and kind: vectors (0), then queries (1) -> the shard's k nearest of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, rows, index = None, [], [], None
        for batch in batches:
            key = batch["shard"].to_numpy()
            kind = batch["kind"].to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]), [True]))) if len(key) else np.zeros(1, int)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                if key[lo] != shard:
                    shard, ids, rows, index = key[lo], [], [], None
                x = _matrix(part["vector"], len(part["vector"][0]))
                if kind[lo] == 0:
                    ids.append(part["vec_id"].to_numpy())
                    rows.append(x)
                    continue
                if index is None and ids:
                    all_ids, all_rows = np.concatenate(ids), np.concatenate(rows)
                    index = Tree(_units(all_rows), leaf_rows, raw=all_rows)
                if index is None:
                    continue
                for a in range(0, len(x), QUERY_ROWS):
                    q, own = x[a : a + QUERY_ROWS], part["vec_id"].to_numpy()[a : a + QUERY_ROWS]
                    found = index.search(_units(q), own, all_ids, k, relax, raw=q)
                    i, j = np.nonzero(found >= 0)
                    yield pa.RecordBatch.from_pydict({"query_id": own[i], "vec_id": all_ids[found[i, j]], "score": index.best[i, j]})

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id long, vector array<double>) of rows that have an id and a finite vector other than zero; exact repeats once."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long"), v.alias("vector")).distinct()


def nearest(vectors: DataFrame, is_query, k: int = 5, relax: float = 1.0, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which is_query holds, its k nearest others by cosine.

    Ties go to the smaller vec_id; fewer than k others give fewer rows.  Rows whose
    vector is null, empty, zero, or holds null or non-finite components take no part;
    rows without vec_id neither; exact repeats of a row count once.  Rows that share the
    query's vec_id are its own.  Only vectors of the same length are compared.  An
    empty table gives no rows; further columns are ignored.

    Every vector is indexed; of equal vectors only the k + 1 with the least ids can be
    among anyone's k nearest, and only these go to the trees.
    """
    if relax < 1:
        raise ValueError("relax must be 1 (exact) or more")
    rows = valid_vectors(vectors)
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("_r") <= k + 1).drop("_r")
    sizes = {r[0]: max(1, -(-r[1] // shard_rows)) for r in rows.groupBy(F.size("vector").alias("d")).count().collect()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = F.element_at(F.create_map(*[F.lit(x) for p in sizes.items() for x in p]), F.size("vector"))

    def key(n):
        return F.xxhash64(F.size("vector"), n)

    index = first.select(key(F.pmod(F.xxhash64("vec_id"), shards).cast("int")).alias("shard"), F.lit(0).alias("kind"), "vec_id", "vector")
    queries = rows.where(is_query).select(F.explode(F.transform(F.sequence(F.lit(0), shards - 1), key)).alias("shard"), F.lit(1).alias("kind"), "vec_id", "vector")
    dealt = index.unionByName(queries).repartition("shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(_search(k, relax, leaf_rows), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
