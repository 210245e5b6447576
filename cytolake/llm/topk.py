"""Operator 5: exact top-k inner products by norm-bucketed retrieval.

Vectors are laid out by length (Euclidean norm), longest first, in chunks of like length, and chunks are cut into buckets of ``BUCKET`` rows. Queries come in
blocks; a block meets a chunk in one task of a grid, unless no query of the block can reach its threshold with the chunk's longest row. A query's threshold starts as its
k-th best score among a bounded sample of real candidates, so it is a true lower bound, and rises as its task goes on. In a bucket whose longest row has length l the local
cosine threshold is t = threshold / (|q| * l):

* t > 1: no row can reach the threshold and the bucket is skipped;
* t >= ``COSINE``: coordinate pruning. For a row of cosine >= t to the query each unit coordinate lies in
  q*t -/+ sqrt((1-t^2)(1-q^2)) (no bound on a side where |q| > t); rows outside on one of the query's ``FOCUS`` largest coordinates are dropped;
* otherwise length pruning: rows shorter than threshold / |q| are dropped.

What is left is verified by its product, in integers that a double holds exactly. Buckets and thresholds only save work: the result is exact.

Defined results: rows without an id and vectors that are null or hold null or non-finite components take no part; vectors of another length than the query's are no candidates for it.
Components whose integer passes 64 bits are held at its limits. Equal ids: the query is asked once (with the smallest of its vectors), rows of its own id are no
candidates, other repeated rows are candidates each. Empty tables give empty results. Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, prepare, shards

K, SCALE, EVERY = 5, 256, 50
BUCKET = 2048
#: Numbers that a block of queries and a chunk of rows hold at most, whatever their length: what a task has in memory.
QUERY_NUMBERS, CHUNK_NUMBERS = 2 << 20, 8 << 20
#: Sampled candidates for the first thresholds, and the numbers that they may hold in all.
SEEDS, SEED_NUMBERS = 4096, 4 << 20
COSINE, FOCUS = 0.9, 4
#: Scores up to here are exact in a double together with a row's place in its bucket.
EXACT = float(1 << 41)


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v, norm) of the vectors that take part, components as floor(scale * x)."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    usable = vectors.select(F.col(vec_id).alias("id"), x.alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    v = usable.select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    return v.select("id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)).alias("norm"))


@dataclass
class Block:
    """Queries of one vector length with their thresholds and best rows so far."""

    ids: np.ndarray
    q: np.ndarray  # float64 if exact, else Python integers
    norm: np.ndarray
    threshold: np.ndarray
    k: int = K

    def __post_init__(self) -> None:
        n = len(self.ids)
        self.best = np.full((n, self.k), -np.inf) if self.q.dtype != object else np.full((n, self.k), None, object)
        self.best_id = np.zeros((n, self.k), np.int64)
        self.filled = np.zeros(n, np.int64)

    def offer(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Pairs (query, row) with scores: keeps the k best of each query, ties to the smaller id."""
        for i in np.unique(at) if self.q.dtype == object else ():
            rows = [(-int(s), int(x)) for s, x in zip(score[at == i], ids[at == i], strict=True)]
            have = [(-int(self.best[i, k]), int(self.best_id[i, k])) for k in range(self.filled[i])]
            self._set(i, sorted(have + rows)[: self.k])
        if self.q.dtype == object or not len(at):
            return
        mine = np.unique(at)
        slot = np.arange(self.k)
        old = slot < self.filled[mine, None]
        at = np.concatenate([at, np.repeat(mine, self.filled[mine])])
        score = np.concatenate([score, self.best[mine][old]])
        ids = np.concatenate([ids, self.best_id[mine][old]])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rank = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
        keep = rank < self.k
        self.best[at[keep], rank[keep]] = score[keep]
        self.best_id[at[keep], rank[keep]] = ids[keep]
        self.filled[mine] = np.minimum(np.diff(np.r_[start, len(at)]), self.k)
        full = mine[self.filled[mine] == self.k]
        self.threshold[full] = np.maximum(self.threshold[full], self.best[full, self.k - 1])

    def _set(self, i: int, rows: list[tuple[int, int]]) -> None:
        for k, (s, x) in enumerate(rows):
            self.best[i, k], self.best_id[i, k] = -s, x
        self.filled[i] = len(rows)

    def bucket(self, ids: np.ndarray, v: np.ndarray, norm: np.ndarray) -> None:
        """One bucket of rows."""
        order = np.argsort(ids, kind="stable")
        ids, v, norm = ids[order], v[order], norm[order]
        if self.q.dtype == object or v.dtype == object or float(np.abs(self.q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, v.shape[1]) >= EXACT:
            return self._by_integers(ids, v)
        top = float(norm.max(initial=0.0))
        slack = 1e-9 * np.abs(self.threshold) + 1e-6  # lengths are rounded
        reach = self.norm * top + slack
        active = np.flatnonzero(~(reach < self.threshold))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (self.threshold[active] - slack[active]) / (self.norm[active] * top)
        sharp = t >= COSINE
        for i, c in zip(active[sharp], np.minimum(t[sharp], 1.0), strict=True):
            rows = self._near(i, c, v, norm)
            if len(rows):
                self._verify(np.array([i]), ids[rows], v[rows])
        rest = active[~sharp]
        if len(rest):
            least = np.where(self.norm[rest] > 0, (self.threshold[rest] - slack[rest]) / np.maximum(self.norm[rest], 1e-300), -np.inf).min()
            long = norm >= least
            self._verify(rest, ids[long], v[long])
        return None

    def _near(self, i: int, t: float, v: np.ndarray, norm: np.ndarray) -> np.ndarray:
        unit = self.q[i] / self.norm[i]
        rows = np.flatnonzero(norm > 0)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            x = v[rows, f] / norm[rows]
            half = np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2))) + 1e-9
            low = unit[f] * t - half if unit[f] > -t else -1.0
            high = unit[f] * t + half if unit[f] < t else 1.0
            rows = rows[(x >= low - 1e-9) & (x <= high + 1e-9)]
        return rows

    def _verify(self, queries: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """ids ascend, so a smaller place is a smaller id: score and place together give the order wanted."""
        if not len(ids):
            return
        for lo in range(0, len(queries), 512):
            some = queries[lo : lo + 512]
            s = self.q[some] @ v.T
            s[self.ids[some][:, None] == ids[None, :]] = -np.inf
            key = s * BUCKET + (BUCKET - 1 - np.arange(len(ids)))
            if len(ids) > self.k:
                at = np.argpartition(key, len(ids) - self.k, axis=1)[:, len(ids) - self.k :]
            else:
                at = np.broadcast_to(np.arange(len(ids)), key.shape)
            score = np.take_along_axis(s, at, 1)
            good = (score >= self.threshold[some][:, None]) & (score > -np.inf)
            self.offer(np.broadcast_to(some[:, None], at.shape)[good], score[good], ids[at[good]])

    def _by_integers(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Products too large for doubles, in Python's integers."""
        if self.q.dtype != object:
            self.q, self.best = self.q.astype(np.int64).astype(object), self.best.astype(object)
        s = self.q @ (v.astype(np.int64) if v.dtype != object else v).astype(object).T
        at, row = np.nonzero(self.ids[:, None] != ids[None, :])
        self.offer(at, s[at, row], ids[row])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, slot = np.nonzero(np.arange(self.k) < self.filled[:, None])
        limit = (1 << 63) - 1
        score = [max(-limit - 1, min(limit, int(x))) for x in self.best[at, slot]]
        return self.ids[at], self.best_id[at, slot], np.array(score, np.int64)


def matrices(ids, lists: pa.Array, norm) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, matrix, norms) for each vector length that occurs."""
    n = np.asarray(lists.value_lengths().fill_null(0))
    flat, start = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(n) - n
    for dim in np.unique(n):
        at = np.flatnonzero(n == dim)
        m = flat[(start[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim)
        wide = len(m) and dim and np.abs(m.astype(np.float64)).max() >= 2.0**53
        yield np.asarray(ids)[at], m.astype(object) if wide else m.astype(np.float64), np.asarray(norm)[at]


def blocks_of(t: pa.Table, k: int) -> list[Block]:
    t = t.combine_chunks()
    if not len(t):
        return []
    start = dict(zip(t["id"].to_pylist(), t["threshold"].to_pylist(), strict=True)) if "threshold" in t.column_names else {}
    return [Block(i, q, n, np.array([start.get(x, -np.inf) for x in i.tolist()]), k) for i, q, n in matrices(t["id"].to_numpy(), t["v"].combine_chunks(), t["norm"].to_numpy())]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, query_numbers: int = QUERY_NUMBERS, chunk_numbers: int = CHUNK_NUMBERS) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs as from :func:`integers`. One plan whatever the number of queries: a grid of chunks of rows and blocks of queries,
    from which the cells that no query of the block can profit by are left out."""
    spark = vectors.sparkSession
    prepare(spark)
    n = vectors.count()
    dim = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 1)
    dealt = vectors.repartitionByRange(shards(n, max(BUCKET, chunk_numbers // dim), spark.sparkContext.defaultParallelism), F.desc("norm"), "id")
    laid = materialize(dealt.select("id", "v", "norm", F.spark_partition_id().alias("chunk")), "topk-rows")
    asked = queries.groupBy("id").agg(F.min(F.struct("v", "norm")).alias("x")).select("id", "x.v", "x.norm")
    seed_rows = max(k + 1, min(SEEDS, SEED_NUMBERS // dim))
    share = min(1.0, seed_rows / max(n, 1))
    seeds = laid.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * seed_rows).select("id", "v", "norm").toArrow()
    asked = materialize(first_thresholds(asked, seeds, k), "topk-queries")
    n_blocks = shards(asked.count(), max(BUCKET, query_numbers // dim))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    longest = laid.groupBy("chunk", F.size("v").alias("dim")).agg(F.max("norm").alias("top"))  # a row or few a chunk
    reach = F.col("norm") * F.col("top") + 1e-9 * F.abs("threshold") + 1e-6 >= F.col("threshold")
    left = asked.join(F.broadcast(longest), (F.size("v") == F.col("dim")) & reach).select("block", "chunk", "id", "v", "norm", "threshold")
    cells = left.select(F.col("block").alias("b"), F.col("chunk").alias("c")).distinct()
    right = laid.join(cells, F.col("chunk") == F.col("c")).select("b", "c", "id", "v", "norm")

    def cell(own: pa.Table, rows: pa.Table) -> pa.Table:
        found = [pa.Table.from_batches([], pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))]
        blocks = {b.q.shape[1]: b for b in blocks_of(own, k)}
        rows = rows.combine_chunks()
        for ids, m, norm in matrices(rows["id"].to_numpy(), rows["v"].combine_chunks(), rows["norm"].to_numpy()) if len(rows) else ():
            if (b := blocks.get(m.shape[1])) is not None:
                order = np.argsort(-norm, kind="stable")  # longest first: thresholds rise soonest
                for lo in range(0, len(ids), BUCKET):
                    some = order[lo : lo + BUCKET]
                    b.bucket(ids[some], m[some], norm[some])
        for b in blocks.values():
            found.append(pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, b.rows()), strict=True)), schema=found[0].schema))
        return pa.concat_tables(found)

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("b", "c")).applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def first_thresholds(asked: DataFrame, seeds: pa.Table, k: int) -> DataFrame:
    """Queries (id, v, norm) with ``threshold``: the k-th best score among the sampled rows, which are bounded and so are sent to the tasks."""
    sent = asked.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = blocks_of(sent.value, k)
        for x in batches:
            told = {}
            for b in blocks_of(pa.Table.from_batches([x]), k):
                for s in some:
                    if s.q.shape[1] == b.q.shape[1] and s.q.dtype != object and b.q.dtype != object:
                        for lo in range(0, len(s.ids), BUCKET):
                            b.bucket(s.ids[lo : lo + BUCKET], s.q[lo : lo + BUCKET], s.norm[lo : lo + BUCKET])
                good = (b.filled == k) & (b.q.dtype != object)
                told |= dict(zip(b.ids.tolist(), np.where(good, b.threshold, -np.inf).tolist(), strict=True))
            yield x.append_column("threshold", pa.array([told[i] for i in x.column(0).to_pylist()], pa.float64()))

    return asked.select("id", "v", "norm").mapInArrow(run, f"id {asked.schema['id'].dataType.simpleString()}, v array<bigint>, norm double, threshold double")


def top_k(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    rows = materialize(integers(vectors, vec_id, embedding).where(F.col("id").isNotNull()), "topk-integers")
    return search(rows, rows.where(F.col("id") % every == 0), k)
