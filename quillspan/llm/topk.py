"""Exact top-k inner products by columnar branch-and-bound.

Candidates are held dimension by dimension. For a query, scores accumulate one block of dimensions after
another; the mass left in the other blocks bounds what a candidate can still gain or lose (Cauchy-Schwarz), and
the survivors are compacted after each block against a floor: the k-th best score that the task has seen, raised by
what the k best of the block's candidates have for certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, partitions, read

BLOCK = 16  # dimensions added at once
CANDIDATES, QUERIES = 2048, 512  # met at once
EXACT = 2.0**50  # below this, sums of whole numbers are exact in doubles


def quantised(embedding: Column) -> Column:
    """floor(64 x) of every component, as doubles; null if a component (or the vector) is null or not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * 64).cast("double")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists as a matrix, shorter ones padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Best:
    """The ``k`` best candidates of each query so far, ties to the smaller id; what a task has seen bounds what it still looks at."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int):
        self.q, self.query_ids, self.k = queries, query_ids, k
        self.ids = [np.zeros(0, np.int64)] * len(queries)
        self.scores = [np.zeros(0, np.int64)] * len(queries)

    def keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[i], ids]), np.concatenate([self.scores[i], scores])
        order = np.lexsort([ids, -scores])[: self.k]
        self.ids[i], self.scores[i] = ids[order], scores[order]

    def look(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Take candidates in: a few at a time, dimension block by dimension block."""
        width = max(self.q.shape[1], vectors.shape[1])
        q = np.pad(self.q, ((0, 0), (0, width - self.q.shape[1])))
        vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
        norms = np.sqrt((vectors * vectors).sum(axis=1)).max(initial=0) * np.sqrt((q * q).sum(axis=1)).max(initial=0)
        if not norms < EXACT:  # such sums are not exact in doubles
            return self._look_whole_numbers(vectors, ids)
        cuts = list(range(0, width, BLOCK)) or [0]
        mass_q = [np.sqrt((q[:, c + BLOCK :] ** 2).sum(axis=1)) for c in cuts]
        for at in range(0, len(ids), CANDIDATES):
            own = ids[at : at + CANDIDATES]
            v = np.ascontiguousarray(vectors[at : at + CANDIDATES].T)  # dimension by dimension
            mass_v = [np.sqrt((v[c + BLOCK :] ** 2).sum(axis=0)) for c in cuts]
            for first in range(0, len(q), QUERIES):
                start = q[first : first + QUERIES, :BLOCK] @ v[:BLOCK]
                for i in range(first, min(first + QUERIES, len(q))):
                    self._bound(i, q[i], start[i - first], v, own, cuts, [m[i] for m in mass_q], mass_v)

    def _bound(self, i, q, score, v, ids, cuts, mass_q, mass_v) -> None:
        floor = float(self.scores[i][-1]) if len(self.scores[i]) == self.k else -np.inf
        alive = np.flatnonzero(ids != self.query_ids[i])
        score = score[alive]
        for n, c in enumerate(cuts):
            if n:
                score = score + q[c : c + BLOCK] @ v[c : c + BLOCK, alive]
            left = mass_q[n] * mass_v[n][alive] * (1 + 1e-9) + 1e-6
            if len(alive) > self.k:  # what the k best have for certain
                floor = max(floor, np.partition(score - left, -self.k)[-self.k])
            stay = score + left >= floor
            alive, score = alive[stay], score[stay]
            if not len(alive):
                return
        self.keep(i, ids[alive], np.rint(score).astype(np.int64))

    def _look_whole_numbers(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """The same for components too large for doubles; sums beyond a long are held at its ends."""
        cells = [[int(x) for x in r] for r in vectors]
        for i, row in enumerate(self.q):
            q = [int(x) for x in row]
            pairs = [(j, max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, c, strict=False))))) for c, j in zip(cells, ids.tolist(), strict=True) if j != self.query_ids[i]]
            self.keep(i, np.array([j for j, _ in pairs], np.int64), np.array([s for _, s in pairs], np.int64))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, block_rows: int = 16_384, block_bytes: int = 1 << 25) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best candidates but itself; all inputs have (vec_id, v).

    Queries and candidates are dealt at random to blocks of at most about ``block_rows`` rows and ``block_bytes`` bytes, and each block of queries meets each block of candidates in one task;
    of a meeting only each query's ``k`` best go on. Nothing passes the driver but counts. Shorter vectors are padded
    with zeros; rows whose vector is null are to be left out before. Rows with the query's own id are no candidates of it; other repeated ids each count, and equal scores go by id. Empty
    inputs give no rows.
    """
    queries, candidates = (cut(df.select("vec_id", "v", F.rand(9).alias("_u"))) for df in (queries, candidates))  # a written draw is the same wherever a plan puts it
    width = F.coalesce(F.max(F.size("v")), F.lit(0))
    (n_q, w_q), (n_c, w_c) = (df.agg(F.count("*"), width).first() for df in (queries, candidates))
    rows = max(1, min(block_rows, block_bytes // (8 * max(1, w_q, w_c))))
    q_blocks = max(1, -(-n_q // rows))
    c_blocks = max(-(-n_c // rows), min(partitions(queries.sparkSession), -(-n_c // CANDIDATES)), 1)  # as many tasks as there are partitions, if there are rows for them

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.floor(F.col("_u") * blocks).cast("int").alias(own)
        return df.select("vec_id", "v", block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        column = lambda t: _matrix(t.column("v"))
        query_ids = q.column("vec_id").to_numpy()
        best = Best(column(q), query_ids, k)
        if c.num_rows and q.num_rows:
            best.look(column(c), c.column("vec_id").to_numpy())
        n = [len(x) for x in best.ids]
        none = [np.zeros(0, np.int64)]
        cols = {"query_id": np.repeat(query_ids, n), "vec_id": np.concatenate([*none, *best.ids]), "score": np.concatenate([*none, *best.scores])}
        return pa.table({name: pa.array(x.astype(np.int64)) for name, x in cols.items()})

    left, right = dealt(queries, "_q", q_blocks, "_c", c_blocks), dealt(candidates, "_c", c_blocks, "_q", q_blocks)
    found = left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(meet, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every row whose id is divisible by 20, over all rows."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    rows = rows.where("v is not null and vec_id is not null")
    return top_k(rows.where("vec_id % 20 = 0"), rows)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
