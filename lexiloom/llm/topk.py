"""Exact top-k search by columnar branch-and-bound.

Candidates lie in blocks stored dimension by dimension. For each query, scores are accumulated a block
of dimensions at a time; what the remaining dimensions can still add is bounded by the remaining masses of
query and candidate (Cauchy-Schwarz). Candidates whose bound falls below the k-th best guaranteed score
are compacted away before the next dimensions are read. Results are exact, ties included.

Blocks hold about ``BLOCK`` candidates by hash; queries are copied to every block as rows, and each block
returns its k best per query, so neither side passes through the driver or one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 4096
STEP = 16
EXACT = float(1 << 53)


def grid(v: Column) -> Column:
    """floor(256 * x) of each component as double; null if the vector or a component is null or not finite."""
    d = F.transform(v, lambda x: x.cast("double"))
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(d, lambda x: F.floor(x * 256).cast("double")))


class Block:
    """Candidates in vertical layout: one row per dimension, and the mass left after each step."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        if len(np.unique(ids)) < len(ids):  # repeated rows count once
            first = sorted({(i, v.tobytes()): n for n, (i, v) in enumerate(zip(ids.tolist(), vectors))}.values())
            ids, vectors = ids[first], vectors[first]
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], vectors[order]
        self.order = np.argsort(-np.abs(rows).sum(axis=0), kind="stable")
        self.columns = np.ascontiguousarray(rows.T[self.order])
        self.left = np.sqrt(np.cumsum((self.columns**2)[::-1], axis=0)[::-1][::STEP]) if len(self.order) else np.zeros((0, len(ids)))
        self.largest = np.abs(rows).max(initial=0.0)

    def best(self, own_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best candidates other than the query's own, ties to smaller ids."""
        dims = len(q)
        if self.largest * np.abs(q).max(initial=0.0) * dims >= EXACT:
            return self._plain(own_id, q, k)
        q = q[self.order]
        q_left = np.sqrt(np.cumsum((q**2)[::-1])[::-1][::STEP]) if dims else np.zeros(0)
        alive = np.flatnonzero(self.ids != own_id)
        score = np.zeros(len(alive))
        for step, at in enumerate(range(0, dims, STEP)):
            part = self.columns[at : at + STEP]
            score += q[at : at + STEP] @ (part if len(alive) == len(self.ids) else part[:, alive])
            if step + 1 < len(self.left) and len(alive) > k:
                reach = self.left[step + 1][alive] * q_left[step + 1] * (1 + 1e-9) + 1e-6
                floor = np.partition(score - reach, len(alive) - k)[len(alive) - k]
                keep = score + reach >= floor
                if keep.sum() < 0.7 * len(alive):
                    alive, score = alive[keep], score[keep]
        if len(alive) > k:
            keep = score >= np.partition(score, len(alive) - k)[len(alive) - k]
            alive, score = alive[keep], score[keep]
        top = np.lexsort((self.ids[alive], -score))[:k]
        return [(int(self.ids[alive[t]]), int(score[t])) for t in top]

    def _plain(self, own_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Whole numbers of any size, for components too large for doubles to add exactly."""
        q = [int(x) for x in q[self.order]]
        rows = [(-sum(int(a) * b for a, b in zip(col, q)), int(i)) for i, col in zip(self.ids, self.columns.T) if i != own_id]
        return [(i, -s) for s, i in sorted(rows)[:k] if -(1 << 63) <= -s < 1 << 63]


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows are sorted by block, candidates first: gathers a block, then answers its queries."""
        key, ids, vectors, block = None, [], [], None
        for pdf in batches:
            out = []
            for dims, cell, kind, i, v in zip(pdf["dims"].tolist(), pdf["cell"].tolist(), pdf["kind"].tolist(), pdf["vec_id"].tolist(), pdf["v"]):
                if (dims, cell) != key:
                    key, ids, vectors, block = (dims, cell), [], [], None
                if kind == 0:
                    ids.append(i)
                    vectors.append(v)
                elif ids:
                    if block is None:
                        block = Block(np.array(ids), np.array(vectors, dtype=np.float64).reshape(len(ids), dims))
                    out += [(i, c, s) for c, s in block.best(i, np.asarray(v, dtype=np.float64), k)]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) by integer inner product over floor(256 * x).

    ``vectors`` has (vec_id, embedding); ``is_query`` picks the queries, all rows are candidates but those
    with the query's own id. Null ids, null vectors and vectors with null or non-finite components take
    no part; vectors of different lengths are not compared. Repeated rows count once.
    """
    rows = vectors.select("vec_id", grid(F.col("embedding")).alias("v"), is_query.alias("is_query")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.withColumn("dims", F.size("v"))
    cells = max(1, -(-rows.count() // block))
    cell = F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int")
    candidates = rows.select("dims", cell.alias("cell"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = rows.where("is_query").select(
        "dims", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("kind"), "vec_id", "v"
    )
    dealt = candidates.unionByName(asked).repartition("dims", "cell").sortWithinPartitions("dims", "cell", "kind", "vec_id")
    found = dealt.mapInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint").distinct()
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
