"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are dealt into blocks. A block's index has, for each dimension, postings grouped into segments of equal quantised value. A query takes
segments of all dimensions by descending quantised impact (what the segment adds to a score above the least that its dimension can add), and stops only
when the impacts left cannot lift any vector but a few above the k-th score so far; these few are scored exactly. Queries come in blocks too, and
each pair of blocks is a task's group, so that neither side need fit anywhere whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

K, SCALE, LEVEL_BITS = 10, 1024, 5
#: Vectors and queries in a block.
VECTORS, QUERIES = 8192, 512
#: A query is finished by exact scores when so many vectors, times k, can still be members.
FEW = 8


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(key, v): floor(scale * x) of each component, as whole numbers; vectors that are null or hold null or non-finite components
    are left out."""
    x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    sound = F.col(f"`{vector}`").isNotNull() & F.forall(F.col("x"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.withColumn("x", x).filter(sound & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("key"), F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


class Index:
    """Segments of one block's vectors [rows, dims], whole numbers."""

    def __init__(self, m: np.ndarray):
        self.m = m
        top = int(np.abs(m).max(initial=0))
        self.bits = max(LEVEL_BITS, top.bit_length() - 5)  # about 64 levels at most
        level = m >> self.bits
        self.segments = []  # (dimension, level, rows)
        for d in range(m.shape[1]):
            order = np.argsort(level[:, d], kind="stable")
            cut = np.flatnonzero(np.diff(level[order, d])) + 1
            for part in np.split(order, cut):
                if len(part):
                    self.segments.append((d, int(level[part[0], d]), part))
        self.dim = np.array([s[0] for s in self.segments], np.int64)
        self.lev = np.array([s[1] for s in self.segments], np.int64)
        self.exact = float(top) * top * max(1, m.shape[1]) < 2**52
        self.real = m.astype(np.float64)

    def score(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact and float(np.abs(q).max(initial=0)) * float(np.abs(self.m).max(initial=0)) * len(q) < 2**52:
            return (self.real[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.m[rows] @ q

    def candidates(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows among which the k best scores, and all ties with the k-th, certainly are."""
        n = len(self.m)
        if n <= FEW * k:
            return np.arange(n)
        # a segment's values are lev << bits up to width - 1 more: the least and most that it can add
        width = (1 << self.bits) - 1
        a = q[self.dim] * (self.lev << self.bits)
        slack = q[self.dim] * width
        lo, hi = a + np.minimum(slack, 0), a + np.maximum(slack, 0)
        dims = self.m.shape[1]
        floor = np.full(dims, np.iinfo(np.int64).max)
        np.minimum.at(floor, self.dim, lo)
        add, most = lo - floor[self.dim], hi - floor[self.dim]
        order = np.argsort(-most, kind="stable")
        # what each dimension may still add, after each step: the impact of its next segment
        left = np.zeros(dims, np.int64)
        np.maximum.at(left, self.dim, most)
        per_dim: list[list[int]] = [[] for _ in range(dims)]
        for s in order:
            per_dim[self.dim[s]].append(int(most[s]))
        spread = int(np.abs(q).sum()) * width  # a row's posting may add so much more than its segment's least
        at = [0] * dims
        rest, total = int(left.sum()), np.zeros(n, np.int64)
        check, step = 0, max(1, len(order) // 24)
        for done, s in enumerate(order):
            d = self.dim[s]
            total[self.segments[s][2]] += add[s]
            at[d] += 1
            nxt = per_dim[d][at[d]] if at[d] < len(per_dim[d]) else 0
            rest -= per_dim[d][at[d] - 1] - nxt
            check += 1
            if check >= step or done == len(order) - 1:
                check = 0
                kth = np.partition(total, n - k)[n - k]
                can = np.flatnonzero(total + rest + spread >= kth)
                if len(can) <= FEW * k:
                    return can
        return can


def _block(ids: np.ndarray, m: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row's id, score): the k best of a block for each query, but itself, ties to smaller ids."""
    # of equal vectors only the k + 1 smallest ids can be members
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    same, of = np.unique(m, axis=0, return_inverse=True)
    of = of.ravel()
    members = np.argsort(of, kind="stable")
    start = np.searchsorted(of[members], np.arange(len(same)))
    end = np.append(start[1:], len(ids))
    index, out = Index(same), []
    for i, v in zip(qids, q, strict=True):
        rows = index.candidates(v, min(k + 1, len(same)))
        if not len(rows):
            continue
        score = np.full(len(same), np.iinfo(np.int64).min)
        score[rows] = index.score(rows, v)
        if len(rows) > k + 1:
            kth = np.partition(score[rows], len(rows) - k - 1)[len(rows) - k - 1]
            rows = rows[score[rows] >= kth]
        take = np.concatenate([members[start[r] : min(start[r] + k + 1, end[r])] for r in rows])
        take = take[ids[take] != i]
        best = take[np.lexsort((ids[take], -score[of[take]]))][:k]
        out += [(int(i), int(ids[t]), int(score[of[t]])) for t in best]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all vectors but those of its own key, ties to the smaller key; all, if
    fewer. Both sides are (key, v) as by quantised(). Vectors of different lengths meet as if the shorter ended in zeros. Rows of one key count
    once: their least vector is meant. Empty sides give an empty result."""
    one = lambda df: df.groupBy("key").agg(F.min("v").alias("v"))
    rows, asked = settle(one(vectors), "topk-vectors"), settle(one(queries), "topk-queries")
    n, m = rows.count(), asked.count()
    nv, nq = -(-n // VECTORS) or 1, -(-m // QUERIES) or 1
    left = rows.withColumn("vb", F.pmod(F.xxhash64("key"), F.lit(nv)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("key"), F.lit(nq)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(max(map(len, a["v"])), max(map(len, b["v"])), 1)

        def matrix(vs: pd.Series) -> np.ndarray:
            out = np.zeros((len(vs), width), np.int64)
            for i, v in enumerate(vs):
                out[i, : len(v)] = v
            return out

        got = _block(a["key"].to_numpy(), matrix(a["v"]), b["key"].to_numpy(), matrix(b["v"]), k)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"], dtype="int64")

    best = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(pair, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})::BIGINT) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e::DOUBLE[], v.e::DOUBLE[])::BIGINT AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
