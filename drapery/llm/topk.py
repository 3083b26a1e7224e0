"""Exact top-k search by pivot-table elimination.

Vectors are turned to integers, and the score is the inner product. For
integer vectors ``q`` and ``x`` the score is (|q|^2 + |x|^2 - d(q,x)^2) / 2,
and for any pivot p the triangle inequality gives d(q,x) >= |d(q,p) - d(x,p)|.
The table of distances from every candidate to the pivots is computed once;
the largest lower bound over the pivots bounds the score from above.
Candidates are evaluated in the order of that bound until the k-th best score
is above all bounds left (candidates that only could tie are evaluated, as
ties go to smaller ids), so the result is exact.

Rows are dealt into blocks by a hash of the id: candidate blocks of about
``block_rows`` rows, each met by every block of the queries (a stated set);
a block's best k per query are merged by a second, small top-k. Blocks are the
unit of work and memory; nothing is collected.

Defined results: a vector that is null or holds a null or a non-finite
component takes no part, nor does a row with a null id; vectors are compared
with those of their own length only; rows with equal ids are one row's copies:
none is a candidate of its own id's queries, and equal (id, vector) rows count
once; empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUT = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id, v`` (array of long) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    limit = float("inf")
    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(limit)))
    return (vectors.filter(F.coalesce(usable, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))
            .distinct())


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), dim)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0))


def _dot(x: np.ndarray, q: np.ndarray, exact_float: bool) -> np.ndarray:
    return (x @ q.astype(np.float64)).astype(np.int64) if exact_float else x @ q


def search_block(query_ids, queries, cand_ids, cands, pivots, k: int, first: int = 64) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Top-k of every query among one block's candidates, by elimination."""
    out = []
    order = np.argsort(cand_ids, kind="stable")
    cand_ids, cands = cand_ids[order], cands[order]
    biggest = max(float(np.abs(cands).max(initial=0)), 1.0) * max(float(np.abs(queries).max(initial=0)), 1.0) * max(cands.shape[1], 1)
    exact_float = biggest < 2.0 ** 52
    x = cands.astype(np.float64) if exact_float else cands
    x_sq, q_sq = (cands.astype(np.float64) ** 2).sum(1), (queries.astype(np.float64) ** 2).sum(1)
    table_x, table_q = _distances(cands, pivots), _distances(queries, pivots)
    slack = 1.0 + 1e-9 * (x_sq.max(initial=0) + q_sq.max(initial=0))  # for rounding in the bounds
    for i in range(len(query_ids)):
        lower = np.zeros(len(cands))
        for p in range(table_x.shape[1]):
            np.maximum(lower, np.abs(table_x[:, p] - table_q[i, p]), out=lower)
        bound = (q_sq[i] + x_sq - lower * lower) / 2 + slack
        bound[cand_ids == query_ids[i]] = -np.inf
        live = int(np.isfinite(bound).sum())
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        left, size = np.arange(len(cands)), min(first, live)
        left = left[np.isfinite(bound)]
        while len(left):
            if size < len(left):  # the next candidates in bound order
                part = np.argpartition(-bound[left], size - 1)
                now, left = left[part[:size]], left[part[size:]]
            else:
                now, left = left, left[:0]
            ids = np.concatenate([ids, cand_ids[now]])
            scores = np.concatenate([scores, _dot(x[now], queries[i], exact_float)])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
            if len(scores) == k:
                left = left[bound[left] >= scores[-1]]
            size *= 8
        out.append((np.full(len(ids), query_ids[i]), ids, scores))
    return out


def _search(k: int) -> Callable:
    def run(key, queries: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        parts = []
        if len(queries) and len(cands):
            x = _matrix(cands["v"], dim)
            pivots = x[np.argsort(cands["is_pivot"].to_numpy() * -1, kind="stable")][: int(cands["is_pivot"].sum())]
            real = ~cands["is_pivot"].to_numpy()
            if real.any():
                parts = search_block(queries["id"].to_numpy(), _matrix(queries["v"], dim), cands["id"].to_numpy()[real], x[real], pivots, k)
        if not parts:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return pd.DataFrame({n: np.concatenate([p[j] for p in parts]) for j, n in enumerate(("query_id", "vec_id", "score"))})
    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, n_pivots: int = 16, block_rows: int = 8192,
          query_rows: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for every row with ``is_query`` (a condition on ``id``).

    The number of blocks follows a count of the rows. Pivots are the ``n_pivots`` rows of smallest hashed id of each
    length; they ride along with every block.
    """
    v = integer_vectors(vectors, id_col, vec_col, scale).withColumn("dim", F.size("v"))
    is_q = is_query(F.col("id"))
    n, n_queries = v.agg(F.count("*"), F.count_if(is_q)).first()
    c_blocks, q_blocks = max(1, -(-n // block_rows)), max(1, -(-n_queries // query_rows))
    block = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(m)).cast("int")

    def every(m):
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    pivot_rank = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64(F.lit("pivot"), "id"), "id", "v"))
    pivots = v.withColumn("n", pivot_rank).filter(F.col("n") <= n_pivots).drop("n")
    cands = v.select("dim", block("cand", c_blocks).alias("c"), "id", "v", F.lit(False).alias("is_pivot"))
    cands = cands.unionByName(pivots.select("dim", every(c_blocks).alias("c"), "id", "v", F.lit(True).alias("is_pivot")))
    cands = cands.select("dim", "c", every(q_blocks).alias("q"), "id", "v", "is_pivot")
    queries = v.filter(is_q).select("dim", every(c_blocks).alias("c"), block("query", q_blocks).alias("q"), "id", "v")
    found = queries.groupBy("dim", "c", "q").cogroup(cands.groupBy("dim", "c", "q")).applyInPandas(_search(k), OUT)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
bad AS (SELECT DISTINCT vec_id FROM u WHERE x IS NULL OR isnan(x) OR isinf(x)),
e AS (SELECT vec_id, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x, i FROM u WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
    FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
