"""Nearest neighbours by inner product: an int8 block matrix join with quantisation error bounds.

Queries and candidates are cut into blocks and every pair of blocks is one tile. In a tile an int8 product gives each inner
product with a bound on its error; pairs whose upper bound reaches the k-th best lower bound are computed again in double
precision, and heaps merge the tiles' lists. The bounds make the result exact.

Vectors that are null, zero or hold null or non-finite components take no part; vectors of different length are not compared.
Ties go to the smaller id. A repeated id keeps each of its rows as a candidate and asks
once, with its smallest vector. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import table

QUERY_BLOCK = 1024
BASE_BLOCK = 8192
FOUND = "query_id long, vec_id long, score double"


def _usable(rows: DataFrame, id_col: str, vec: str) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0)).where(fine & F.exists("_v", lambda x: x != 0))


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, norms of the quantised rows, norms of what is lost."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # a row of subnormal numbers is lost as a whole, within the bound
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and c, added from the first component to the last."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * c[:, d]
    return total


def tile_top(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best candidates of this tile: query ids, candidate ids, scores."""
    qi, qs, qn, qe = _quantised(q)
    ci, cs, cn, ce = _quantised(c)
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # products of int8 rows stay exact
    cf = np.ascontiguousarray(ci.T.astype(kind))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 256):
        to = slice(at, at + 256)
        near = (qi[to].astype(kind) @ cf).astype(np.float64) * qs[to, None] * cs
        # |q.c - q'.c'| <= |q'||c-c'| + |q-q'||c'| + |q-q'||c-c'|, and a little for rounding
        slack = (qn[to, None] * ce + qe[to, None] * cn + qe[to, None] * ce) * (1 + 1e-9) + 1e-12
        own = q_id[to, None] == c_id
        low = np.where(own, -np.inf, near - slack)
        least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        i, j = np.nonzero((near + slack >= least[:, None]) & ~own)
        s = _exact(q[to][i], c[j])
        order = np.lexsort((c_id[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        first = np.searchsorted(i, i, side="left")
        top = np.arange(len(i)) - first < k
        out.append((q_id[to][i[top]], c_id[j[top]], s[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id, score: of every query its k nearest among all other rows."""
    cells = _usable(rows, id_col, vec)
    queries = _usable(rows.where(is_query), id_col, vec).groupBy("_id").agg(F.min("_v").alias("_v"))
    n_q, n_c = queries.count(), cells.count()
    q_blocks, c_blocks = max(1, math.ceil(n_q / QUERY_BLOCK)), max(1, math.ceil(n_c / BASE_BLOCK))
    dim = F.size("_v").alias("dim")
    block = lambda n: F.pmod(F.xxhash64("_id", "_v"), F.lit(n)).cast("int")
    # A tile's side has about QUERY_BLOCK or BASE_BLOCK rows, whatever the table's size.
    a = queries.select(dim, block(q_blocks).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("j"), "_id", "_v")
    b = cells.select(dim, F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("i"), block(c_blocks).alias("j"), "_id", "_v")

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        got = tile_top(left["_id"].to_numpy(), np.stack(left["_v"].to_list()), right["_id"].to_numpy(), np.stack(right["_v"].to_list()), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))

    found = a.groupBy("dim", "i", "j").cogroup(b.groupBy("dim", "i", "j")).applyInPandas(tile, FOUND)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One heap of k entries for each query of this partition; its weakest entry is the largest distance, then id."""
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query, vec_id, score in zip(batch["query_id"].tolist(), batch["vec_id"].tolist(), batch["score"].tolist(), strict=True):
                heap, entry = heaps.setdefault(query, []), (score, -vec_id)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        ranked = [(q, r, -i, s) for q, heap in heaps.items() for r, (s, i) in enumerate(sorted(heap, reverse=True), 1)]
        for at in range(0, len(ranked), 50_000):
            yield pd.DataFrame(ranked[at : at + 50_000], columns=["query_id", "rank", "vec_id", "score"])

    return found.repartition(max(1, q_blocks * 4), "query_id").mapInPandas(merged, "query_id long, rank int, vec_id long, score double")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP2_SQL = """
with v as (select vec_id, embedding::double[] e from embeddings
           where embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
             and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id query_id, c.vec_id vec_id, list_inner_product(q.e, c.e) score
      from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= 20
"""
