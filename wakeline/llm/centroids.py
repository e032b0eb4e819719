"""Exact centroid clustering (Lloyd's rounds on integer vectors) filtered by partition-local ball trees.

Vectors become integers floor(scale * x). Each partition cuts its vectors into blocks and builds a metric tree over each: a node
has its ball's centre and radius, the number of its vectors, their integer sum and their sum of squares. A round sends the few
centroids to all blocks. Centroids whose nearest point of a ball is further than another centroid's furthest one can't own any
of the ball's vectors; a ball with one centroid left goes to it whole, by its count and sums, and else its children are asked,
down to leaves, whose vectors are compared exactly in integers. Bounds are kept loose by more than the rounding of doubles, so
ties always reach the leaves, where the smaller number wins. What leaves a partition is a row for each centroid.

Rows whose vector is null, of another width, or holds null or non-finite components take no part. Repeated rows are vectors of
their own. Rows without id are clustered, but start no centroid. Starts that hash alike are ordered by their components. With
fewer vectors than centroids there are as many centroids as vectors; an empty table gives no rows. Extra columns are ignored.
Components beyond 2^27 after scaling would overflow a long distance and are an error that names the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm.common import staged, table

WIDTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Vectors of a block (2 MB of integers) and of a leaf.
BLOCK, LEAF = 4096, 16
#: Larger integers could overflow a long distance; up to EXACT every product and sum is exact in doubles.
LARGEST, EXACT = 1 << 27, 1 << 20
#: Relative slack of the bounds, far above the rounding of doubles.
SLACK = 1e-9


class Tree:
    """A ball tree over ordered integer vectors; node i has the rows lo[i]..hi[i], nodes stand in level order."""

    def __init__(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, parent: np.ndarray, radius: np.ndarray | None = None) -> None:
        self.x, self.lo, self.hi, self.parent = x, lo, hi, parent
        self.count = hi - lo
        whole = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0)])
        square = (x**2).sum(1) if np.abs(x).max(initial=0) <= EXACT else (x.astype(object) ** 2).sum(1)
        squares = np.concatenate([[0], np.cumsum(square)])
        self.sum, self.squares = whole[hi] - whole[lo], squares[hi] - squares[lo]
        self.centre = self.sum / self.count[:, None]
        if radius is None:
            radius = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(lo, hi, self.centre, strict=True)])
        self.radius = radius
        self.leaf = np.ones(len(lo), bool)
        self.leaf[parent[1:]] = False

    @classmethod
    def built(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of some vectors, and their order in it. A node is halved along the line through two far vectors."""
        order = np.arange(len(x))
        lo, hi, parent = [0], [len(x)], [-1]
        at = 0
        while at < len(lo):
            a, b = lo[at], hi[at]
            if b - a > LEAF:
                rows = x[order[a:b]].astype(np.float64)
                far = rows[np.argmax(((rows - rows.mean(0)) ** 2).sum(1))]
                other = rows[np.argmax(((rows - far) ** 2).sum(1))]
                along = rows @ (other - far)
                if along.max() > along.min():
                    half = (b - a) // 2
                    order[a:b] = order[a:b][np.argpartition(along, half)]
                    lo, hi, parent = lo + [a, a + half], hi + [a + half, b], parent + [at, at]
            at += 1
        return cls(x[order], np.array(lo), np.array(hi), np.array(parent)), order

    def owners(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes that have one owner as a whole, or whose vectors must be compared: owner of each node, -1 to compare its rows,
        -2 where an ancestor is settled or the children are asked; and the centroids that a node's vectors may belong to."""
        away = np.sqrt(((self.centre[:, None, :] - centroids[None].astype(np.float64)) ** 2).sum(2))
        reach = (away.min(1) + self.radius) * (1 + SLACK) + SLACK
        may = away - self.radius[:, None] <= reach[:, None]
        owner = np.full(len(self.lo), -2)
        open_ = np.zeros(len(self.lo), bool)
        for i, up in enumerate(self.parent):
            if up >= 0:
                if not open_[up]:
                    continue
                may[i] &= may[up]
            if may[i].sum() == 1:
                owner[i] = int(np.argmax(may[i]))
            elif self.leaf[i]:
                owner[i] = -1
            else:
                open_[i] = True
        return owner, may

    def compared(self, nodes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (in tree order) of leaves to compare, and the exact nearest centroid of each."""
        rows = np.concatenate([np.arange(self.lo[i], self.hi[i]) for i in nodes]) if len(nodes) else np.empty(0, np.int64)
        return rows, np.argmin(distances(self.x[rows], centroids), axis=1) if len(rows) else np.empty(0, np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances; argmin takes the smaller number of ties."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * (a @ c.T) + (c**2).sum(1)).astype(np.int64)
    return ((x[:, None, :] - centroids[None]) ** 2).sum(2)


def integers(rows: DataFrame, vector: str, id_col: str, width: int, scale: int) -> DataFrame:
    """vec_id and x, the integer components, of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) == width)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.forall("v", finite))
    inside = F.forall("v", lambda c: F.abs(c) < LARGEST / scale)
    checked = kept.select("vec_id", F.when(inside, F.col("v")).otherwise(F.raise_error(F.lit(f"components must be under {LARGEST // scale}"))).alias("v"))
    return checked.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


#: What a row of `trees` holds of a block's tree, all int64 but the radii.
PARTS = ("lo", "hi", "parent", "radius")


def trees(kept: DataFrame, width: int) -> DataFrame:
    """A row for each block of a partition's vectors, staged: ids, which of them are known, the vectors in the order of the
    block's tree, and the tree."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(0) for b in held])
            x = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(-1, width)
            tree, order = Tree.built(x.astype(np.int64))
            own = [ids.fill_null(0).to_numpy()[order].astype(np.int64), np.asarray(ids.is_valid())[order], tree.x.astype(np.int32), *[getattr(tree, p) for p in PARTS]]
            return pa.record_batch([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in own], ["ids", "known", "x", *PARTS])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if size + part.num_rows > BLOCK:
                    yield row()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield row()

    return staged(kept.select("vec_id", "x").mapInArrow(cut, ", ".join(f"{c} binary" for c in ("ids", "known", "x", *PARTS))), "balls")


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, known, x, *parts = (batch.column(c)[i].as_py() for c in range(3 + len(PARTS)))
            lo, hi, parent, radius = (np.frombuffer(p, np.float64 if name == "radius" else np.int64) for name, p in zip(PARTS, parts, strict=True))
            yield np.frombuffer(ids, np.int64), np.frombuffer(known, bool), Tree(np.frombuffer(x, np.int32).reshape(-1, width).astype(np.int64), lo, hi, parent, radius)


def totals(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Count, exact sum of squared distances and exact vector sum of every centroid's vectors. A partition sends a row for each
    centroid; whole balls are added by their sums: the squares of their distances are squares - 2 centroid.sum + n centroid^2."""
    k, width = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, inertia, total = [0] * k, [0] * k, np.zeros((k, width), object)
        for _, _, tree in _blocks(batches, width):
            owner, _ = tree.owners(centroids)
            rows, near = tree.compared(np.flatnonzero(owner == -1), centroids)
            for c in range(k):
                balls, own = np.flatnonzero(owner == c), tree.x[rows[near == c]]
                n, s = int(tree.count[balls].sum()) + len(own), tree.sum[balls].sum(0).astype(object) + own.sum(0).astype(object)
                if n:
                    square = sum(int(q) for q in tree.squares[balls]) + sum(int(q) for q in (own.astype(object) ** 2).sum(1))
                    z = centroids[c].astype(object)
                    count[c], total[c], inertia[c] = count[c] + n, total[c] + s, inertia[c] + square - 2 * int((z * s).sum()) + n * int((z * z).sum())
        told = [c for c in range(k) if count[c]]
        text = lambda v: ",".join(map(str, v))
        yield pa.record_batch([pa.array(told, pa.int32()), pa.array([str(count[c]) for c in told], pa.string()), pa.array([str(inertia[c]) for c in told], pa.string()), pa.array([text(total[c]) for c in told], pa.string())], ["cluster", "n", "inertia", "total"])

    whole = "decimal(38,0)"
    parts = blocks.mapInArrow(add, "cluster int, n string, inertia string, total string").select("cluster", F.col("n").cast(whole).alias("n"), F.col("inertia").cast(whole).alias("inertia"), F.split("total", ",").cast(f"array<{whole}>").alias("t"))
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.array(*[F.sum(F.col("t")[i]) for i in range(width)]).alias("t"))
    return {r["cluster"]: (int(r["n"]), int(r["inertia"]), [int(t) for t in r["t"]]) for r in sums.collect()}


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids hash lowest, in that order: k rows come to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    least = kept.where("vec_id is not null").withColumn("key", key).orderBy("key", "x").limit(k).collect()
    return np.array([r["x"] for r in least], np.int64)


def cluster(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id", k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid (its integer components) of every vector.

    Each of `rounds` rounds assigns every vector and moves non-empty centroids to the floor of their mean; then vectors are
    assigned once more. The driver holds k centroids and their sums, nothing that grows with the rows.
    """
    kept = integers(rows, vector, id_col, width, scale)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema)
    blocks = trees(kept, width)
    for _ in range(rounds):
        for c, (n, _, total) in totals(blocks, centroids).items():
            centroids[c] = [t // n for t in total]
    last = totals(blocks, centroids)
    final = centroids.copy()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, known, tree in _blocks(batches, width):
            owner, _ = tree.owners(final)
            near = np.full(len(ids), -1)
            for i in np.flatnonzero(owner >= 0):
                near[tree.lo[i] : tree.hi[i]] = owner[i]
            at, nearest = tree.compared(np.flatnonzero(owner == -1), final)
            near[at] = nearest
            away = ((tree.x - final[near]) ** 2).sum(1)
            yield pa.record_batch([pa.array(ids, mask=~known), pa.array(near, pa.int32()), pa.array(away)], ["vec_id", "cluster", "distance"])

    one = lambda values: F.element_at(F.create_map(*[x for c, v in values.items() for x in (F.lit(c), v)]), F.col("cluster"))
    text = {c: ",".join(map(str, final[c].tolist())) for c in last}
    return blocks.mapInArrow(assign, "vec_id long, cluster int, distance long").select(
        "vec_id", "cluster", "distance",
        one({c: F.lit(i).cast("long") for c, (_, i, _) in last.items()}).alias("cluster_inertia"),
        F.lit(sum(i for _, i, _ in last.values())).cast("long").alias("inertia"),
        one({c: F.sha2(F.lit(t), 256) for c, t in text.items()}).alias("centroid_sha256"),
        one({c: F.split(F.lit(t), ",").cast("array<long>") for c, t in text.items()}).alias("centroid"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def _sql() -> str:
    """Every round as a common table expression: a<r> assigns, c<r> are the centroids of round r."""
    parts = [f"""v as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) x from embeddings
  where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {WIDTH})""",
        "e as materialized (select r, unnest(x) x, generate_subscripts(x, 1) i from v)",
        f"s as (select row_number() over (order by sha256('{SEED}:' || vec_id::varchar), x) - 1 c, x from v where vec_id is not null order by c limit {CENTROIDS})",
        "c0 as materialized (select c, unnest(x) z, generate_subscripts(x, 1) i from s)"]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} as materialized (select r, arg_min(c, (d, c)) c, min(d) d from (select r, c, sum((x - z) * (x - z))::bigint d from e join c{r} using (i) group by r, c) group by r)")
        if r < ROUNDS:
            # Floor of a quotient of integers: the remainder is brought to 0..n-1 before the exact division.
            parts.append(f"m{r} as (select c, i, sum(x)::bigint t, count(*) n from a{r} join e using (r) group by c, i)")
            parts.append(f"c{r + 1} as materialized (select c{r}.c, c{r}.i, coalesce((t - ((t % n) + n) % n) // n, z) z from c{r} left join m{r} on m{r}.c = c{r}.c and m{r}.i = c{r}.i)")
    return f"""with {", ".join(parts)},
h as (select c, sha256(string_agg(z::varchar, ',' order by i)) h from c{ROUNDS} group by c)
select vec_id, c::int as cluster, d distance, (sum(d) over (partition by c))::bigint cluster_inertia, (sum(d) over ())::bigint inertia, h centroid_sha256
from a{ROUNDS} join v using (r) join h using (c)"""


OP11_SQL = _sql()
