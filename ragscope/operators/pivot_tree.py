"""Exact k-nearest-neighbour join (J3, J4) over a tree of pivots.

1. *Tree.* A node with more than ``leaf_size`` points is split: some of its points become pivots (those of smallest hash
   and the one farthest from the node's own pivot), and every point goes to its nearest pivot. Splitting goes on level by
   level until all nodes fit; a node of equal points is cut by id instead.
2. *Blocks.* Each leaf (or part of one) becomes one row: ids, vectors, centre, radius, and for each point its k-th distance r
   within the leaf (infinite if the leaf is small), an upper bound of the true one.
3. *Search.* A block meets every block of its group that its own ball, widened by the largest r, touches, and in it each point
   the blocks within its own r (triangle inequality). A matrix product rules out pairs that are too far by more than its
   error; the distances of the others are computed term by term. A running top k per point goes from block to block, so
   that a point leaves a task with k rows for each range of blocks, not for each block.
4. The rows are merged: ``row_number() <= k`` by (distance, neighbour id), planned as a partial top-k before the shuffle.

Blocks meet in the cells of a grid whose columns have 64 MB of vectors each: a point is sent once per column and once per
row, not once per leaf, and nothing goes through the driver; a task holds one column's blocks in the JVM and a
batch of pairs in Python. The result is exact. The work follows how well distances separate the data, and is
quadratic where they do not.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

DIST_DIGITS = 9   # distances are rounded before ranking so ties resolve by id, identically everywhere
LEAF, FANOUT = 512, 32
PART = 4096       # points of one node that a task holds at a time
HELD = 64 << 20   # bytes of vectors in a column of the grid of blocks that meet


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All Euclidean distances between rows of a and b, without a temporary of rows × rows × dimensions."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        step = x[:, None] - y[None, :]
        out += step * step
    return np.sqrt(out)


def _vectors(column) -> np.ndarray:
    return np.stack(list(column)).astype(np.float64)


def _beside(left: DataFrame, right: DataFrame, key: Sequence[str]):
    """Both sides grouped together; the right one gets columns of its own, as both may come from one table."""
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy(*key).cogroup(right.groupBy(*key))


def _parts(n: str):
    return F.ceil(F.col(n) / PART).cast("int")


def _split(points: DataFrame, big: DataFrame, level: int, fanout: int, leaf_size: int) -> DataFrame:
    """Points of the nodes ``big`` (_g, _node, n) in their child nodes."""
    inside = points.join(big, ["_g", "_node"])
    order = Window.partitionBy("_g", "_node").orderBy("_h", "_id")
    first = (inside.withColumn("_h", F.xxhash64("_id", F.lit(level))).select("_g", "_node", "_id", "_v", "_h", "n")
             .withColumn("_at", F.row_number().over(order)).where((F.col("_at") <= fanout) & (F.col("_at") <= 2 * F.ceil(F.col("n") / leaf_size))))
    far = inside.groupBy("_g", "_node").agg(F.max_by("_v", "_c").alias("_v")) if level else first.where("false").select("_g", "_node", "_v")
    pivots = first.select("_g", "_node", "_v").union(far).groupBy("_g", "_node").agg(
        F.array_sort(F.array_distinct(F.collect_list("_v"))).alias("pivots"))
    left = inside.withColumn("_part", F.pmod(F.xxhash64("_id"), _parts("n")).cast("int")).select("_g", "_node", "_part", "_id", "_v")
    right = pivots.join(big, ["_g", "_node"]).select("_g", "_node", F.explode(F.sequence(F.lit(0), _parts("n") - 1)).alias("_part"), "pivots")

    names = points.columns

    def assign(points_: pd.DataFrame, pivots_: pd.DataFrame) -> pd.DataFrame:
        if not len(points_):
            return pd.DataFrame({c: [] for c in names})
        d = _distances(_vectors(points_["_v"]), _vectors(pivots_["pivots"].iloc[0]))
        near = d.argmin(1)
        node = points_["_node"].iloc[0]
        return points_.assign(_node=[f"{node}.{i}" for i in near], _c=d[np.arange(len(d)), near])[names]

    return cut_lineage(_beside(left, right, ["_g", "_node", "_part"]).applyInPandas(assign, points.schema))


def _pack(k: int):
    """One leaf as one row, points in the order of their ids; points with a coordinate that is not finite are nobody's neighbours."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(pdf["_v"])
        fine = np.isfinite(x).all(1)
        pdf = pdf[fine].assign(_row=np.flatnonzero(fine)).sort_values("_id")
        x = x[pdf["_row"].to_numpy()]
        if not len(pdf):
            return pd.DataFrame({c: [] for c in BLOCK})
        ids, r = pdf["_id"].to_numpy(), np.full(len(x), np.inf)
        for s in range(0, len(x), 256):
            d = _distances(x[s:s + 256], x)
            d[ids[s:s + 256, None] == ids[None, :]] = np.inf
            if k < d.shape[1]:
                r[s:s + 256] = np.round(np.partition(d, k - 1, axis=1)[:, k - 1], DIST_DIGITS)
        centre = x.mean(0)
        radius = float(_distances(x, centre[None, :]).max())
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "_leaf": [pdf["_node"].iloc[0]], "_sub": [pdf["_sub"].iloc[0]], "_ids": [ids.tolist()],
                             "_x": [x.tobytes()], "_r": [r.tobytes()], "_far": [float(r.max())], "_centre": [centre.tolist()], "_radius": [radius]})[BLOCK]
    return pack


BLOCK = ["_g", "_leaf", "_sub", "_ids", "_x", "_r", "_far", "_centre", "_radius"]


class _Block:
    """The points of one block: ids, vectors (rows), bounds, and squared norms."""

    def __init__(self, ids, x: bytes, r: bytes | None, centre, radius: float):
        self.ids = np.array(list(ids))
        self.x = np.frombuffer(x).reshape(len(self.ids), -1)
        self.r = None if r is None else np.frombuffer(r)
        self.centre, self.radius = np.asarray(centre), radius
        self.square = (self.x * self.x).sum(1)


def _reach(q: _Block, bound: np.ndarray, m: _Block) -> np.ndarray:
    """Which points of ``q`` may have one of ``m`` within their bound."""
    d = _distances(q.x, m.centre[None, :])[:, 0]
    return np.flatnonzero(~(d - bound - m.radius > 10.0 ** -(DIST_DIGITS - 1) + (d + m.radius) * 1e-9))


def _within(q: _Block, at: np.ndarray, bound: np.ndarray, m: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``at``'s points, row of ``m``, distance) of all pairs of other ids within the bound."""
    x, square = q.x[at], q.square[at]
    dim = x.shape[1]
    limit = bound[at] + 10.0 ** -(DIST_DIGITS - 1)
    found = []
    for s in range(0, len(at), 512):
        e = slice(s, s + 512)
        with np.errstate(all="ignore"):
            near = -2 * x[e] @ m.x.T
            near += square[e, None]
            near += m.square
            slack = (1e-12 + dim * 1e-15) * (square[e] + m.square.max())
            i, j = np.nonzero(~(near > (limit[e] * limit[e] + slack)[:, None]))
        i = i + s
        for t in range(0, len(i), 1 << 16):   # pairs of many equal points are computed piece by piece
            a, b = i[t:t + (1 << 16)], j[t:t + (1 << 16)]
            step = x[a].T - m.x[b].T
            d = np.round(np.sqrt((step * step).sum(0)), DIST_DIGITS)   # dimension by dimension, as ``_distances``
            ok = (d <= bound[at[a]]) & (d < np.inf) & (q.ids[at[a]] != m.ids[b])
            found.append((at[a[ok]], b[ok], d[ok]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _best(point: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by (distance, id) of every point, points ascending."""
    by = ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((by, dist, point))
    point = point[order]
    start = np.flatnonzero(np.r_[True, point[1:] != point[:-1]]) if len(point) else np.zeros(0, int)
    place = np.arange(len(point)) - np.repeat(start, np.diff(np.r_[start, len(point)]))
    return order[place < k]


def _search(k: int, columns: list):
    """Pairs of blocks, the pairs of one searching block in a row, to the k nearest of its points among the blocks met."""
    def rows(group, q, kept):
        return pd.DataFrame({"_g": group, "_id": q.ids[kept[0]], "nn_id": kept[2], "dist": kept[1]})[columns]

    def search(batches):
        name, q, kept = None, None, None
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                if (t.q_g, t.q_leaf, t.q_sub) != name:
                    if q is not None and len(kept[0]):
                        yield rows(name[0], q, kept)
                    name, q = (t.q_g, t.q_leaf, t.q_sub), _Block(t.q_ids, t.q_x, t.q_r, t.q_centre, t.q_radius)
                    bound, kept = q.r.copy(), (np.zeros(0, int), np.zeros(0), np.zeros(0, q.ids.dtype))
                m = _Block(t.m_ids, t.m_x, None, t.m_centre, t.m_radius)
                i, j, d = _within(q, _reach(q, bound, m), bound, m)
                if not len(i):
                    continue
                i, d, ids = np.r_[kept[0], i], np.r_[kept[1], d], np.concatenate([kept[2], m.ids[j]])
                first = _best(i, d, ids, k)
                kept = i[first], d[first], ids[first]
                full = np.flatnonzero(np.bincount(kept[0], minlength=len(bound)) == k)
                last = np.searchsorted(kept[0], full, side="right") - 1
                bound[full] = np.minimum(bound[full], kept[1][last])
        if q is not None and len(kept[0]):
            yield rows(name[0], q, kept)
    return search


def _visited(batches):
    """The searches behind ``_search``: (id, block) of each point and each other block within its first bound."""
    for pdf in batches:
        for t in pdf.itertuples(index=False):
            if (t.q_leaf, t.q_sub) != (t.m_leaf, t.m_sub):
                q = _Block(t.q_ids, t.q_x, t.q_r, t.q_centre, t.q_radius)
                at = _reach(q, q.r, _Block(t.m_ids, t.m_x, None, t.m_centre, t.m_radius))
                yield pd.DataFrame({"_id": q.ids[at], "leaf": t.m_leaf, "part": t.m_sub})


def _meetings(blocks: DataFrame) -> DataFrame:
    """All pairs of blocks of one group whose points may be neighbours. Searching blocks are dealt to rows of a grid and met blocks to its
    columns; a block is sent to every cell of its row or column and joined there. A column has about 64 MB, rows are as many as
    columns, or as give every core some cells, so that a block is sent as often as the grid is long, not once per block."""
    n, size = blocks.agg(F.count(F.lit(1)), F.sum(F.length("_x"))).first()
    columns = max(1, -(-int(size or 0) // HELD))
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    rows = max(columns, min(max(1, n), -(-2 * cores // columns)))
    place = F.xxhash64("_g", "_leaf", "_sub")
    met = [c for c in BLOCK if c not in ("_r", "_far")]
    q = blocks.select(F.pmod(place, F.lit(rows)).alias("_row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).alias("_column"),
                      *[F.col(c).alias(f"q{c}") for c in BLOCK])
    m = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("_mrow"), F.pmod(place, F.lit(columns)).alias("_mcolumn"),
                      *[F.col(c).alias(f"m{c}") for c in met])
    apart = F.sqrt(F.aggregate(F.zip_with("q_centre", "m_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    touch = ~(apart * (1 - 1e-9) > F.col("q_radius") + F.col("m_radius") + F.col("q_far") + 10.0 ** -(DIST_DIGITS - 1))
    same = (F.col("q_g") == F.col("m_g")) & (F.col("_row") == F.col("_mrow")) & (F.col("_column") == F.col("_mcolumn"))
    return q.join(m.hint("merge"), same & touch).drop("_row", "_column", "_mrow", "_mcolumn")


def knn(df: DataFrame, id_col: str, vec_col: str, k: int, group_cols: Sequence[str] = (), leaf_size: int = LEAF,
        fanout: int = FANOUT, visits_out: list | None = None) -> DataFrame:
    """Exact k nearest neighbours (Euclidean, self excluded) of every row, within ``group_cols`` (null is a group).

    Returns (group..., id, nn_id, dist, rank) with rank 1..k; ties by neighbour id. Rows without a vector or
    an id have no neighbours and are nobody's. ``visits_out`` receives the table of other leaves within a point's first bound, (_id, leaf,
    part) per search, to judge the pruning."""
    g = list(group_cols)
    id_type = df.schema[id_col].dataType
    group_schema = T.StructType([df.schema[c] for c in g])
    points = df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(
        (F.to_json(F.struct(*g)) if g else F.lit("")).alias("_g"), F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"),
        F.lit("").alias("_node"), F.lit(float("inf")).alias("_c"))
    points = cut_lineage(points)
    done, level = [], 0
    while True:
        sizes = points.groupBy("_g", "_node").agg(F.count(F.lit(1)).alias("n"), F.max("_c").alias("radius"))
        big = cut_lineage(sizes.where((F.col("n") > leaf_size) & (F.col("radius") > 0)).select("_g", "_node", "n"))
        if big.isEmpty():
            done.append(points)
            break
        done.append(points.join(big.drop("n"), ["_g", "_node"], "left_anti"))
        points = _split(points, big, level, fanout, leaf_size)
        level += 1
    points = done[0]
    for more in done[1:]:
        points = points.unionByName(more)
    leaves = points.groupBy("_g", "_node").agg(F.ceil(F.count(F.lit(1)) / (2 * leaf_size)).cast("int").alias("_ns"))
    points = (points.join(leaves, ["_g", "_node"]).withColumn("_sub", F.pmod(F.xxhash64("_id"), F.col("_ns")).cast("int"))
              .select("_g", "_id", "_v", "_node", "_sub"))
    numbers = T.ArrayType(T.DoubleType())
    block = dict(zip(BLOCK, [T.StringType(), T.StringType(), T.IntegerType(), T.ArrayType(id_type), T.BinaryType(), T.BinaryType(), T.DoubleType(), numbers, T.DoubleType()]))
    blocks = cut_lineage(points.groupBy("_g", "_node", "_sub").applyInPandas(_pack(k), T.StructType([T.StructField(c, t) for c, t in block.items()])))
    pairs = _meetings(blocks)
    if visits_out is not None:
        visits_out.append(pairs.mapInPandas(_visited, T.StructType([T.StructField("_id", id_type), T.StructField("leaf", T.StringType()), T.StructField("part", T.IntegerType())])))
    cand = T.StructType([T.StructField("_g", T.StringType()), T.StructField("_id", id_type), T.StructField("nn_id", id_type), T.StructField("dist", T.DoubleType())])
    best = Window.partitionBy("_g", "_id").orderBy(F.col("dist").asc(), F.col("nn_id").asc())
    out = pairs.mapInPandas(_search(k, cand.names), cand).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    groups = [F.from_json("_g", group_schema)[c].alias(c) for c in g]
    return out.select(*groups, F.col("_id").alias(id_col), "nn_id", "dist", F.col("rank").cast("int").alias("rank"))
