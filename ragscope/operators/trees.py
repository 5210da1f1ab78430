"""Tree learners on histograms of binned rows: drop-in estimators for Spark ML's boosted trees and forests (M1-M6).

Same parameters, split candidates (at most ``maxBins`` quantile bins a feature), losses, impurities, sampling and model classes as
Spark ML's learners, which hold a row as an object with an int per feature and update a statistic for each of them, one by one.

1. *Rows.* A row becomes its bins, and the bins of several features together one 16-bit code: ten flags, or two features of 32 bins.
   Rows travel in blocks of arrays, about a tenth of the bytes of Spark ML's.
2. *Histograms.* One ``bincount`` over a code gives the joint histogram of its features; sums over it give each feature's own. Boosted trees
   count the smaller of two sister nodes and subtract. A forest's node counts only the features it may split on.
3. *Sums.* Partial histograms of boosted trees (bounded by nodes x bins) are added on the driver, those of forests in a shuffle by
   node, so that only the chosen splits come to the driver. Few rows are fitted in one task without any exchange.
4. *Models.* Trees are written in Spark ML's own format and loaded as its models.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CELLS = 1 << 10       # bins of the features of one code together
ROWS = 1 << 16        # rows of a block
SAMPLE = 10_000       # rows that split candidates are taken from (as Spark ML)
HERE = 64 << 20       # bytes of blocks that one task fits alone
CHUNK = 512           # nodes of a forest whose histograms go together
PASS = 64 << 20       # bytes of histograms that a task holds of a forest's level
FINISHED = 0xFFFF


# ───────────────────────────── bins ─────────────────────────────
def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Split candidates of one feature: midpoints between values, at most ``bins`` - 1, at even ranks (Spark ML's rule)."""
    v, n = np.unique(values, return_counts=True)
    if len(v) <= bins:
        return (v[:-1] + v[1:]) / 2
    out, stride = [], len(values) / bins
    target, count = stride, n[0]
    for i in range(1, len(v)):
        before, count = count, count + n[i]
        if abs(before - target) < abs(count - target):
            out.append((v[i - 1] + v[i]) / 2)
            target += stride
    return np.array(out)


class Layout:
    """Which code and which digit of it holds a feature's bin."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts, self.size = cuts, np.array([len(c) + 1 for c in cuts])
        n = len(cuts)
        self.code, self.stride, self.cells = np.zeros(n, np.int64), np.ones(n, np.int64), []
        for f in np.argsort(-self.size, kind="stable"):
            size = self.size[f]
            if size == 1:
                continue   # a constant has no split
            at = next((g for g, c in enumerate(self.cells) if c * size <= CELLS), len(self.cells))
            if at == len(self.cells):
                self.cells.append(1)
            self.code[f], self.stride[f] = at, self.cells[at]
            self.cells[at] *= int(size)
        self.cells = self.cells or [1]
        self.start = np.r_[0, np.cumsum(self.size)]
        self.used = np.flatnonzero(self.size > 1)
        most = max(self.cells)
        self.digit = ((np.arange(most)[None, :] // self.stride[:, None]) % self.size[:, None]).astype(np.uint16)   # feature, code -> bin
        self.feature = np.repeat(np.arange(n), self.size)
        last = np.zeros(self.start[-1], bool)
        last[self.start[1:] - 1] = True
        self.can = ~last     # a split behind a feature's last bin sends all rows left

    def codes(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(self.cells), len(columns[0])), np.uint16)
        for f in self.used:
            cut, x = self.cuts[f], columns[f]
            b = (x > cut[0]).astype(np.uint16) if len(cut) == 1 else np.searchsorted(cut, x).astype(np.uint16)
            if self.stride[f] > 1:
                b *= np.uint16(self.stride[f])
            out[self.code[f]] += b
        return out


@dataclass
class Binned:
    """The training rows as blocks, kept until ``unpersist``."""

    spark: SparkSession
    rdd: object
    layout: Layout
    rows: int
    n_features: int

    def count(self) -> int:
        return self.rows

    def unpersist(self) -> None:
        self.rdd.unpersist()


def _numbers(column) -> np.ndarray:
    """A column without nulls and NaN (0 instead, P10)."""
    column = pc.fill_null(column, pa.scalar(0, column.type)) if column.null_count else column
    x = column.to_numpy(zero_copy_only=False)
    if x.dtype.kind == "f" and np.isnan(x).any():
        x = np.where(np.isnan(x), 0, x)
    return x.astype(np.float64) if x.dtype == bool or x.dtype == object else x


def _in_pieces(df: DataFrame) -> DataFrame:
    """``df`` with constant columns behind its own, so that it has more than whole-stage code generation takes. A projection of many computed
    columns would become one method, too long for the JVM's compiler and so interpreted; beyond that number Spark splits it."""
    most = int(df.sparkSession.conf.get("spark.sql.codegen.maxFields", "100"))
    return df.select("*", *[F.lit(0).cast("byte").alias(f"_pad{i}") for i in range(most + 1 - len(df.columns))]) if len(df.columns) > 30 else df


def bin_rows(df: DataFrame, features: Sequence[str] | str, label: str, weight: str | None = None, bins: int = 32, per_core: int = 2) -> Binned:
    """Blocks of ``df``'s rows; ``features`` are number columns (null and NaN count as 0) or the name of a vector column."""
    spark = df.sparkSession
    y, w = F.col(label).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")
    if isinstance(features, str):
        x = [vector_to_array(F.col(features)).alias("_x")]
        keys = []
    else:
        x = [(F.col(f"`{f}`") if f in set(df.columns) else F.lit(0.0)).alias(f"_f{i}") for i, f in enumerate(features)]
        keys = [c for c in df.columns if c not in {*features, label, weight}]
    width, rows = len(x), df.count()
    if not rows:
        raise ValueError("no rows to learn from")
    share = max(SAMPLE, bins * bins) / rows

    def sampled(part: DataFrame) -> np.ndarray:
        table = _in_pieces(part.select(*x)).toArrow()
        if isinstance(features, str):
            flat = table.column(0).combine_chunks()
            return flat.flatten().to_numpy().reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))
        return np.column_stack([_numbers(table.column(i).combine_chunks()) for i in range(width)]) if len(table) else np.zeros((0, width))

    if share >= 1:
        values = sampled(df)
    else:
        # by a hash of the row's other columns, which the scan can filter by before features are computed; equal rows go together
        values = sampled(df.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in keys]), F.lit(1 << 30)) < int(share * (1 << 30)))) if keys else np.zeros((0, 0))
        if not 0.5 < len(values) / (share * rows) < 2:
            values = sampled(df.sample(share, seed=42))
    layout = Layout([thresholds(v, bins) for v in values.T])

    def blocks(batches):
        held: list = []

        def out():
            codes, ys, ws = (np.concatenate(p, axis=-1) for p in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (codes, ys, ws)], names=["codes", "y", "w"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if isinstance(features, str):
                wide = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                columns = list(wide.T)
            else:
                columns = [_numbers(batch.column(i)) for i in range(2, 2 + width)]
            ys, ws = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
            if np.isnan(ys).any():
                raise ValueError(f"labels must not be null or NaN: {label}")
            held.append((layout.codes(columns), ys, ws))
            if sum(len(h[1]) for h in held) >= ROWS:
                yield out()
        if held:
            yield out()

    n_codes = len(layout.cells)

    def arrays(part, rows_):
        for i, r in enumerate(rows_):
            ys = np.frombuffer(r["y"])
            yield {"id": (part, i), "codes": np.frombuffer(r["codes"], np.uint16).reshape(n_codes, len(ys)), "y": ys, "w": np.frombuffer(r["w"])}

    most = per_core * spark.sparkContext.defaultParallelism
    binned = _in_pieces(df.select(y, w, *x)).mapInArrow(blocks, "codes binary, y binary, w binary")
    rdd = binned.rdd.mapPartitionsWithIndex(arrays).coalesce(most).persist(StorageLevel.MEMORY_AND_DISK)
    rdd.foreachPartition(lambda held: sum(1 for _ in held))   # made once, before learners read it side by side
    return Binned(spark, rdd, layout, rows, len(layout.cuts))


# ───────────────────────────── where blocks are ─────────────────────────────
class Here:
    """All blocks in this process."""

    def __init__(self, blocks):
        self.blocks = [dict(b) for b in blocks]

    def each(self, fn) -> list:
        return [fn(iter(self.blocks))]

    def advance(self, fn) -> None:
        self.blocks = [fn(b) for b in self.blocks]

    def reduced(self, emit, best) -> list:
        return [x for key, part in emit(iter(self.blocks)) for x in best(key, part)]

    def close(self) -> None:
        pass


class Spread:
    """Blocks in the partitions of an RDD; partial sums are added in the order of partitions, so that results do not depend on scheduling."""

    def __init__(self, rdd):
        self.rdd, self.first, self.old, self.turns = rdd, rdd, None, 0

    def each(self, fn) -> list:
        found = self.rdd.mapPartitionsWithIndex(lambda i, blocks: [(i, fn(blocks))]).collect()
        self._drop()
        return [part for _, part in sorted(found, key=lambda t: t[0])]

    def advance(self, fn) -> None:
        self._drop()
        self.old, self.rdd = self.rdd, self.rdd.map(fn).persist(StorageLevel.MEMORY_AND_DISK)
        self.turns += 1
        if self.turns % 50 == 0:   # so that the lineage stays short
            self.rdd.checkpoint()

    def reduced(self, emit, best) -> list:
        def added(parts):
            held: dict = {}
            for key, part in parts:
                held.setdefault(key, []).append(part)
            for key in sorted(held):
                yield from best(key, sum(arr for _, arr in sorted(held[key], key=lambda t: t[0])))

        parts = self.rdd.mapPartitionsWithIndex(lambda i, blocks: ((key, (i, part)) for key, part in emit(blocks)))
        found = parts.partitionBy(self.rdd.getNumPartitions()).mapPartitions(added).collect()
        self._drop()
        return found

    def _drop(self) -> None:
        if self.old is not None and self.old is not self.first:
            self.old.unpersist()
        self.old = None

    def close(self) -> None:
        self._drop()
        if self.rdd is not self.first:
            self.rdd.unpersist()


# ───────────────────────────── trees ─────────────────────────────
@dataclass
class Tree:
    """Nodes in the order of their making. ``stats``: weight, sum, sum of squares (regression), or weight by class."""

    feat: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    stats: list = field(default_factory=list)
    raw: list = field(default_factory=list)

    def add(self, stats) -> int:
        for column, value in zip((self.feat, self.bin, self.left, self.right, self.gain, self.stats, self.raw), (-1, 0, -1, -1, -1.0, stats, -1)):
            column.append(value)
        return len(self.feat) - 1


def _walk(codes: np.ndarray, tree: Tree, layout: Layout) -> np.ndarray:
    """The node of a partly grown tree in which each row ends."""
    n = codes.shape[1]
    node = np.zeros(n, np.int64)
    feat, left, right = np.array(tree.feat), np.array(tree.left), np.array(tree.right)
    inner = left >= 0
    if not inner.any():
        return node
    own = np.arange(len(feat))
    code = np.where(inner, layout.code[feat], 0) * n
    goes = np.zeros((len(feat), layout.digit.shape[1]), bool)
    goes[inner] = layout.digit[feat[inner]] <= np.array(tree.bin)[inner, None]
    child = np.concatenate([np.where(inner, right, own), np.where(inner, left, own)])
    flat, wide, place = codes.ravel(), goes.ravel(), np.arange(n)
    depth, level = 0, [0]
    while True:
        level = [c for i in level if inner[i] for c in (left[i], right[i])]
        if not level:
            break
        depth += 1
    for _ in range(depth):
        c = flat[code[node] + place]
        node = child[node + wide[node * goes.shape[1] + c] * len(feat)]
    return node


def _target(block: dict, loss: str, turn: int) -> np.ndarray:
    """What the tree of this turn fits: the labels, then the loss's negative gradient at the scores so far."""
    if loss == "squared":
        return block["y"] if not turn else 2 * (block["y"] - block["f"])
    sign = 2 * block["y"] - 1
    return sign if not turn else 4 * sign / (1 + np.exp(2 * sign * block["f"]))


def _taken(block: dict, spec: dict, turn: int) -> np.ndarray | None:
    if spec["rate"] >= 1:
        return None
    return np.random.default_rng([spec["seed"], turn, *block["id"]]).random(len(block["y"]), np.float32) < spec["rate"]


def _histograms(layout: Layout, tree: Tree, slots: np.ndarray, spec: dict, turn: int):
    """Weight and sum by (slot, bin of each feature); ``slots`` gives the place of a node's histogram or -1."""
    n = int(slots.max()) + 1

    def count(blocks):
        joint = [np.zeros((2, n * c)) for c in layout.cells]
        for b in blocks:
            slot = slots[_walk(b["codes"], tree, layout)]
            keep = slot >= 0
            taken = _taken(b, spec, turn)
            rows = np.flatnonzero(keep if taken is None else keep & taken)
            g, s = _target(b, spec["loss"], turn)[rows], slot[rows]
            if spec["weighted"]:
                w = b["w"][rows]
                g = g * w
            for total, cells, code in zip(joint, layout.cells, b["codes"]):
                at = s * cells + code[rows]
                total[0] += np.bincount(at, w, n * cells) if spec["weighted"] else np.bincount(at, minlength=n * cells)
                total[1] += np.bincount(at, g, n * cells)
        out = np.zeros((2, n, layout.start[-1]))
        for f in layout.used:
            own = joint[layout.code[f]].reshape(2, n, -1, layout.size[f], layout.stride[f])
            out[:, :, layout.start[f]: layout.start[f + 1]] = own.sum((2, 4))
        if len(layout.used):   # a constant feature's only bin has all rows
            whole = out[:, :, layout.start[layout.used[0]]: layout.start[layout.used[0] + 1]].sum(2)
        else:
            whole = joint[0].reshape(2, n, -1).sum(2)
        return out, whole
    return count


def _leaf_squares(layout: Layout, tree: Tree, step: float, spec: dict, turn: int):
    """A block with the tree's values added to its scores, and (rows, sum of squares) of what each leaf was fitted to."""
    value = np.array([s[1] / s[0] if s[0] else 0.0 for s in tree.stats])

    def move(b):
        node = _walk(b["codes"], tree, layout)
        g, taken = _target(b, spec["loss"], turn), _taken(b, spec, turn)
        at, square = (node, g * g) if taken is None else (node[taken], (g * g)[taken])
        if spec["weighted"]:
            square = square * (b["w"] if taken is None else b["w"][taken])
        return b | {"f": b.get("f", 0.0) + step * value[node], "leaves": np.stack([np.bincount(at, minlength=len(value)), np.bincount(at, square, len(value))])}
    return move


def _choose(layout: Layout, weight: np.ndarray, total: np.ndarray, whole: np.ndarray, share: float, rng):
    """For each node (row) the best split among a random part of the features: (gain, place of the last bin that goes left,
    left weight and sum); the gain is that of the variance."""
    first = layout.start[:-1][layout.feature]

    def before(h):
        run = np.cumsum(h, axis=1)
        return run - (run - h)[:, first]
    lw, ls = before(weight), before(total)
    w, s = whole[0][:, None], whole[1][:, None]
    rw, rs = w - lw, s - ls
    tiny = 1e-9 * np.abs(w)
    ok = layout.can & (lw > tiny) & (rw > tiny)
    n_features = len(layout.size)
    if share < 1:
        most = max(1, int(np.ceil(share * n_features)))
        allowed = np.zeros((len(w), n_features), bool)
        for row in allowed:
            row[rng.choice(n_features, most, replace=False)] = True
        ok &= allowed[:, layout.feature]
    with np.errstate(all="ignore"):
        gain = np.where(ok, ls * ls / lw + rs * rs / rw - s * s / w, -np.inf)
    at = gain.argmax(1)
    row = np.arange(len(at))
    best = gain[row, at]
    best = np.where(best > 1e-10 * (s * s / np.maximum(w, 1e-300))[:, 0] + 1e-300, best / w[:, 0], 0.0)
    return best, at, lw[row, at], ls[row, at]


def _grow(run, layout: Layout, spec: dict, turn: int) -> Tree:
    """One tree, level by level; of two sister nodes the lighter one is counted, the other is what is left of their parent."""
    tree, rng = Tree(), np.random.default_rng([spec["seed"], 7, turn])
    root = tree.add(None)
    level, known = [root], {}
    for depth in range(spec["depth"]):
        counted = [i for i in level if i == root or known[i][0] == "count"]
        slots = np.full(len(tree.feat), -1)
        slots[counted] = np.arange(len(counted))
        parts = run.each(_histograms(layout, tree, slots, spec, turn))
        hist, whole = sum(p[0] for p in parts), sum(p[1] for p in parts)
        own = {i: (hist[:, k], whole[:, k]) for k, i in enumerate(counted)}
        if depth == 0:
            tree.stats[root] = [whole[0, 0], whole[1, 0], 0.0]
        for i in level:
            if i not in own:
                _, parent, sister = known[i]
                own[i] = (parent[0] - own[sister][0], parent[1] - own[sister][1])
        h = np.stack([own[i][0] for i in level], 1)
        t = np.stack([own[i][1] for i in level], 1)
        gain, at, lw, ls = _choose(layout, h[0], h[1], t, spec["share"], rng)
        following, known = [], {}
        for k, i in enumerate(level):
            if gain[k] <= 0:
                continue
            f = int(layout.feature[at[k]])
            tree.feat[i], tree.bin[i], tree.gain[i] = f, int(at[k] - layout.start[f]), float(gain[k])
            left = tree.left[i] = tree.add([lw[k], ls[k], 0.0])
            right = tree.right[i] = tree.add([t[0, k] - lw[k], t[1, k] - ls[k], 0.0])
            light, heavy = (left, right) if 2 * lw[k] <= t[0, k] else (right, left)
            known[light], known[heavy] = ("count",), ("rest", own[i], light)
            following += [left, right]
        level = following
        if not level:
            break
    return tree


def _squares_up(tree: Tree, leaves: np.ndarray) -> None:
    """Rows and sums of squares of all nodes from those of the leaves."""
    for i in reversed(range(len(tree.feat))):
        if tree.left[i] < 0:
            raw, square = leaves[0][i], leaves[1][i]
        else:
            raw, square = (tree.raw[tree.left[i]] + tree.raw[tree.right[i]], tree.stats[tree.left[i]][2] + tree.stats[tree.right[i]][2])
        tree.raw[i], tree.stats[i][2] = int(raw), float(square)


def boost(run, layout: Layout, spec: dict) -> list[tuple[Tree, float]]:
    """Gradient boosting: the first tree fits the labels, each other the negative gradient of the loss on a part of the rows."""
    out = []
    for turn in range(spec["rounds"]):
        tree, step = _grow(run, layout, spec, turn), spec["step"] if turn else 1.0
        run.advance(_leaf_squares(layout, tree, step, spec, turn))
        _squares_up(tree, sum(run.each(lambda blocks: sum(b["leaves"] for b in blocks))))
        out.append((tree, step))
    return out


# ───────────────────────────── forests ─────────────────────────────
def _poisson() -> np.ndarray:
    """How often a row comes in a bootstrap, by a number of 16 bits."""
    p, out = np.exp(-1.0), np.zeros(0, np.uint8)
    shares, k = [], 0
    while sum(shares) < 1 - 1e-6 and k < 12:
        shares.append(p)
        k += 1
        p /= k
    edges = np.round(np.cumsum(shares) * 65536).astype(int)
    edges[-1] = 65536
    return np.repeat(np.arange(len(edges)), np.diff(np.r_[0, edges])).astype(np.uint8)


POISSON = _poisson()


def _times(block: dict, spec: dict, tree: int) -> np.ndarray:
    return POISSON[np.random.default_rng([spec["seed"], 11, tree, *block["id"]]).integers(0, 65536, len(block["y"]), np.uint16)]


def _node_histograms(layout: Layout, plan: list, spec: dict):
    """Statistics of the open nodes of some trees by the bins of their own features. ``plan``: (tree, number of its first node, features of
    its open nodes). Yields chunks of nodes, each node's cells in a row: features x largest bins x statistics."""
    width, per = int(layout.size.max()), spec["classes"] or 3
    k = plan[0][2].shape[1]

    def emit(blocks):
        total = {t: np.zeros(len(feats) * k * width * per) for t, _, feats in plan}
        for b in blocks:
            n, flat = len(b["y"]), b["codes"].ravel()
            for t, _, feats in plan:
                times = _times(b, spec, t)
                open_ = times > 0
                if "node" in b:
                    open_ &= b["node"][t] != FINISHED
                rows = np.flatnonzero(open_)
                s = b["node"][t][rows].astype(np.int64) if "node" in b else np.zeros(len(rows), np.int64)
                w, y = times[rows].astype(float), b["y"][rows]
                if spec["weighted"]:
                    w *= b["w"][rows]
                code, digit, most = layout.code * n, layout.digit.ravel(), layout.digit.shape[1]
                out = total[t]
                if spec["classes"]:
                    y = y.astype(np.int64)
                for j in range(k):
                    f = feats[:, j][s]
                    bin_ = digit[f * most + flat[code[f] + rows]]
                    at = ((s * k + j) * width + bin_) * per
                    if spec["classes"]:
                        out += np.bincount(at + y, w, len(out)) if len(rows) * 8 > len(out) else _scattered(out, at + y, w)
                    else:
                        for c, v in enumerate((w, w * y, w * y * y)):
                            out += np.bincount(at + c, v, len(out)) if len(rows) * 8 > len(out) else _scattered(out, at + c, v)
        for t, first, feats in plan:
            cells = total[t].reshape(len(feats), -1)
            for a in range(0, len(feats), CHUNK):
                yield (t, first + a), cells[a: a + CHUNK]
    return emit


def _scattered(out: np.ndarray, at: np.ndarray, v: np.ndarray) -> float:
    np.add.at(out, at, v)
    return 0.0


def _node_splits(layout: Layout, feats: dict, spec: dict):
    """The best split of each node of a chunk: (tree, node, gain, feature, bin, statistics left and right)."""
    width, per = int(layout.size.max()), spec["classes"] or 3

    def best(key, cells):
        t, first = key
        mine = feats[t][first: first + len(cells)]
        h = np.cumsum(cells.reshape(len(cells), -1, width, per), axis=2)
        whole = h[:, :1, -1:, :]
        left, right = h, whole - h
        if spec["classes"]:
            right = np.where(right > 1e-9 * whole, right, 0.0)   # what is left of sums of weights is not exactly zero
        w = (lambda x: x.sum(-1)) if spec["classes"] else (lambda x: x[..., 0])
        lw, rw, all_ = w(left), w(right), w(whole)

        def spread(x, n):   # impurity times weight
            with np.errstate(all="ignore"):
                return np.where(n > 0, n - (x * x).sum(-1) / n if spec["classes"] else x[..., 2] - x[..., 1] ** 2 / n, 0.0)
        parent = spread(whole, all_)
        gain = parent - spread(left, lw) - spread(right, rw)
        tiny = 1e-9 * all_
        ok = (lw > tiny) & (rw > tiny) & (np.arange(width)[None, None, :] < layout.size[mine][:, :, None] - 1)
        gain = np.where(ok, gain, -np.inf).reshape(len(cells), -1)
        at = gain.argmax(1)
        for i, a in enumerate(at):
            j, b = divmod(int(a), width)
            total = float(all_[i, 0, 0])
            g = float(gain[i, a])
            scale = total if spec["classes"] else abs(float(whole[i, 0, 0, 2]))
            good = g > 1e-10 * scale
            yield (t, first + i, g / total if good else 0.0, int(mine[i, j]), b, left[i, j, b].tolist(), right[i, j, b].tolist(), whole[i, 0, 0].tolist())
    return best


def _down(layout: Layout, splits: dict):
    """A block with the rows of each tree moved to the next level's nodes. ``splits``: by tree (feature, bin, left place, right place)."""
    def move(b):
        n, flat = len(b["y"]), b["codes"].ravel()
        place, digit, most = np.arange(n), layout.digit.ravel(), layout.digit.shape[1]
        old = b.get("node")
        node = np.full((max(splits) + 1, n), FINISHED, np.uint16) if old is None else np.full(old.shape, FINISHED, np.uint16)
        for t, (feat, last, left, right) in splits.items():
            rows = place if old is None else np.flatnonzero(old[t] != FINISHED)
            s = np.zeros(n, np.int64) if old is None else old[t][rows].astype(np.int64)
            f = feat[s]
            node[t][rows] = np.where(digit[f * most + flat[layout.code[f] * n + rows]] <= last[s], left[s], right[s])
        return b | {"node": node}
    return move


def _impurity(stats: Sequence[float], classes: int) -> float:
    w = sum(stats) if classes else stats[0]
    if not w:
        return 0.0
    return 1 - sum((s / w) ** 2 for s in stats) if classes else max(0.0, stats[2] / w - (stats[1] / w) ** 2)


def forest(run, layout: Layout, spec: dict) -> list[tuple[Tree, float]]:
    """Trees on bootstraps of the rows, all grown together level by level, each node on a random part of the features."""
    trees, n_features = [Tree() for _ in range(spec["rounds"])], len(layout.size)
    k = max(1, min(n_features, spec["share"]))
    rng = np.random.default_rng([spec["seed"], 13])
    open_ = {t: [tree.add(None)] for t, tree in enumerate(trees)}
    cell = k * int(layout.size.max()) * (spec["classes"] or 3) * 8
    for depth in range(spec["depth"]):
        feats = {t: np.stack([rng.choice(n_features, k, replace=False) for _ in nodes]) for t, nodes in open_.items() if nodes}
        found, plan, held = [], [], 0
        pieces = [(t, f) for t, f in feats.items()]
        for i, (t, f) in enumerate(pieces):
            plan.append((t, 0, f))
            held += len(f) * cell
            if held > PASS or i == len(pieces) - 1:
                found += run.reduced(_node_histograms(layout, plan, spec), _node_splits(layout, feats, spec))
                plan, held = [], 0
        splits, following = {}, {}
        for t in feats:
            n = len(open_[t])
            splits[t] = (np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, FINISHED), np.full(n, FINISHED))
            following[t] = []
        for t, at, gain, f, last, left, right, whole in sorted(found, key=lambda x: x[:2]):
            tree, i = trees[t], open_[t][at]
            if tree.stats[i] is None:
                tree.stats[i] = whole
            if gain <= 0:
                continue
            tree.feat[i], tree.bin[i], tree.gain[i] = f, last, gain
            splits[t][0][at], splits[t][1][at] = f, last
            for side, stats, places in ((tree.left, left, splits[t][2]), (tree.right, right, splits[t][3])):
                side[i] = tree.add(stats)
                if depth + 1 < spec["depth"] and _impurity(stats, spec["classes"]) > 1e-12:
                    places[at] = len(following[t])
                    following[t].append(side[i])
        open_ = {t: nodes for t, nodes in following.items() if nodes}
        if not open_:
            break
        run.advance(_down(layout, splits))
    return [(tree, 1.0) for tree in trees]


# ───────────────────────────── Spark ML models ─────────────────────────────
NODE = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
                  ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
                  ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))])


def _nodes(tree: Tree, layout: Layout, classes: int) -> list[dict]:
    """The tree as Spark ML saves it: nodes numbered from the root, left before right; two leaves of one prediction are one leaf."""
    out: list = []

    def prediction(i):
        s = tree.stats[i]
        return float(np.argmax(s)) if classes else (s[1] / s[0] if s[0] else 0.0)

    leaf = {}
    for i in reversed(range(len(tree.feat))):   # children come after their parent
        left, right = tree.left[i], tree.right[i]
        leaf[i] = prediction(i) if left < 0 else leaf[left] if leaf[left] is not None and leaf[left] == leaf[right] else None

    def add(i) -> int:
        at, s = len(out), [float(x) for x in tree.stats[i]]
        raw = tree.raw[i] if tree.raw[i] >= 0 else int(round(sum(s) if classes else s[0]))
        node = {"id": at, "prediction": prediction(i), "impurity": _impurity(s, classes), "impurityStats": s, "rawCount": raw, "gain": -1.0, "leftChild": -1,
                "rightChild": -1, "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        out.append(node)
        if leaf[i] is None:
            f = tree.feat[i]
            node |= {"gain": tree.gain[i], "split": {"featureIndex": f, "leftCategoriesOrThreshold": [float(layout.cuts[f][tree.bin[i]])], "numCategories": -1}}
            node["leftChild"] = add(tree.left[i])
            node["rightChild"] = add(tree.right[i])
        else:
            node["prediction"] = leaf[i]
        return at
    add(0)
    return out


def spark_model(spark: SparkSession, est, model_class, trees: list[tuple[Tree, float]], layout: Layout, classes: int):
    """Spark ML's own model of these trees, by its saved form."""
    kind = "classification" if model_class.__module__.endswith("classification") else "regression"
    sub = "DecisionTreeClassificationModel" if classes else "DecisionTreeRegressionModel"
    given = {p.name: v for p, v in est._paramMap.items()}
    default = {p.name: v for p, v in est._defaultParamMap.items()}
    now = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    head = {"class": f"org.apache.spark.ml.{kind}.{model_class.__name__}", **now, "uid": est.uid, "paramMap": given, "defaultParamMap": default,
            "numFeatures": len(layout.cuts), **({"numClasses": classes} if classes else {}), "numTrees": len(trees)}
    own = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB", "minInfoGain", "minInstancesPerNode",
           "minWeightFractionPerNode", "predictionCol", "seed", "weightCol", *(("probabilityCol", "rawPredictionCol") if classes else ())}
    part = {"class": f"org.apache.spark.ml.{'classification' if classes else 'regression'}.{sub}", **now,
            "paramMap": {k: v for k, v in given.items() if k in own}, "defaultParamMap": {k: v for k, v in default.items() if k in own}}
    rows = [(i, n) for i, (tree, _) in enumerate(trees) for n in _nodes(tree, layout, classes)]
    table = pa.table({"treeID": pa.array([i for i, _ in rows], pa.int32()), "nodeData": pa.array([n for _, n in rows], NODE)})
    path = os.path.join(ensure_checkpoint_dir(spark), "ragscope-fitted", uuid.uuid4().hex)
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/data")
    spark.createDataFrame([(i, json.dumps(part | {"uid": f"{'dtc' if classes else 'dtr'}_{uuid.uuid4().hex[:12]}"}), float(w)) for i, (_, w) in enumerate(trees)],
                          "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return model_class.load(path)


def _subset(text: str, n: int, one: int) -> int:
    """How many of ``n`` features a node may split on (Spark ML's ``featureSubsetStrategy``); ``one``: what "auto" stands for."""
    named = {"auto": one, "all": n, "sqrt": int(np.ceil(np.sqrt(n))), "log2": max(1, int(np.ceil(np.log2(n)))), "onethird": int(np.ceil(n / 3))}
    if text in named:
        return named[text]
    return min(n, int(text)) if text.isdigit() else int(np.ceil(float(text) * n))


def _learn(est, rows, fit, model_class, loss: str | None, classify: bool):
    """Fit on a ``Binned`` table, or on a DataFrame that is binned for this learner alone."""
    weight = est.getOrDefault("weightCol") if est.isDefined("weightCol") and est.getOrDefault("weightCol") else None
    if isinstance(rows, Binned):
        return _fitted(est, rows, fit, model_class, loss, classify, weight)
    binned = bin_rows(rows, est.getFeaturesCol(), est.getLabelCol(), weight, est.getMaxBins())
    try:
        return _fitted(est, binned, fit, model_class, loss, classify, weight)
    finally:
        binned.unpersist()


def _fitted(est, rows: Binned, fit, model_class, loss: str | None, classify: bool, weight: str | None):
    layout, n = rows.layout, rows.n_features
    for name, plain in (("minInstancesPerNode", 1), ("minInfoGain", 0.0), ("minWeightFractionPerNode", 0.0)):
        if est.getOrDefault(name) != plain:
            raise ValueError(f"{name} is not supported")
    classes = 0
    if classify:
        seen = rows.rdd.map(lambda b: np.unique(b["y"]).tolist()).fold([], lambda a, b: sorted({*a, *b}))
        if any(y < 0 or y != int(y) for y in seen) or (loss and max(seen) > 1):
            raise ValueError(f"labels of classes must be 0, 1, …{' (two classes)' if loss else ''}: {seen[:5]}")
        classes = 0 if loss else max(2, int(max(seen)) + 1)
    count = _subset(est.getFeatureSubsetStrategy(), n, n if loss else int(np.ceil(np.sqrt(n))) if classify else int(np.ceil(n / 3)))
    spec = {"loss": loss, "depth": est.getMaxDepth(), "seed": est.getSeed() & 0x7FFFFFFF, "weighted": bool(weight), "classes": classes,
            "rounds": est.getMaxIter() if loss else est.getNumTrees(), "rate": est.getSubsamplingRate() if loss else 1.0,
            "share": count / n if loss else count, "step": est.getStepSize() if loss else 1.0}
    size = rows.rows * (2 * len(layout.cells) + 32 + (0 if loss else 2 * spec["rounds"]))
    if size <= HERE:
        (trees,) = rows.rdd.coalesce(1).mapPartitions(lambda blocks: [fit(Here(blocks), layout, spec)]).collect()
    else:
        ensure_checkpoint_dir(rows.spark)
        run = Spread(rows.rdd)
        trees = fit(run, layout, spec)
        run.close()
    return spark_model(rows.spark, est, model_class, trees, layout, classes)


class GBTClassifier(MC.GBTClassifier):
    def _fit(self, dataset):
        return _learn(self, dataset, boost, MC.GBTClassificationModel, "logistic", True)


class RandomForestClassifier(MC.RandomForestClassifier):
    def _fit(self, dataset):
        return _learn(self, dataset, forest, MC.RandomForestClassificationModel, None, True)


class GBTRegressor(MR.GBTRegressor):
    def _fit(self, dataset):
        return _learn(self, dataset, boost, MR.GBTRegressionModel, "squared", False)


class RandomForestRegressor(MR.RandomForestRegressor):
    def _fit(self, dataset):
        return _learn(self, dataset, forest, MR.RandomForestRegressionModel, None, False)
