"""Prediction explanations.

M16 — path-dependent TreeSHAP (Lundberg, Erion & Lee, 2018) for Spark tree
ensembles.  The fitted trees are read back from the model's own saved data
(``model.write()`` → ``data`` Parquet: node id, prediction, impurity statistics,
children, split), i.e. a table whose size is bounded by the model, not by the
data.  The work runs on executors in ``mapInPandas``, a whole batch of rows per
leaf path in NumPy; the paths travel inside the task closure.  Every batch checks additivity:
Σ impacts + base value = the ensemble's raw score.

M17 — linear explainer: impact_j = coef_j · (x_j − mean_j) as column expressions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import save_model


# ───────────────────────────── tree export ─────────────────────────────
def export_trees(model, spark: SparkSession, name: str) -> dict:
    """Tree arrays of a fitted ensemble: per tree (left, right, feature, threshold, value, cover) and weights.

    GBT: leaf value = node prediction, weights = treeWeights (raw score = Σ w·leaf).
    Random forest classifier: leaf value = class-1 share of the leaf, weights = 1/#trees (probability)."""
    path = save_model(model, spark, f"{name}-{uuid.uuid4().hex}")   # runs side by side do not overwrite each other
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
        "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("feat"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr"),
        F.col("nodeData.split.numCategories").alias("ncat")).toPandas()
    cls = type(model).__name__
    is_rf_classifier = cls.startswith("RandomForestClassification")
    n_trees = int(nodes["treeID"].max()) + 1
    weights = (list(model.treeWeights) if hasattr(model, "treeWeights") and not is_rf_classifier
               else [1.0 / n_trees] * n_trees)
    if cls.startswith("RandomForestRegression"):
        weights = [1.0 / n_trees] * n_trees
    trees = []
    for t in range(n_trees):
        nd = nodes[nodes["treeID"] == t].sort_values("id")
        n = int(nd["id"].max()) + 1
        left = np.full(n, -1, dtype=np.int64)
        right = np.full(n, -1, dtype=np.int64)
        feat = np.full(n, -1, dtype=np.int64)
        thr = np.zeros(n)
        val = np.zeros(n)
        cover = np.zeros(n)
        cats: dict[int, set] = {}
        for r in nd.itertuples(index=False):
            i = int(r.id)
            stats = np.asarray(r.impurityStats, dtype=float)
            left[i], right[i] = int(r.leftChild), int(r.rightChild)
            if left[i] >= 0:
                feat[i] = int(r.feat)
                if r.ncat is not None and int(r.ncat) > 0:
                    cats[i] = set(float(c) for c in r.thr)
                else:
                    thr[i] = float(r.thr[0])
            if is_rf_classifier:
                cover[i] = float(stats.sum())
                val[i] = float(stats[1] / stats.sum()) if stats.sum() > 0 and stats.size > 1 else 0.0
            else:
                cover[i] = float(stats[0])
                val[i] = float(r.prediction)
        trees.append({"left": left, "right": right, "feat": feat, "thr": thr, "val": val, "cover": cover,
                      "cats": cats})
    return {"trees": trees, "weights": weights}


# ───────────────────────────── TreeSHAP ─────────────────────────────
def _expected(tree: dict) -> float:
    leaves = tree["left"] < 0
    return float((tree["val"][leaves] * tree["cover"][leaves]).sum() / tree["cover"][0])


def leaf_paths(tree: dict) -> list[tuple[float, dict[int, tuple[float, list[tuple[int, bool]]]]]]:
    """Per leaf: its value, and for each feature on its path the share of training rows that the feature's splits send
    down the path and the (node, goes left) decisions that a row has to meet."""
    out, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        if tree["left"][node] < 0:
            out.append((float(tree["val"][node]), path))
            continue
        feature = int(tree["feat"][node])
        share, met = path.get(feature, (1.0, []))
        for child, goes_left in ((tree["left"][node], True), (tree["right"][node], False)):
            stack.append((child, path | {feature: (share * tree["cover"][child] / tree["cover"][node], [*met, (node, goes_left)])}))
    return out


def _decisions(tree: dict, x: np.ndarray) -> dict[int, np.ndarray]:
    """For each split, which rows go left."""
    return {int(n): (np.isin(x[:, tree["feat"][n]], list(tree["cats"][n])) if n in tree["cats"] else x[:, tree["feat"][n]] <= tree["thr"][n])
            for n in np.flatnonzero(tree["left"] >= 0)}


def batch_shap(ensemble: dict, x: np.ndarray, paths: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """SHAP values (rows × features) and raw scores of a block of rows.

    A leaf's game gives a set S of the m features on its path the value v · Π(S) o · Π(rest) z, with o = 1 if the row meets the
    feature's splits and z the training share. The Shapley weight s! (m - s - 1)! / m! is the integral of
    t^s (1 - t)^(m - s - 1) over [0, 1], so feature i gets v · (o_i - z_i) · ∫ Π(j ≠ i) (z_j (1 - t) + o_j t) dt: a polynomial
    of degree m - 1, which Gauss-Legendre points integrate exactly. All rows go through a path together."""
    phi, raw = np.zeros(x.shape), np.zeros(len(x))
    for k, (tree, weight) in enumerate(zip(ensemble["trees"], ensemble["weights"])):
        left = _decisions(tree, x)
        for value, path in paths[k] if paths else leaf_paths(tree):
            if not path:
                raw += weight * value
                continue
            m = len(path)
            points, mass = np.polynomial.legendre.leggauss((m + 1) // 2)
            t, mass = (points[:, None] + 1) / 2, mass[:, None] / 2
            z = [share for share, _ in path.values()]
            o = [np.logical_and.reduce([left[n] == goes_left for n, goes_left in met]).astype(float) for _, met in path.values()]
            factors = [zj * (1 - t) + oj[None, :] * t for zj, oj in zip(z, o)]
            after = [np.ones_like(factors[0])]
            for f in reversed(factors[1:]):
                after.append(after[-1] * f)
            before = mass * np.ones_like(factors[0])
            for i, feature in enumerate(path):
                phi[:, feature] += weight * value * (o[i] - z[i]) * (before * after[m - 1 - i]).sum(0)
                before = before * factors[i]
            raw += weight * value * np.logical_and.reduce([oj > 0 for oj in o])
    return phi, raw


def tree_shap_long(df: DataFrame, key: str, features_col: str, ensemble: dict, feature_names: Sequence[str],
                   digits: int = 4, tol: float = 1e-6, top: int | None = None) -> DataFrame:
    """One row per (key, feature): value, impact; plus ``base`` (expected value) and ``raw`` (score).

    Impacts are in the ensemble's raw-score space (GBT margin, forest probability). With ``top``, only the features
    of the largest |impact| of each row leave the task, with their ``rank`` (W5; ties by name)."""
    names = np.array(feature_names)
    by_name = np.argsort(names)
    paths = [leaf_paths(t) for t in ensemble["trees"]]
    base = float(sum(w * _expected(t) for t, w in zip(ensemble["trees"], ensemble["weights"])))
    key_type = df.schema[key].dataType.simpleString()
    src = df.select(F.col(key).alias("_k"), vector_to_array(F.col(features_col)).alias("_x"))
    # per-row work is CPU-bound: a shuffle of the narrow rows lets every core work, however few files there are
    src = src.repartition("_k")

    def explain(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(list(pdf["_x"])).astype(float)
            phi, raw = batch_shap(ensemble, x, paths)
            off = np.abs(phi.sum(1) + base - raw) > tol * np.maximum(1.0, np.abs(raw))
            if off.any():
                raise AssertionError(f"TreeSHAP additivity failed for {pdf['_k'][off].tolist()[:5]}")
            n = len(names) if top is None else min(top, len(names))
            at = by_name[np.argsort(-np.abs(phi[:, by_name]), axis=1, kind="stable")[:, :n]]
            rows = np.arange(len(x))[:, None]
            yield pd.DataFrame({key: np.repeat(pdf["_k"].to_numpy(), n), "feature": names[at].ravel(), "value": np.round(x[rows, at], digits).ravel(),
                                "impact": phi[rows, at].ravel(), "raw": np.repeat(raw, n), "rank": np.tile(np.arange(1, n + 1), len(x))})

    schema = f"{key} {key_type}, feature string, value double, impact double, raw double, rank int"
    out = src.mapInPandas(explain, schema).withColumn("base", F.lit(base))
    return out if top else out.drop("rank")


def linear_explain(df: DataFrame, key: str, coefficients: dict[str, float], digits: int | None = None) -> DataFrame:
    """impact_j = coef_j · (x_j − mean_j), means over ``df`` (one-row aggregate), long form."""
    feats = list(coefficients)
    means = df.agg(*[F.avg(F.col(f"`{f}`").cast("double")).alias(f"_m{i}") for i, f in enumerate(feats)])
    j = df.crossJoin(F.broadcast(means))
    items = [F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value"),
                      (F.lit(float(coefficients[f])) * (F.col(f"`{f}`").cast("double") - F.col(f"_m{i}")))
                      .alias("impact")) for i, f in enumerate(feats)]
    out = j.select(F.col(key), F.explode(F.array(*items)).alias("s")).select(key, "s.*")
    if digits is not None:
        out = out.withColumn("impact", F.round("impact", digits))
    return out


def mean_abs_impact(long: DataFrame, top: int | None = 20) -> DataFrame:
    """Global importance = mean |impact| per feature (top ``top``; ties by name)."""
    g = long.groupBy("feature").agg(F.avg(F.abs("impact")).alias("mean_abs_impact"))
    g = g.orderBy(F.col("mean_abs_impact").desc(), F.col("feature").asc())
    return g.limit(top) if top else g
