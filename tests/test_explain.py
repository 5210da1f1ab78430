"""TreeSHAP against exact Shapley values (subset enumeration) and Spark's raw scores."""
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ragscope.operators import explain as XP


def _goes_left(tree, node, x):
    v = x[tree["feat"][node]]
    return v in tree["cats"][node] if node in tree["cats"] else v <= tree["thr"][node]


def _cond_expect(tree, x, S, node=0):
    """E[f(x) | x_S] with the tree's training coverage for features outside S (path-dependent)."""
    if tree["left"][node] < 0:
        return tree["val"][node]
    f = tree["feat"][node]
    l, r = tree["left"][node], tree["right"][node]
    if f in S:
        return _cond_expect(tree, x, S, l if _goes_left(tree, node, x) else r)
    c = tree["cover"]
    return (c[l] * _cond_expect(tree, x, S, l) + c[r] * _cond_expect(tree, x, S, r)) / c[node]


def _exact_shap(tree, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for size in range(len(others) + 1):
            for S in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                phi[i] += w * (_cond_expect(tree, x, set(S) | {i}) - _cond_expect(tree, x, set(S)))
    return phi


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.RandomState(0)
    X = rng.normal(size=(300, 4))
    y = ((X[:, 0] + 0.5 * X[:, 1] * X[:, 2]) > 0).astype(float)
    df = spark.createDataFrame([(i, float(y[i]), Vectors.dense(X[i])) for i in range(300)], ["id", "label", "features"])
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(df)
    return df, model, X


def test_tree_shap_equals_exact_shapley(spark, fitted):
    df, model, X = fitted
    ens = XP.export_trees(model, spark, "test_gbt")
    phi, raw = XP.batch_shap(ens, X[:8])
    for i, row in enumerate(X[:8]):
        want = sum(w * _exact_shap(t, row, 4) for t, w in zip(ens["trees"], ens["weights"]))
        assert np.allclose(phi[i], want, atol=1e-10)
        assert raw[i] == pytest.approx(sum(w * _cond_expect(t, row, {0, 1, 2, 3}) for t, w in zip(ens["trees"], ens["weights"])))


def test_categorical_splits_and_single_leaves():
    """A split on categories, a feature that comes twice on a path, and a tree of one leaf."""
    tree = {"left": np.array([1, 3, -1, -1, 5, -1, -1]), "right": np.array([2, 4, -1, -1, 6, -1, -1]), "feat": np.array([0, 1, -1, -1, 1, -1, -1]),
            "thr": np.array([0, 2.0, 0, 0, 5.0, 0, 0]), "val": np.array([0, 0, 3.0, -1.0, 0, 2.0, 7.0]),
            "cover": np.array([20.0, 12, 8, 5, 7, 3, 4]), "cats": {0: {1.0, 4.0}}}
    leaf = {"left": np.array([-1]), "right": np.array([-1]), "feat": np.array([-1]), "thr": np.zeros(1), "val": np.array([0.5]), "cover": np.array([20.0]), "cats": {}}
    x = np.array([[1.0, 1.0], [1.0, 3.0], [4.0, 9.0], [2.0, 3.0]])
    phi, raw = XP.batch_shap({"trees": [tree, leaf], "weights": [2.0, 1.0]}, x)
    for i, row in enumerate(x):
        assert np.allclose(phi[i], 2 * _exact_shap(tree, row, 2), atol=1e-12)
        assert raw[i] == pytest.approx(2 * _cond_expect(tree, row, {0, 1}) + 0.5)


def test_top_features_leave_the_task(spark, fitted):
    df, model, X = fitted
    ens = XP.export_trees(model, spark, "test_gbt")
    names = ["d", "a", "c", "b"]
    whole = XP.tree_shap_long(df, "id", "features", ens, names).collect()
    want = {}
    for r in sorted(whole, key=lambda r: (r["id"], -abs(r["impact"]), r["feature"])):
        want.setdefault(r["id"], []).append(r["feature"])
    top = XP.tree_shap_long(df, "id", "features", ens, names, top=2).collect()
    assert {(r["id"], r["rank"]): r["feature"] for r in top} == {(i, k + 1): fs[k] for i, fs in want.items() for k in range(2)}


def test_additivity_against_spark_raw_score(spark, fitted):
    df, model, X = fitted
    ens = XP.export_trees(model, spark, "test_gbt")
    long = XP.tree_shap_long(df, "id", "features", ens, ["a", "b", "c", "d"])
    sums = long.groupBy("id").agg((F.sum("impact") + F.first("base")).alias("s"))
    raw = model.transform(df).select("id", vector_to_array("rawPrediction")[1].alias("margin"))
    bad = sums.join(raw, "id").where(F.abs(F.col("s") - F.col("margin")) > 1e-9).count()
    assert bad == 0
