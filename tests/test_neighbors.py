"""Exact k-NN, SMOTE and ENN against brute force on small fixtures (tiny blocks force pass 2)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ragscope.operators import neighbors as NB


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.RandomState(3)
    n = 120
    X = np.round(rng.normal(size=(n, 4)), 3)
    X[5] = X[6]                       # exact duplicate → distance tie
    y = (X[:, 0] > 0).astype(int)
    rows = [(i, int(y[i]), X[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, v array<double>"), X, y


def _brute(X, ids, k):
    out = {}
    for a in ids:
        d = [(round(float(np.sqrt(((X[a] - X[b]) ** 2).sum())), 9), b) for b in ids if b != a]
        out[a] = [b for _, b in sorted(d)[:k]]
    return out


@pytest.mark.parametrize("block", [8, 1000])
def test_knn_exact(points, block):
    df, X, y = points
    got = NB.knn(df, "id", "v", 4, leaf_size=block).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.id, r["rank"])):
        res.setdefault(r.id, []).append(r.nn_id)
    assert res == _brute(X, list(range(len(X))), 4)


def test_knn_repeated_points(spark):
    """A block of equal points is split, and ties still resolve by id; an empty table has no neighbours."""
    X = np.array([[1.0, 2.0]] * 70 + [[float(i), 0.0] for i in range(20)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    res = {}
    for r in sorted(NB.knn(df, "id", "v", 3, leaf_size=8).collect(), key=lambda r: (r.id, r["rank"])):
        res.setdefault(r.id, []).append(r.nn_id)
    assert res == _brute(X, list(range(len(X))), 3)
    assert NB.knn(df.where("id < 0"), "id", "v", 3).collect() == []


def test_knn_within_group(points):
    df, X, y = points
    got = NB.knn(df, "id", "v", 3, group_cols=["label"], leaf_size=8).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.id, r["rank"])):
        res.setdefault(r.id, []).append(r.nn_id)
    want = {}
    for c in (0, 1):
        want.update(_brute(X, [i for i in range(len(X)) if y[i] == c], 3))
    assert res == want


def test_smote_counts_and_segments(points):
    df, X, y = points
    out = NB.smote(df, "id", "label", "v").collect()
    counts = {}
    for r in out:
        counts[r.label] = counts.get(r.label, 0) + 1
    assert len(set(counts.values())) == 1                       # every class at the majority count
    syn = [r for r in out if r.is_synthetic == 1]
    assert len(syn) == abs(int((y == 0).sum()) - int((y == 1).sum()))
    # each synthetic point lies on a segment between two rows of its class
    Xc = {c: X[y == c] for c in (0, 1)}
    for r in syn:
        v = np.array(r.v)
        P = Xc[r.label]
        ok = False
        for a in P:
            for b in P:
                d = b - a
                t = np.dot(v - a, d) / max(np.dot(d, d), 1e-12)
                if -1e-9 <= t <= 1 + 1e-9 and np.allclose(a + t * d, v, atol=1e-9):
                    ok = True
                    break
            if ok:
                break
        assert ok


def test_enn_rule(points):
    df, X, y = points
    kept = {r.id for r in NB.enn(df, "id", "label", "v", 3).collect()}
    nn = _brute(X, list(range(len(X))), 3)
    want = {a for a, bs in nn.items() if all(y[b] == y[a] for b in bs)}
    assert kept == want


def test_weights(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (0,)], "y int")
    w = {r.y: r.weight for r in NB.balanced_weights(df, "y").collect()}
    assert w == {1: 4 / (2 * 3), 0: 4 / (2 * 1)}
    p = {r.y: r.weight for r in NB.positive_weight(df, "y").collect()}
    assert p == {1: 1 / 3, 0: 1.0}


def test_knn_prunes_clustered_points(spark):
    """600 points in 30 clusters of 64 dimensions: a point visits few of the leaves, and the result is exact."""
    rng = np.random.RandomState(8)
    centres = rng.normal(size=(30, 64)) * 10
    X = np.round(centres[np.arange(600) % 30] + rng.normal(size=(600, 64)) * 0.3, 4)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    visits = []
    got = NB.knn(df, "id", "v", 3, leaf_size=25, fanout=12, visits_out=visits).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r.id, r["rank"])):
        res.setdefault(r.id, []).append(r.nn_id)
    assert res == _brute(X, list(range(len(X))), 3)
    leaves = visits[0].select("leaf", "part").distinct().count()
    assert leaves > 20 and visits[0].count() < 0.1 * 600 * leaves


def test_knn_null_group_and_missing_vectors(spark):
    rows = [(i, None if i % 3 == 0 else "a", [float(i * i % 17), float(i)]) for i in range(40)] + [(99, "a", None), (100, "alone", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, label string, v array<double>")
    got = NB.knn(df, "id", "v", 2, group_cols=["label"], leaf_size=6).collect()
    X = np.array([r[2] for r in rows[:40]])
    for keep, label in ((lambda i: i % 3 == 0, None), (lambda i: i % 3 != 0, "a")):
        ids = [i for i in range(40) if keep(i)]
        res = {}
        for r in sorted((r for r in got if r.label == label), key=lambda r: (r.id, r["rank"])):
            res.setdefault(r.id, []).append(r.nn_id)
        assert res == _brute(X, ids, 2)
    assert {r.label for r in got} == {None, "a"}


def test_knn_writes_in_proportion_to_its_input(spark):
    """Points without structure, where every point meets every leaf: what the search writes follows the points, not points times leaves."""
    import os

    from ragscope.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark)

    def written():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)

    X = np.random.RandomState(5).normal(size=(1200, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    before = written()
    got = NB.knn(df, "id", "v", 3, leaf_size=24).collect()
    assert written() - before < 30 * X.nbytes
    res = {}
    for r in sorted(got, key=lambda r: (r.id, r["rank"])):
        res.setdefault(r.id, []).append(r.nn_id)
    assert res == _brute(X, list(range(len(X))), 3)
