"""Metric operators against brute-force Python on small fixtures with ties."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ragscope.operators import metrics as M


def _auc_bruteforce(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.RandomState(7)
    s = np.round(rng.uniform(0, 1, 400), 2)            # many ties
    y = (rng.uniform(0, 1, 400) < s).astype(int)
    return spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y int, s double"), y, s


def test_auc_matches_pairwise(scored):
    df, y, s = scored
    got = M.roc_auc(df, "y", "s").first().auc
    assert got == pytest.approx(_auc_bruteforce(y, s), abs=1e-12)


def test_prefix_sums_exact(spark):
    rng = np.random.RandomState(1)
    vals = rng.permutation(500).astype(float)
    w = rng.randint(0, 5, 500)
    df = spark.createDataFrame(list(zip(vals.tolist(), w.tolist())), "o double, w long")
    got = {r.o: r.cum_w for r in M.prefix_sums(df, "o", ["w"]).collect()}
    order = np.argsort(vals)
    cum = np.cumsum(w[order])
    assert all(got[vals[i]] == c for i, c in zip(order, cum))
    got_d = {r.o: r.cum_w for r in M.prefix_sums(df, "o", ["w"], descending=True).collect()}
    order_d = order[::-1]
    cum_d = np.cumsum(w[order_d])
    assert all(got_d[vals[i]] == c for i, c in zip(order_d, cum_d))


def test_average_precision_and_threshold(scored):
    df, y, s = scored
    # brute force over descending distinct thresholds
    th = sorted(set(s), reverse=True)
    P = y.sum()
    ap, prev_r = 0.0, 0.0
    best = (-1.0, None)
    pts = []
    for t in th:
        tp = ((s >= t) & (y == 1)).sum()
        fp = ((s >= t) & (y == 0)).sum()
        prec, rec = tp / (tp + fp), tp / P
        ap += (rec - prev_r) * prec
        prev_r = rec
        pts.append((t, prec, rec))
    got = M.average_precision(df, "y", "s").first().average_precision
    assert got == pytest.approx(ap, abs=1e-12)
    f1 = [(2 * p * r / (p + r + 1e-8), t) for t, p, r in pts]
    top = max(v for v, _ in f1)
    want = min(t for v, t in f1 if v == top)
    assert M.best_threshold(df, "y", "s").first().threshold == want


def test_class_report_zero_division(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "y string, p string")
    rep = {r.label: r for r in M.class_report(df, "y", "p").collect()}
    assert rep["b"].precision == 0.0 and rep["b"].support == 0
    assert rep["c"].recall == 0.0
    assert rep["accuracy"].precision == pytest.approx(round(1 / 3, 4))


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    e = np.array([-0.5, 0.0, 1.0])
    assert r.rmse == pytest.approx(np.sqrt((e ** 2).mean()))
    assert r.mae == pytest.approx(np.abs(e).mean())
    assert r.r2 == pytest.approx(1 - (e ** 2).sum() / ((np.array([1, 2, 3]) - 2) ** 2).sum())


def test_prefix_sums_of_skewed_and_null_groups(spark):
    """A group with most of the rows spans partitions, many small groups share them, and a null group counts."""
    rows = [("hot", i, i % 7) for i in range(5000)] + [(f"g{j}", i, 1) for j in range(40) for i in range(j % 4 + 1)] + [(None, i, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, o long, w long").repartition(5)
    got = {(r.g, r.o): r.cum_w for r in M.prefix_sums(df, "o", ["w"], group_cols=["g"]).collect()}
    run = {}
    assert len(got) == len(rows)
    for g, o, w in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        run[g] = run.get(g, 0) + w
        assert got[g, o] == run[g]
    before = {(r.g, r.o): r.cum_w for r in M.prefix_sums(df, "o", ["w"], descending=True, inclusive=False, group_cols=["g"]).collect()}
    assert all(before[g, o] == run[g] - got[g, o] for g, o in got)


def test_ranking_metrics_of_one_class_and_null_scores(spark):
    rows = [("both", 1, 0.9), ("both", 0, 0.9), ("both", 0, 0.1), ("both", None, 0.5), ("both", 1, None), ("ones", 1, 0.3), ("ones", 1, 0.4), ("zeros", 0, 0.2)]
    df = spark.createDataFrame(rows, "m string, y int, s double")
    auc = {r.m: r.auc for r in M.roc_auc(df, "y", "s", group_cols=["m"]).collect()}
    assert auc == {"both": 0.75, "ones": None, "zeros": None}
    ap = {r.m: r.average_precision for r in M.average_precision(df, "y", "s", group_cols=["m"]).collect()}
    assert ap["both"] == pytest.approx(0.5) and ap["ones"] == 1.0 and not ap["zeros"]
