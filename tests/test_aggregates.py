"""Profiles against numpy/pandas on fixtures with a hot group and continuous values."""
import numpy as np
import pytest

from ragscope.operators import aggregates as A


def test_box_stats_matches_numpy(spark):
    rng = np.random.RandomState(5)
    g = np.array(["hot"] * 700 + ["a"] * 200 + ["b"] * 3)
    v = np.round(rng.lognormal(6, 0.6, len(g)), 3)
    v[:50] = v[0]                                   # heavy ties
    df = spark.createDataFrame(list(zip(g.tolist(), v.tolist())), "g string, v double")
    got = {r.g: r for r in A.box_stats(df, "g", "v", digits=8).collect()}
    for k in ["hot", "a", "b"]:
        x = v[g == k]
        q1, med, q3 = np.percentile(x, [25, 50, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = x[(x >= lo) & (x <= hi)]
        r = got[k]
        assert r.n == len(x)
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, med, q3), abs=1e-7)
        assert (r.whisker_lo, r.whisker_hi) == pytest.approx((inside.min(), inside.max()), abs=1e-7)
        assert r.n_outliers == len(x) - len(inside)


def test_corr_matrix_pairwise_complete(spark):
    import pandas as pd
    rng = np.random.RandomState(2)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)) * [1, 100, 1e4, 0.01] + [0, 5e3, 1e6, 0.9], columns=list("abcd"))
    pdf.loc[rng.rand(300) < 0.2, "b"] = np.nan
    pdf.loc[rng.rand(300) < 0.1, "d"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double")
    got = {(r.col_a, r.col_b): r.corr for r in A.corr_matrix(df, list("abcd"), digits=12).collect()}
    want = pdf.corr()
    for (a, b), c in got.items():
        assert c == pytest.approx(want.loc[a, b], abs=1e-9)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 10]], "v double")
    h = {r.bin: r["count"] for r in A.histogram(df, "v", bins=5).collect()}
    assert h == {1: 2, 2: 2, 3: 1, 5: 1}          # top edge 10 folded into the last bin


def test_corr_matrix_many_patterns_and_columns(spark):
    """Random nulls give nearly a pattern a row; 66 columns do not fit one number."""
    import pandas as pd
    rng = np.random.RandomState(9)
    x = rng.normal(size=(200, 66)).round(3)
    x[rng.uniform(size=x.shape) < 0.5] = np.nan
    cols = [f"c{i}" for i in range(66)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in cols))
    want = pd.DataFrame(x, columns=cols).corr()
    got = A.corr_matrix(df, cols, digits=10).collect()
    assert len(got) == 66 * 65 // 2
    assert all(r.corr == pytest.approx(want.loc[r.col_a, r.col_b], abs=1e-9) for r in got)
