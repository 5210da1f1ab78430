"""Feature engineering on rows made by arithmetic."""
from pyspark.sql import functions as F

from ragscope.operators import features as FE
from ragscope.schema import INTERACTION_FEATURES


def test_engineer_returns_frame_and_list(runs_sample):
    df, names = FE.engineer_features(runs_sample)
    assert hasattr(df, "columns") and isinstance(names, list)


def test_feature_count(runs_sample):
    _, names = FE.engineer_features(runs_sample)
    assert len(names) > 30


def test_one_hot_not_label_codes(runs_sample):
    df, names = FE.engineer_features(runs_sample)
    assert "domain_billing" in names and "domain_health" in names
    vals = {r[0] for r in df.select("domain_billing").distinct().collect()}
    assert vals <= {0, 1}
    # exactly one domain dummy is set per row
    s = df.select((F.col("domain_billing") + F.col("domain_health") + F.col("domain_travel")).alias("s"))
    assert {r.s for r in s.distinct().collect()} == {1}


def test_ordinal_range(runs_sample):
    df, _ = FE.engineer_features(runs_sample)
    r = df.agg(F.min("difficulty_ord"), F.max("difficulty_ord")).first()
    assert r[0] >= 0 and r[1] <= 2


def test_interaction_names(runs_sample):
    _, names = FE.engineer_features(runs_sample)
    for c in INTERACTION_FEATURES:
        assert c in names


def test_text_features_positive(runs_sample):
    df, names = FE.engineer_features(runs_sample)
    assert "query_len" in names and "query_word_count" in names
    assert df.where("query_len <= 0 OR query_word_count <= 0").count() == 0


def test_split_sizes_and_width(runs_sample):
    df, names = FE.engineer_features(runs_sample)
    sp = FE.split_data(df, names)
    assert (sp["train"].count(), sp["val"].count(), sp["test"].count()) == (60, 20, 20)
    assert len(sp["X_train"].columns) == len(names)


def test_no_nulls_in_matrix(spark, runs_sample):
    with_nulls = runs_sample.withColumn("top1_score", F.when(F.col("run_id") % 7 == 0, None)
                                        .otherwise(F.col("top1_score")))
    df, names = FE.engineer_features(with_nulls)
    X = FE.split_data(df, names)["X_train"]
    assert X.where(" OR ".join(f"`{c}` IS NULL" for c in X.columns)).count() == 0


def test_label_encode_alphabetical(spark):
    df = spark.createDataFrame([("medium",), ("easy",), ("hard",), (None,)], "difficulty string")
    out = {r.difficulty: r.difficulty_enc for r in FE.label_encode(df, ["difficulty"]).collect()}
    assert out == {"easy": 0, "hard": 1, "medium": 2, None: 3}   # 'nan' sorts after 'medium'


def test_zscore_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    z = sorted(r.x_z for r in FE.zscore(df, ["x"]).collect())
    import numpy as np
    a = np.array([1.0, 2.0, 3.0, 0.0])
    ref = sorted((a - a.mean()) / a.std())
    assert np.allclose(z, ref)


def test_rebalanced_training(runs_sample):
    """SMOTE(-ENN) before fitting: training runs end to end and the rebalanced set is class-balanced."""
    from ragscope.operators import models as ML
    df, names = FE.engineer_features(runs_sample)
    sp = FE.split_data(df, names)
    tr = ML.assemble(sp["train"], names, ["is_correct"])
    bal = ML.rebalance_vectors(tr, "is_correct", "smote")
    counts = {r.is_correct: r["count"] for r in bal.groupBy("is_correct").count().collect()}
    assert len(set(counts.values())) == 1
    res, fitted = ML.train_binary(sp["train"], sp["val"], sp["test"], names, "is_correct", "Correctness",
                                  n_iter=3, rebalance="smoteenn")
    assert res.count() == 3 and set(fitted) == {"GBT", "GBT_weighted", "RandomForest"}


def test_frequent_terms_leave_out_no_bigram(spark):
    """Bigrams are counted only between words that reach the vocabulary's lowest word frequency: same terms as counting all, ties included."""
    from collections import Counter

    from ragscope.operators import text as TX
    texts = ["red red green", "red red blue lime", "green blue green blue", None, "", "teal", "red red teal aqua lime", "aqua lime aqua lime"]
    df = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    all_terms = Counter()
    for t in texts:
        w = (t or "").split()
        all_terms.update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    for n in (1, 3, 5, 9, 500):
        want = sorted(all_terms.items(), key=lambda x: (-x[1], x[0]))[:n]
        assert sorted((r["term"], r["freq"]) for r in TX.frequent_terms(df, "text", n).collect()) == sorted(want)
