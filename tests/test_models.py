"""K-means starts against brute force, cluster assignment, and vectors of exact term weights."""
import threading

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ragscope.operators import models as ML
from ragscope.operators import text as TX


def test_kmeans_takes_the_best_start(spark):
    """Seven clear groups: the best of ten starts finds them, and its inertia is what the assignment gives."""
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [0, 9], [9, 0], [9, 9], [20, 4], [-12, 3], [4, 30]], float)
    x = np.concatenate([c + rng.normal(size=(40, 2)) * 0.5 for c in centres])
    df = spark.createDataFrame([(Vectors.dense(v),) for v in x], ["f"]).repartition(3)
    found = ML.kmeans_starts(df, "f", [2, 7])
    got, cost = found[7]
    want = sum(((x[i * 40:(i + 1) * 40] - x[i * 40:(i + 1) * 40].mean(0)) ** 2).sum() for i in range(7))
    assert cost == pytest.approx(want, rel=1e-6)
    assert sorted(np.round(got, 6).tolist()) == sorted(np.round([x[i * 40:(i + 1) * 40].mean(0) for i in range(7)], 6).tolist())
    assert found[2][1] > cost
    near = [r["cluster"] for r in ML.assign_clusters(df, "f", got).collect()]
    assert np.bincount(near).tolist() == [40] * 7
    assert ML.kmeans_starts(df.where("false"), "f", [2]) == {}


def test_vectors_equal_term_weights(spark):
    docs = spark.createDataFrame([(1, "red green red", "a"), (2, "green blue and blue", "b"), (3, "red and blue", "a"), (4, "", "b"), (5, "green green", "b")],
                                 "doc_id long, text string, lang string")
    weights = TX.tfidf(docs, "doc_id", "text", 50)
    vectors, terms = ML.term_vectors(weights, "doc_id")
    long = {(r["doc_id"], r["term"]): r["tfidf"] for r in weights.collect()}
    got = {(r["doc_id"], terms[i]): v for r in vectors.collect() for i, v in zip(r["features"].indices, r["features"].values)}
    assert got == long and terms == sorted(terms)
    res, fitted = ML.train_text_classifier(vectors.join(docs, "doc_id"), "lang", F.col("doc_id") < 5, max_iter=20)
    assert {r["model"] for r in res.collect()} == {"LogReg", "LinearSVM"} and fitted["LogReg"][1] == ["a", "b"]


def test_training_rows_are_in_few_partitions(spark):
    """The tasks of a learner's stages follow the cores, not the files; small tables keep their partitions."""
    cores = spark.sparkContext.defaultParallelism
    many = ML.training_rows(spark.range(5000).repartition(40 * cores), 2)
    assert many.rdd.getNumPartitions() == 2 * cores and many.count() == 5000
    assert ML.training_rows(spark.range(10).repartition(2)).rdd.getNumPartitions() == 2


def test_isotonic_learner_gets_a_row_per_score(spark, monkeypatch):
    """Equal scores are one weighted point; the curve is that of the rows, rows without a label left out."""
    rows = [(float(y), s / 4) for s, ys in enumerate(([0, 0, 1], [1, 0], [0, 0, 0, 1], [1, 1], [1])) for y in ys] + [(None, 0.3)]
    df = spark.createDataFrame(rows, "y double, p1 double")
    seen, learner = [], ML.IsotonicRegression

    class Watched:
        def __init__(self, **kw):
            self.inner = learner(**kw)

        def fit(self, points):
            seen.append(points.count())
            return self.inner.fit(points)

    monkeypatch.setattr(ML, "IsotonicRegression", Watched)
    got = {r["p1"]: r["p_cal"] for r in ML.isotonic_calibrator(df, "y").transform(df.select("p1").distinct()).collect() if r["p1"] != 0.3}
    assert seen == [5]
    assert got == pytest.approx({0.0: 1 / 3, 0.25: 1 / 3, 0.5: 1 / 3, 0.75: 1.0, 1.0: 1.0})


def _learning_rows(spark):
    rows = [(s, i, float(i % 13), float((i * 7) % 11), int((i * 7) % 11 + i % 13 > 11), f"word{i % 5} and more", "ab"[i % 2])
            for i, s in enumerate(["train"] * 160 + ["val"] * 60 + ["test"] * 60)]
    df = spark.createDataFrame(rows, "split string, id long, x double, z double, y int, query string, task_type string").repartition(2, "id")
    return [df.where(f"split = '{s}'") for s in ("train", "val", "test")]


def test_learners_train_side_by_side_with_the_same_results(spark, monkeypatch):
    """Few rows: learners run at the same time; many: in turn. The rows and the thresholds are the same, and in their order."""
    train, val, test = _learning_rows(spark)
    lock, now, most = threading.Lock(), [0], [0]
    for learner in (ML.GBTClassifier, ML.RandomForestClassifier):
        def fit(self, df, inner=learner._fit):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            try:
                return inner(self, df)
            finally:
                with lock:
                    now[0] -= 1
        monkeypatch.setattr(learner, "_fit", fit)
    found = []
    for room in (ML.SIDE_BY_SIDE, 0):
        monkeypatch.setattr(ML, "SIDE_BY_SIDE", room)
        most[0] = 0
        res, fitted = ML.train_binary(train, val, test, ["x", "z"], "y", "T", 2)
        found.append([r.asDict() for r in res.orderBy("pos").collect()])
        assert (most[0] > 1) == (room > 0)
        assert [r["model"] for r in found[-1]] == ["GBT", "GBT_weighted", "RandomForest"] == list(fitted)
        assert [fitted[r["model"]][1] for r in found[-1]] == [r["threshold"] for r in found[-1]]
    assert found[0] == found[1]


def test_models_score_rows_in_one_pass(spark):
    """Each model's probability equals its own transform, and the input is scanned once for all."""
    train, _, test = _learning_rows(spark)
    tr, te = ML.assemble(train, ["x", "z"], ["y"]), ML.assemble(test, ["x", "z"], ["y", "id"])
    models = {name: est.fit(tr) for name, est in ML.binary_learners(2, "y", None).items()} | {"other": ML.RandomForestClassifier(labelCol="y", numTrees=2, seed=1).fit(tr)}
    got = {r["id"]: (r["p1_GBT"], r["p1_other"]) for r in ML.scored(te, models, "y").select("p1_GBT", "p1_other", "y").withColumn("id", F.monotonically_increasing_id()).collect()}
    want = {}
    for name, model in models.items():
        for r in ML._p1(model.transform(te)).select("p1").withColumn("id", F.monotonically_increasing_id()).collect():
            want.setdefault(r["id"], []).append(r["p1"])
    assert {k: list(v) for k, v in got.items()} == want and len(want) == 60


def test_texts_are_counted_once_for_both_task_learners(spark, monkeypatch):
    train, _, test = _learning_rows(spark)
    fits, inner = [], ML.CountVectorizer._fit
    monkeypatch.setattr(ML.CountVectorizer, "_fit", lambda self, df: fits.append(1) or inner(self, df))
    res, fitted = ML.train_task_classifier(train, test, max_iter=5)
    assert len(fits) == 1 and [r["model"] for r in res.orderBy("pos").collect()] == ["LogReg", "LinearSVM"]
    assert fitted["LogReg"].transform(test.select("query", "task_type")).where("prediction is not null").count() == 60
