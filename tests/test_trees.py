"""Histogram learners against Spark ML's own, and against themselves where rows lie elsewhere."""
import numpy as np
import pytest
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ragscope.operators import explain as XP
from ragscope.operators import models as ML
from ragscope.operators import trees as T


@pytest.fixture(scope="module")
def rows(spark):
    """2,000 rows: seven numbers, five flags, a constant; labels that depend on some of them."""
    rng = np.random.default_rng(3)
    x = np.column_stack([np.round(rng.normal(size=(2000, 7)), 2), rng.random((2000, 5)) < 0.3, np.ones(2000)])
    y = (x[:, 0] + x[:, 8] * x[:, 1] + rng.normal(size=2000) * 0.3 > 0.4).astype(int)
    z = 100 * x[:, 2] + 50 * x[:, 9] * x[:, 0] + rng.normal(size=2000)
    return spark.createDataFrame([(i, int(y[i]), int(y[i] + 2 * x[i, 9]) % 3, float(z[i]), 1.0 + i % 2, Vectors.dense(x[i])) for i in range(2000)],
                                 ["id", "y", "c", "z", "weight", "features"]).repartition(3, "id").cache()


def _score(model, df, label):
    out = model.transform(df)
    if isinstance(model, (MR.GBTRegressionModel, MR.RandomForestRegressionModel)):
        return -out.agg(F.avg((F.col(label) - F.col("prediction")) ** 2)).first()[0]
    return out.agg(F.avg((F.col(label) == F.col("prediction")).cast("int"))).first()[0]


@pytest.mark.parametrize("own, spark_ml, label, options", [
    (T.GBTClassifier, MC.GBTClassifier, "y", {"maxIter": 8, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}),
    (T.GBTClassifier, MC.GBTClassifier, "y", {"maxIter": 8, "maxDepth": 4, "weightCol": "weight"}),
    (T.RandomForestClassifier, MC.RandomForestClassifier, "c", {"numTrees": 10, "maxDepth": 8, "weightCol": "weight"}),
    (T.GBTRegressor, MR.GBTRegressor, "z", {"maxIter": 8, "maxDepth": 4}),
    (T.RandomForestRegressor, MR.RandomForestRegressor, "z", {"numTrees": 40, "maxDepth": 8})])
def test_learners_are_as_good_as_spark_mls(rows, own, spark_ml, label, options):
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    a, b = (kind(labelCol=label, seed=5, **options).fit(train) for kind in (own, spark_ml))
    assert type(a) is type(b) and a.numFeatures == b.numFeatures and a.getNumTrees == b.getNumTrees
    got, want = _score(a, test, label), _score(b, test, label)
    assert got > want - 0.02 if want > 0 else got > 1.2 * want
    assert np.corrcoef(a.featureImportances.toArray(), b.featureImportances.toArray())[0, 1] > 0.9
    assert a.featureImportances[12] == 0


def test_one_tree_is_spark_mls(rows):
    """Without random parts, the first tree has the same splits, values and statistics (all values are split candidates)."""
    x = vector_to_array("features")
    few = rows.select("y", "weight", array_to_vector(F.array(F.round(x[0]), x[8], F.round(x[1]))).alias("features"))
    for options in ({"maxIter": 1, "maxDepth": 4}, {"maxIter": 1, "maxDepth": 4, "weightCol": "weight"}):
        a, b = (kind(labelCol="y", seed=5, **options).fit(few) for kind in (T.GBTClassifier, MC.GBTClassifier))
        assert a.trees[0].toDebugString.split("\n")[1:] == b.trees[0].toDebugString.split("\n")[1:]
        x, y = (XP.export_trees(m, few.sparkSession, "same")["trees"][0] for m in (a, b))
        assert np.allclose(x["cover"], y["cover"]) and np.allclose(x["val"], y["val"])


@pytest.mark.parametrize("learner, label", [(T.GBTClassifier, "y"), (T.RandomForestClassifier, "c"), (T.GBTRegressor, "z"), (T.RandomForestRegressor, "z")])
def test_rows_in_one_task_or_many_give_the_same_trees(rows, monkeypatch, learner, label):
    options = {"maxIter": 3} if "GBT" in learner.__name__ else {"numTrees": 3}
    found = []
    for here in (T.HERE, 0):
        monkeypatch.setattr(T, "HERE", here)
        model = learner(labelCol=label, seed=5, maxDepth=4, **options).fit(rows)
        found.append([r[0] for r in model.transform(rows).orderBy("id").select(F.round("prediction", 6)).collect()])
    assert found[0] == found[1]


def test_columns_and_vectors_give_the_same_bins(spark):
    """Nulls, NaN and absent columns count as 0; a name may hold dots; labels must not be null."""
    df = spark.createDataFrame([(i, i % 2, float(i % 5) if i % 7 else None, i % 3, float("nan") if i % 11 == 0 else i / 10) for i in range(300)],
                               "id int, y int, `a.b` double, c int, d double").repartition(2, "id")
    names = ["a.b", "c", "gone", "d"]
    made = [T.bin_rows(df, names, "y"), T.bin_rows(ML.assemble(df, names, ["y", "id"]), "features", "y")]
    codes = [np.sort(np.concatenate([b["codes"] for b in m.rdd.collect()], 1).T, axis=0).tolist() for m in made]
    assert codes[0] == codes[1] and [len(c) for c in made[0].layout.cuts] == [4, 2, 0, 31] and made[0].count() == 300
    with pytest.raises(Exception, match="labels must not be null"):
        T.bin_rows(df.withColumn("y", F.lit(None).cast("int")), names, "y")


def test_rows_are_binned_once_and_compactly_for_all_learners(spark, monkeypatch):
    """The starting form kept a vector of doubles per row, and an object with an int per feature for each learner."""
    df = spark.range(4000).select((F.col("id") % 2).cast("int").alias("y"), *[(F.col("id") % (2 + k % 3)).alias(f"x{k}") for k in range(40)])
    made, inner = [], ML.bin_rows
    monkeypatch.setattr(ML, "bin_rows", lambda *a: made.append(inner(*a)) or made[-1])
    ML.train_binary(df, df, df, [f"x{k}" for k in range(40)], "y", "T", 2)
    assert len(made) == 1
    again = inner(df, [f"x{k}" for k in range(40)], "y")
    assert sum(b["codes"].nbytes for b in again.rdd.collect()) / 4000 <= 16   # 40 doubles are 320 bytes
