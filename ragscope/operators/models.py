"""Predictive tasks on Spark ML.

Gradient-boosted and random-forest learners replace the reference's boosting
libraries; metrics come from ``ragscope.operators.metrics`` (same definitions as
the reference's).  Training data never leaves the executors: Spark ML learners
are distributed (trees aggregate split statistics per partition); the driver
only holds models, thresholds and metric rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as MC
from pyspark.ml import regression as MR
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import (PCA, CountVectorizer, IDF, NGram, Normalizer, RegexTokenizer, SQLTransformer,
                                StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import metrics as M
from .features import feature_matrix
from .neighbors import balanced_weights, positive_weight
from .trees import GBTClassifier, GBTRegressor, RandomForestClassifier, RandomForestRegressor, bin_rows


def model_dir(spark: SparkSession, name: str) -> str:
    """Models live in the cluster's shared folder (spark.checkpoint.dir), never on a local disk."""
    return os.path.join(ensure_checkpoint_dir(spark), "ragscope-models", name)


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str], out: str = "features") -> DataFrame:
    """Null-filled feature matrix (P10) → one vector column (slot i = features[i]).

    Columns are renamed positionally first: one-hot names may contain dots, which
    the assembler would read as struct paths."""
    X = feature_matrix(df, features, keep)
    pos = [f"_f{i}" for i in range(len(features))]
    X = X.select(*[F.col(k) for k in keep], *[F.col(f"`{f}`").alias(p) for f, p in zip(features, pos)])
    return VectorAssembler(inputCols=pos, outputCol=out, handleInvalid="keep").transform(X).select(*keep, out)


def training_rows(df: DataFrame, per_core: int = 8) -> DataFrame:
    """``df`` in at most ``per_core`` partitions a core, without a shuffle. A tree learner runs hundreds of stages over its rows, and each
    task of each stage reports to the driver: with a task per input file that would grow with the table."""
    most = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(most)


#: Binned training rows of learners that run side by side, in bytes a core.
SIDE_BY_SIDE = 512 << 20


def at_once(spark: SparkSession, rows: int, width: int, learners: int, bytes_each: int = 4) -> int:
    """How many of ``learners`` train side by side. A learner keeps its rows binned (an int per feature, ``trees`` a byte at most) in memory for
    its hundreds of short stages; few rows leave cores idle in each stage, many fill them and the memory, and then learners take turns."""
    most = SIDE_BY_SIDE * spark.sparkContext.defaultParallelism // max(1, rows * (bytes_each * width + 100))
    return max(1, min(learners, most))


def side_by_side(spark: SparkSession, jobs: Sequence[Callable], n: int) -> list:
    """The results of ``jobs`` in their order, ``n`` of them run at a time as Spark jobs of their own."""
    if n < 2:
        return [job() for job in jobs]
    with ThreadPool(n) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)


def _p1(df: DataFrame, col: str = "probability") -> DataFrame:
    return df.withColumn("p1", vector_to_array(F.col(col))[1])


# ───────────────────────────── binary classification ─────────────────────────────
def binary_learners(n_iter: int, label: str, weight: str | None = "weight", seed: int = 42) -> dict:
    """M1/M3 learner set: boosted trees, boosted trees with class weights, random forest with weights."""
    gbt = dict(labelCol=label, featuresCol="features", maxIter=n_iter, maxDepth=6, stepSize=0.1,
               subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    out = {"GBT": GBTClassifier(**gbt)}
    if weight:
        out["GBT_weighted"] = GBTClassifier(weightCol=weight, **gbt)
        out["RandomForest"] = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=n_iter,
                                                     maxDepth=12, weightCol=weight, seed=seed)
    return out


def rebalance_vectors(df: DataFrame, label: str, method: str, features_col: str = "features") -> DataFrame:
    """B1 / B2 on a training set of (label, vector): "smote" equalises classes, "smoteenn" then drops rows
    whose 3 nearest neighbours disagree with their label.  Uses the exact k-NN operator."""
    from pyspark.ml.functions import array_to_vector
    from ..session import cut_lineage
    from .neighbors import enn, smote
    # row ids must not change between the many branches / retries that read them: fix them by a checkpoint
    arr = cut_lineage(df.select(F.monotonically_increasing_id().alias("_rid"), F.col(label),
                                vector_to_array(F.col(features_col)).alias("_x")))
    out = smote(arr, "_rid", label, "_x")
    if method == "smoteenn":
        out = enn(out, "_rid", label, "_x", 3)
    elif method != "smote":
        raise ValueError(f"unknown rebalancing method {method!r}")
    return out.select(F.col(label), array_to_vector(F.col("_x")).alias(features_col))


def scored(rows: DataFrame, models: dict, label: str) -> DataFrame:
    """``label`` and the probability of class 1 by each model (``p1_<name>``), all models in one pass over the rows."""
    out = rows
    for name, model in models.items():
        own = model.copy().setRawPredictionCol(f"_raw_{name}").setProbabilityCol(f"_p_{name}").setPredictionCol(f"_y_{name}")
        out = _p1(own.transform(out), f"_p_{name}").withColumnRenamed("p1", f"p1_{name}")
    return out.select(label, *[f"p1_{name}" for name in models])


def with_class_weights(df: DataFrame, label: str, weigh: Callable, out: str = "weight") -> DataFrame:
    """``weigh``'s weight of each row as a literal by class (a binary label has few), so that no join stands between the rows and
    the features that are computed from them."""
    weights = weigh(df.select(label), label).distinct().collect()
    cases = [F.when(F.col(label).eqNullSafe(F.lit(r[label])), F.lit(r["weight"])) for r in weights]
    return df.withColumn(out, F.coalesce(*cases) if cases else F.lit(1.0))


def train_binary(train: DataFrame, val: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                 task: str, n_iter: int = 300, weighting: str = "balanced", minority: int = 0,
                 tune_on: str = "val", seed: int = 42, rebalance: str | None = None) -> tuple[DataFrame, dict]:
    """M1 / M3: optionally rebalance the training split (B1/B2), fit the learners, tune a threshold
    on ``tune_on``, score test, pick best by F1-macro (W6).

    Returns (metrics rows, {name: (model, threshold)})."""
    keep = [label]
    tr, columns = train, features
    if rebalance:
        from ..session import cut_lineage
        tr, columns = cut_lineage(rebalance_vectors(assemble(train, features, keep), label, rebalance)), "features"
    tr = with_class_weights(tr, label, balanced_weights if weighting == "balanced" else positive_weight)
    va = assemble(val, features, keep)
    te = assemble(test, features, keep)
    tr = bin_rows(tr, columns, label, "weight")   # once for all learners
    spark = train.sparkSession
    learners = binary_learners(n_iter, label, "weight", seed)
    n = at_once(spark, tr.count(), len(features), len(learners), 1)
    models = dict(zip(learners, side_by_side(spark, [lambda est=est: est.fit(tr) for est in learners.values()], n)))
    tr.unpersist()
    tune = scored(va if tune_on == "val" else te, models, label).cache()
    pred = (scored(te, models, label) if tune_on == "val" else tune).cache()

    def judge(name: str, pos: int) -> tuple:
        thr = M.best_threshold(tune.select(label, F.col(f"p1_{name}").alias("p1")), label, "p1").first()["threshold"]
        own = pred.select(label, F.col(f"p1_{name}").alias("p1")).withColumn("pred", (F.col("p1") >= thr).cast("int"))
        rep = {r["label"]: r for r in M.class_report(own, label, "pred", digits=None).collect()}
        auc = M.roc_auc(own, label, "p1").first()["auc"]
        f1m = sum(r["f1"] for k, r in rep.items() if k not in ("accuracy", "macro avg", "weighted avg")) / \
            max(1, len([k for k in rep if k not in ("accuracy", "macro avg", "weighted avg")]))
        return (name, task, pos, float(rep["accuracy"]["precision"]), auc, float(f1m), float(thr),
                float(rep.get(str(minority), {"recall": 0.0})["recall"]))

    rows = side_by_side(spark, [lambda name=name, pos=pos: judge(name, pos) for pos, name in enumerate(models)], n)
    tune.unpersist()
    pred.unpersist()
    fitted = {r[0]: (models[r[0]], r[6]) for r in rows}
    res = spark.createDataFrame(rows, "model string, task string, pos int, accuracy double, auc double, "
                                      "f1_macro double, threshold double, recall_minority double")
    return res, fitted


# ───────────────────────────── multi-class classification ─────────────────────────────
def train_multiclass(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, task: str,
                     n_iter: int = 300, seed: int = 42, rebalance: str | None = None, binned: bool = False) -> tuple[DataFrame, dict]:
    """M2 / M4: optionally rebalance the training split (B1/B2), fit a random forest (native multi-class) and one-vs-rest
    boosted trees; labels indexed alphabetically (E7).  Returns metrics rows (accuracy, F1-macro, per-class recall) and models.
    ``binned``: as in ``train_regression``."""
    gbt, forest = (GBTClassifier, RandomForestClassifier) if binned else (MC.GBTClassifier, MC.RandomForestClassifier)
    idx = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(train)
    tr = assemble(idx.transform(train), features, ["y"])
    if rebalance:
        from ..session import cut_lineage
        tr = cut_lineage(rebalance_vectors(tr, "y", rebalance))
    tr = training_rows(tr).cache()
    te = assemble(idx.transform(test), features, ["y"])
    spark = train.sparkSession
    n = at_once(spark, tr.count(), len(features), 1 + len(idx.labels), 1 if binned else 4)
    learners = {
        "RandomForest": forest(labelCol="y", featuresCol="features", numTrees=n_iter, maxDepth=12, seed=seed),
        "OvR_GBT": OneVsRest(classifier=gbt(maxIter=max(1, n_iter // 3), maxDepth=6, stepSize=0.1, seed=seed),
                             labelCol="y", featuresCol="features", parallelism=max(1, n - 1)),
    }

    def learn(name: str, pos: int) -> tuple:
        model = learners[name].fit(tr)
        pred = model.transform(te)
        rep = {r["label"]: r for r in M.class_report(pred, "y", "prediction", digits=None).collect()}
        classes = [k for k in rep if k not in ("accuracy", "macro avg", "weighted avg")]
        recall = {idx.labels[int(float(k))]: float(rep[k]["recall"]) for k in classes}
        return model, (name, task, pos, float(rep["accuracy"]["precision"]),
                       float(sum(rep[k]["f1"] for k in classes) / len(classes)), recall)

    learned = side_by_side(spark, [lambda name=name, pos=pos: learn(name, pos) for pos, name in enumerate(learners)], min(n, 2))
    rows, fitted = [row for _, row in learned], {row[0]: model for model, row in learned}
    tr.unpersist()
    res = spark.createDataFrame(
        rows, "model string, task string, pos int, accuracy double, f1_macro double, recall_by_class map<string,double>")
    return res, fitted


def softmax_probabilities(df: DataFrame, raw_col: str = "rawPrediction", out: str = "probability_arr") -> DataFrame:
    """Probabilities for one-vs-rest models (which only give raw scores): softmax of the raw array."""
    raw = vector_to_array(F.col(raw_col))
    mx = F.array_max(raw)
    ex = F.transform(raw, lambda x: F.exp(x - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, b: a + b)
    return df.withColumn(out, F.transform(ex, lambda x: x / tot))


# ───────────────────────────── regression ─────────────────────────────
def train_regression(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, task: str,
                     leakage: Sequence[str] = (), n_iter: int = 300, seed: int = 42, binned: bool = False) -> tuple[DataFrame, dict]:
    """M5 / M6: boosted-tree and random-forest regressors on the leakage-free features (P6). ``binned``: by histograms of rows that
    are binned once (``trees``), as good as Spark ML's learners but with other random draws."""
    feats = [f for f in features if f not in set(leakage)]
    gbt, forest = (GBTRegressor, RandomForestRegressor) if binned else (MR.GBTRegressor, MR.RandomForestRegressor)
    tr = bin_rows(train, feats, label) if binned else training_rows(assemble(train, feats, [label])).cache()
    te = assemble(test, feats, [label])
    learners = {"GBT": gbt(labelCol=label, featuresCol="features", maxIter=n_iter, maxDepth=6, stepSize=0.1,
                                    subsamplingRate=0.8, seed=seed),
                "RandomForest": forest(labelCol=label, featuresCol="features",
                                       numTrees=max(1, (n_iter * 2) // 3), maxDepth=12, seed=seed)}
    spark = train.sparkSession

    def learn(name: str, pos: int) -> tuple:
        model = learners[name].fit(tr)
        r = M.regression_metrics(model.transform(te), label, "prediction").first()
        return model, (name, task, pos, len(feats), r["rmse"], r["mae"], r["r2"])

    learned = side_by_side(spark, [lambda name=name, pos=pos: learn(name, pos) for pos, name in enumerate(learners)],
                           at_once(spark, tr.count(), len(feats), len(learners), 1 if binned else 4))
    rows, fitted = [row for _, row in learned], {row[0]: (model, feats) for model, row in learned}
    tr.unpersist()
    res = spark.createDataFrame(
        rows, "model string, task string, pos int, n_features int, rmse double, mae double, r2 double")
    return res, fitted


# ───────────────────────────── text classifier ─────────────────────────────
def text_pipeline(text_col: str, max_features: int = 3000) -> list:
    """Tokens (≥ 2 word chars, lower-case) + bigrams → counts over the top terms → idf → L2."""
    return [
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False, toLowercase=True),
        NGram(n=2, inputCol="_tok", outputCol="_bi"),
        SQLTransformer(statement="SELECT *, concat(_tok, _bi) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=max_features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="features", p=2.0),
    ]


def train_task_classifier(train: DataFrame, test: DataFrame, text_col: str = "query", label: str = "task_type",
                          max_iter: int = 1000) -> tuple[DataFrame, dict]:
    """M7: TF-IDF + logistic regression (balanced weights) and one-vs-rest linear SVM; F1-macro on test."""
    idx = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep")
    tr = balanced_weights(train.select(text_col, label), label)
    rows, fitted = [], {}
    learners = {"LogReg": LogisticRegression(labelCol="y", featuresCol="features", weightCol="weight",
                                             maxIter=max_iter),
                "LinearSVM": OneVsRest(classifier=LinearSVC(maxIter=max(10, max_iter * 2 // 10)), labelCol="y",
                                       featuresCol="features")}
    terms = Pipeline(stages=[idx, *text_pipeline(text_col)]).fit(tr)   # one vocabulary and one pass over the texts for both learners
    tr = training_rows(terms.transform(tr).select("y", "features", "weight")).cache()
    te = terms.transform(test.select(text_col, label)).select("y", "features").cache()
    for pos, (name, est) in enumerate(learners.items()):
        model = est.fit(tr)
        pred = model.transform(te)
        f1 = M.macro_f1(pred, "y", "prediction").first()["f1_macro"]
        rows.append((name, "TaskType", pos, float(f1)))
        fitted[name] = PipelineModel([*terms.stages, model])
    tr.unpersist()
    te.unpersist()
    res = train.sparkSession.createDataFrame(rows, "model string, task string, pos int, f1_macro double")
    return res, fitted


def term_vectors(weights: DataFrame, doc_id: str, term: str = "term", weight: str = "tfidf", out: str = "features") -> tuple[DataFrame, list[str]]:
    """Long-form term weights (E9) gathered into one sparse vector per document, slots in the order of the terms; at most
    as many entries per document as there are terms."""
    terms = sorted(r[0] for r in weights.select(term).distinct().collect())   # the bounded vocabulary of the weights
    slots = weights.sparkSession.createDataFrame(list(enumerate(terms)), "_slot int, _term string")
    rows = weights.join(F.broadcast(slots), F.col(term) == F.col("_term")).groupBy(doc_id).agg(
        F.array_sort(F.collect_list(F.struct("_slot", F.col(weight).alias("_w")))).alias("_e"))
    size = len(terms)
    gather = F.udf(lambda at, w: Vectors.sparse(size, at, w), VectorUDT())
    return rows.select(doc_id, gather("_e._slot", "_e._w").alias(out)), terms


def train_text_classifier(vectors: DataFrame, label: str, train: Column, max_iter: int = 1000) -> tuple[DataFrame, dict]:
    """M7 on given vectors: logistic regression and one-vs-rest linear SVM, both with balanced weights; rows where ``train``
    holds fit, the others are judged. Rows without a label are left out."""
    from ..session import cut_lineage
    rows = cut_lineage(vectors.where(F.col(label).isNotNull()))   # the texts are read once
    idx = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    rows = idx.transform(rows)
    tr = training_rows(cut_lineage(balanced_weights(rows.where(train).select("y", label, "features"), label)), 2)   # thousands of short passes
    te = cut_lineage(rows.where(~train).select("y", "features"))
    out, fitted = [], {}
    for pos, (name, est) in enumerate({
            "LogReg": LogisticRegression(labelCol="y", featuresCol="features", weightCol="weight", maxIter=max_iter),
            "LinearSVM": OneVsRest(classifier=LinearSVC(maxIter=max_iter), labelCol="y", featuresCol="features", weightCol="weight",
                                   parallelism=4)}.items()):
        model = est.fit(tr)
        out.append((name, pos, M.macro_f1(model.transform(te), "y", "prediction").first()["f1_macro"]))
        fitted[name] = (model, idx.labels)
    return vectors.sparkSession.createDataFrame(out, "model string, pos int, f1_macro double"), fitted


# ───────────────────────────── calibration ─────────────────────────────
def isotonic_calibrator(scored: DataFrame, label: str, score: str = "p1"):
    """Isotonic regression of the label on the score (pool adjacent violators).

    Rows of one score are one point: their mean label, weighted by their number, which gives the same fit. So the learner
    gets a row per distinct score, and no task sorts all rows of a common one."""
    points = scored.where(F.col(label).isNotNull()).groupBy(score).agg(F.avg(F.col(label).cast("double")).alias(label), F.count(F.lit(1)).cast("double").alias("_n"))
    return IsotonicRegression(isotonic=True, labelCol=label, featuresCol=score, predictionCol="p_cal", weightCol="_n").fit(points)


def calibrate(model, val: DataFrame, test: DataFrame, features: Sequence[str], label: str) -> tuple[DataFrame, object, float]:
    """Isotonic calibration of a fitted binary model on the validation split: AUC before/after on test, the
    calibrator, and the threshold tuned again on calibrated validation probabilities (D6)."""
    from ..session import cut_lineage
    va = cut_lineage(_p1(model.transform(assemble(val, features, [label]))).select(label, "p1"))   # scored once, read by each step
    iso = isotonic_calibrator(va, label)
    threshold = M.best_threshold(iso.transform(va), label, "p_cal").first()["threshold"]
    te = cut_lineage(_p1(model.transform(assemble(test, features, [label]))).select(label, "p1"))
    cal = iso.transform(te)
    raw_auc = M.roc_auc(cal, label, "p1").first()["auc"]
    cal_auc = M.roc_auc(cal, label, "p_cal").first()["auc"]
    res = val.sparkSession.createDataFrame([(raw_auc, cal_auc)], "auc_raw double, auc_calibrated double")
    return res, iso, threshold


# ───────────────────────────── clustering / projection ─────────────────────────────
#: Rows whose distances to a start's centres are held at a time, few enough to stay in the cache.
KMEANS_ROWS = 1 << 10


def _spread_centres(x: np.ndarray, k: int, rng) -> np.ndarray:
    """k rows, each drawn with a chance that grows with the squared distance to those drawn before (k-means++)."""
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    return np.array(centres)


def kmeans_starts(df: DataFrame, features_col: str, ks: Sequence[int], n_init: int = 10, max_iter: int = 300, tol: float = 1e-4,
                  seed: int = 42, sample: int = 10_000) -> dict[int, tuple[np.ndarray, float]]:
    """For every k, centres and inertia of the best of ``n_init`` starts.

    All starts of all k move together: one pass over the data per iteration gives every start's sums per cluster, added up
    by Spark, so that starts × k × dimensions numbers come to the driver, whatever the rows. A start rests once its centres move by
    less than ``tol`` (squared, relative to the mean variance). First centres are drawn from ``sample`` rows."""
    from ..session import cut_lineage
    data = cut_lineage(df.select(vector_to_array(F.col(features_col)).alias("x")))   # read once per iteration
    first = data.orderBy(F.xxhash64("x", F.lit(seed))).limit(sample).collect()
    if not first:
        return {}
    rows = np.array([r["x"] for r in first])
    dim, scale = rows.shape[1], rows.var(0).mean()
    starts = {(k, i): _spread_centres(rows, k, np.random.default_rng([seed, k, i])) for k in ks for i in range(n_init)}
    inertia, moving = {}, dict(starts)
    sums = ["n", "cost", *[f"s{j}" for j in range(dim)]]

    def assigned(now: list) -> DataFrame:
        def step(batches):
            total = {i: np.zeros((len(c), dim + 2)) for i, c in enumerate(now)}
            for batch in batches:
                rows_here = batch.column(0).flatten().to_numpy().reshape(-1, dim)
                for at in range(0, len(rows_here), KMEANS_ROWS):
                    x = rows_here[at: at + KMEANS_ROWS]
                    square, place = (x * x).sum(1), np.arange(len(x))
                    wide = np.column_stack([np.ones(len(x)), np.zeros(len(x)), x])
                    for i, c in enumerate(now):
                        d = x @ c.T
                        d *= -2
                        d += square[:, None] + (c * c).sum(1)
                        near = d.argmin(1)
                        one = np.zeros((len(c), len(x)))
                        one[near, place] = 1
                        wide[:, 1] = np.maximum(d[place, near], 0)
                        total[i] += one @ wide
            out = np.concatenate([np.column_stack([np.full(len(t), i), np.arange(len(t)), t]) for i, t in total.items()])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out.T], names=["start", "cluster", *sums])
        kind = ", ".join(f"{c} double" for c in ["start", "cluster", *sums])
        return data.mapInArrow(step, kind).groupBy("start", "cluster").agg(*[F.sum(c).alias(c) for c in sums])

    for at in range(max_iter + 1):
        keys = list(moving)
        found = {(int(r["start"]), int(r["cluster"])): r for r in assigned([moving[k] for k in keys]).collect()}
        still = {}
        for i, key in enumerate(keys):
            c = moving[key]
            r = [found[i, j] for j in range(len(c))]
            inertia[key] = sum(x["cost"] for x in r)
            starts[key] = c
            new = np.array([[x[f"s{j}"] / x["n"] for j in range(dim)] if x["n"] else c[m] for m, x in enumerate(r)])
            if ((new - c) ** 2).sum() > tol * scale:
                still[key] = new
        moving = still
        if not moving:
            break
    best = {k: min((inertia[k, i], i) for i in range(n_init)) for k in ks}
    return {k: (starts[k, i], float(cost)) for k, (cost, i) in best.items()}


def elbow(df: DataFrame, features_col: str = "features", ks: Sequence[int] = range(2, 11), seed: int = 42, **options) -> DataFrame:
    """K-means inertia for each k, the best of ten starts."""
    found = kmeans_starts(df, features_col, ks, seed=seed, **options)
    return df.sparkSession.createDataFrame([(int(k), cost) for k, (_, cost) in sorted(found.items())], "k int, inertia double")


def assign_clusters(df: DataFrame, features_col: str, centres: Sequence[Sequence[float]], out: str = "cluster") -> DataFrame:
    """The nearest centre of each row (ties: the first), as one expression over the k × dimensions literals."""
    x = vector_to_array(F.col(features_col))
    far = [sum(((x[j] - F.lit(float(v))) * (x[j] - F.lit(float(v))) for j, v in enumerate(c)), F.lit(0.0)) for c in centres]
    return df.withColumn("_d", F.array(*far)).withColumn(out, (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def cluster_profile(a: DataFrame, digits: int = 4) -> DataFrame:
    """Per-cluster accuracy, hallucination, recall@5, latency, cost and count."""
    return a.groupBy("cluster").agg(
        F.round(F.avg("is_correct"), digits).alias("acc"), F.round(F.avg("hallucination_flag"), digits).alias("hal"),
        F.round(F.avg("recall_at_5"), digits).alias("r5"), F.round(F.avg("total_latency_ms"), digits).alias("lat"),
        F.round(F.avg("total_cost_usd"), digits).alias("cost"), F.count(F.lit(1)).alias("n"))


def kmeans_profile(df: DataFrame, features_col: str, k: int = 5, seed: int = 42, digits: int = 4) -> DataFrame:
    """M13 + A17: the best of ten K-means starts and the profile of its clusters."""
    centres, _ = kmeans_starts(df, features_col, [k], seed=seed)[k]
    return cluster_profile(assign_clusters(df, features_col, centres), digits)


def pca2(df: DataFrame, features_col: str, keep: Sequence[str]) -> DataFrame:
    """2-D PCA projection (input already centred by E8, so the projection is centred too)."""
    model = PCA(k=2, inputCol=features_col, outputCol="_pc").fit(df)
    arr = vector_to_array(F.col("_pc"))
    return model.transform(df).select(*keep, arr[0].alias("pc1"), arr[1].alias("pc2"))


def top_importances(model, features: Sequence[str], n: int = 20) -> list[tuple[str, float]]:
    """The n largest tree feature importances (a vector of #features numbers)."""
    imp = model.featureImportances.toArray()
    pairs = sorted(zip(features, imp), key=lambda t: (-t[1], t[0]))
    return [(f, float(v)) for f, v in pairs[:n]]


def save_model(model, spark: SparkSession, name: str) -> str:
    """Write a fitted model to the shared model folder."""
    path = model_dir(spark, name)
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    """A saved pipeline, e.g. one made by ``scoring_pipeline``."""
    return PipelineModel.load(path)


# ───────────────────────────── scoring and the end-to-end job ─────────────────────────────
def scoring_pipeline(features: Sequence[str], correctness, hallucination, latency, cost, task_model=None, text: str = "query") -> PipelineModel:
    """All predictors as one saved-and-loaded pipeline from feature columns to predictions.

    ``correctness`` / ``hallucination`` = (model, calibrator, threshold of calibrated probabilities); ``latency`` / ``cost`` =
    (model, feature subset). The stages are copies with columns of their own: given models stay as they are, and one pass
    over the rows adds all predictions, without a join. ``task_model`` reads the column ``text``."""
    place = {f: f"_f{i}" for i, f in enumerate(features)}   # names may contain dots, see ``assemble``
    filled = ", ".join("coalesce(CAST(`" + f.replace("`", "``") + f"` AS DOUBLE), 0D) AS {p}" for f, p in place.items())
    stages = [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
              VectorAssembler(inputCols=list(place.values()), outputCol="_all", handleInvalid="keep")]
    hidden, made = ["_all", *place.values()], []
    for name, (model, calibrator, threshold), high, low in [("correctness", correctness, "CORRECT", "INCORRECT"),
                                                            ("hallucination", hallucination, "HIGH", "LOW")]:
        own = [f"_{name}_{c}" for c in ("raw", "p", "y")]
        stages.append(model.copy().setFeaturesCol("_all").setRawPredictionCol(own[0]).setProbabilityCol(own[1]).setPredictionCol(own[2]))
        stages.append(calibrator.copy().setFeaturesCol(own[1]).setFeatureIndex(1).setPredictionCol(f"_{name}_cal"))
        hidden += [*own, f"_{name}_cal"]
        made += [f"round(_{name}_cal, 4) AS {name}_prob", f"CASE WHEN _{name}_cal >= {threshold!r}D THEN '{high}' ELSE '{low}' END AS {name}",
                 f"round({threshold!r}D, 3) AS {name}_threshold", f"true AS {name}_calibrated"]
    for name, (model, feats), digits in [("predicted_latency_ms", latency, 2), ("predicted_cost_usd", cost, 6)]:
        stages.append(VectorAssembler(inputCols=[place[f] for f in feats], outputCol=f"_{name}_x", handleInvalid="keep"))
        stages.append(model.copy().setFeaturesCol(f"_{name}_x").setPredictionCol(f"_{name}"))
        hidden += [f"_{name}_x", f"_{name}"]
        made.append(f"round(_{name}, {digits}) AS {name}")
    if task_model is not None:
        labels = next(x.labels for x in task_model.stages if hasattr(x, "labels"))
        stages += [x for x in task_model.stages if not hasattr(x, "labels")]
        hidden += ["_tok", "_bi", "_terms", "_tf", "_tfidf", "features", "rawPrediction", "probability", "prediction"]
        listed = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in labels)
        made.append(f"element_at(array({listed}), CAST(prediction AS INT) + 1) AS query_task_type")
    stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(hidden)}), {', '.join(made)} FROM __THIS__"))
    return PipelineModel(stages)


def training_curve(model, data: DataFrame, loss: str = "logistic") -> list[tuple[int, float]]:
    """S11 source data: loss after each boosting iteration (the learner's per-iteration log)."""
    return [(i + 1, float(v)) for i, v in enumerate(model.evaluateEachIteration(data, loss) if loss != "logistic"
                                                  else model.evaluateEachIteration(data))]
