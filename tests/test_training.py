"""The training job on runs of its own tables."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from ragscope.operators import models as ML
from ragscope.plans import catalog as C


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """400 orders with 0 to 4 items each."""
    d = str(tmp_path_factory.mktemp("runs"))
    k = F.col("id")
    orders = spark.range(400).select(k.alias("o_orderkey"), (k * 7 % 130).alias("o_custkey"), F.element_at(F.array(*map(F.lit, "FOP")), (k % 3 + 1).cast("int")).alias("o_orderstatus"),
                                     F.lit("2024-01-01").cast("timestamp_ntz").alias("o_orderdate"))
    items = spark.range(1600).select((k * 13 % 390).alias("l_orderkey"), (k % 50).alias("l_partkey"), (k % 9).alias("l_suppkey"), (k % 4 + 1).cast("int").alias("l_linenumber"),
                                     (k % 40).cast("double").alias("l_quantity"), (1000 + k * 31 % 9000).cast("double").alias("l_extendedprice"), F.lit(0.0).alias("l_discount"),
                                     F.lit(0.0).alias("l_tax"), F.element_at(F.array(*map(F.lit, "RAN")), (k % 3 + 1).cast("int")).alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
                                     F.lit("2024-01-01").cast("timestamp_ntz").alias("l_shipdate"))
    orders.write.parquet(f"{d}/orders.parquet")
    items.write.parquet(f"{d}/lineitem.parquet")
    return d


def test_train_all_trains_every_task(spark, tables, monkeypatch):
    """Seven tasks, rebalanced training rows for the four classifiers, calibrators and thresholds of the binary ones."""
    monkeypatch.setattr(C, "N_ITER", 1)
    methods, inner = [], ML.rebalance_vectors
    monkeypatch.setattr(ML, "rebalance_vectors", lambda df, label, method, *a: methods.append((label, method)) or inner(df, label, method, *a))
    rows = [r.asDict() for r in C.train_all(spark, tables).collect()]
    found = {}
    for r in rows:
        found.setdefault(r["task"], []).append(r["model"])
    three, two = ["GBT", "GBT_weighted", "RandomForest"], ["GBT", "RandomForest"]
    assert {t: sorted(m) for t, m in found.items()} == {
        "Correctness": three, "Hallucination": three, "MultiCorrectness": ["OvR_GBT", "RandomForest"], "Faithfulness": ["OvR_GBT", "RandomForest"],
        "Latency": two, "Cost": two, "TaskType": ["LinearSVM", "LogReg"]}
    assert sorted(methods) == [("hallucination_flag", "smoteenn"), ("is_correct", "smoteenn"), ("y", "smote"), ("y", "smote")]
    assert [sum(r["auc_calibrated"] is not None for r in rows if r["task"] == t) for t in ("Correctness", "Hallucination", "Latency")] == [1, 1, 0]
    root = ML.model_dir(spark, "train_all")
    kinds = {os.path.basename(p).split("_")[0] for p in glob.glob(f"{root}/*_*")}
    assert {"correctness", "hallucination", "multiclass", "faithfulness", "task", "latency", "cost"} <= kinds
    assert len(glob.glob(f"{root}/*_calibrator")) >= 2
    assert {(r["task"], r["threshold_calibrated"] is not None) for r in spark.read.json(f"{root}/thresholds").collect()} == {("correctness", True), ("hallucination", True)}
