"""Streaming inference with a saved pipeline, restart without repeated rows, and monitoring of the growing log."""
import json
import os

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from ragscope.operators import models as ML
from ragscope.schema import CATEGORIES, reference_features
from ragscope.sources import adapters as AD
from ragscope.sources import artifacts as AR
from ragscope.streaming import scoring as ST

SF = "/root/testdata/sf0.001"
FIXED = ("SELECT *, 0.25D + 0.5D * top1_score AS correctness_prob, 1D - mrr_at_10 AS hallucination_prob, "
         "total_latency_ms AS predicted_latency_ms, total_cost_usd AS predicted_cost_usd FROM __THIS__")


@pytest.fixture()
def served(spark, tmp_path):
    """A folder of requests in four files, and a fixed scorer saved as a pipeline."""
    requests = AD.requests_from_events(spark.read.parquet(f"{SF}/events.parquet")).where("request_id < 400").withColumn("ts", F.to_timestamp("ts"))
    requests.repartition(4, "request_id").write.parquet(f"{tmp_path}/requests")
    PipelineModel([SQLTransformer(statement=FIXED)]).write().save(f"{tmp_path}/scorer")
    return str(tmp_path), requests


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/requests")


def serve(spark, folder, schema):
    return ST.serve(stream(spark, folder, schema), f"{folder}/scorer", reference_features(), CATEGORIES, f"{folder}/sink", f"{folder}/checkpoint")


def test_stream_equals_batch_and_restart_repeats_nothing(spark, served, monkeypatch):
    folder, requests = served
    calls, real = [], ST.log_records

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) == 3:   # the third batch has written its predictions, but not its log
            raise RuntimeError("lost")
        return real(*args, **kwargs)

    monkeypatch.setattr(ST, "log_records", failing)
    with pytest.raises(Exception):
        serve(spark, folder, requests.schema)
    assert spark.read.json(f"{folder}/sink/log").count() < requests.count()
    serve(spark, folder, requests.schema)
    want = ST.score_requests(requests, reference_features(), model=PipelineModel.load(f"{folder}/scorer"), keep=["request_id", "ts"])
    got = spark.read.parquet(f"{folder}/sink/predictions")
    columns = ["request_id", "input_hash", *ST.PREDICTED]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    log = spark.read.schema(AR.PREDICTION_LOG_SCHEMA).json(f"{folder}/sink/log")
    fields = ["timestamp", "input_hash", "predictions", "warnings"]
    assert sorted(map(str, log.select(fields).collect())) == sorted(map(str, real(want, "ts").select(fields).collect()))
    assert log.where("latency_ms <= 0").count() == 0
    before = got.count()
    serve(spark, folder, requests.schema)   # nothing new
    assert spark.read.parquet(f"{folder}/sink/predictions").count() == before


def test_log_monitor_closes_days_and_drops_late_records(spark, tmp_path):
    def record(ts, correct, high, latency):
        return {"timestamp": ts, "input_hash": "h", "predictions": {"correctness": "CORRECT" if correct else "INCORRECT", "correctness_prob": 0.5,
                "hallucination": "HIGH" if high else "LOW", "hallucination_prob": 0.5, "latency_ms": latency, "cost_usd": 0.1}, "latency_ms": 1.0, "warnings": []}

    files = [[record("2024-05-01T10:00:00.000000Z", 1, 0, 10.0), record("2024-05-01T23:59:00.000000Z", 0, 1, 30.0)],
             [record("2024-05-03T01:00:00.000000Z", 1, 1, 5.0)],
             [record("2024-05-03T02:00:00.000000Z", 0, 0, 7.0)],
             [record("2024-05-01T12:00:00.000000Z", 1, 1, 99.0)],  # late: its day is closed
             [record("2024-05-05T00:30:00.000000Z", 0, 0, 1.0)]]
    os.makedirs(f"{tmp_path}/log")
    for i, rows in enumerate(files):
        path = f"{tmp_path}/log/part-{i}.json"
        with open(path, "w") as f:
            f.write("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    ST.run_to_sink(ST.monitor_log(spark, f"{tmp_path}/log", files_per_batch=1), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {r["window_start"]: tuple(r)[1:] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"2024-05-01 00:00:00": (2, 0.5, 0.5, 20.0), "2024-05-03 00:00:00": (2, 0.5, 0.5, 6.0)}
    last = AR.prediction_log_summary(spark, f"{tmp_path}/log").first()
    assert last["n_records"] == 6 and last["last"]["timestamp"].startswith("2024-05-05")


def test_scoring_pipeline_saved_and_loaded(spark, runs_sample, tmp_path):
    names = ["top1_score", "mrr_at_10", "recall_at_5", "context.tokens"]
    df = runs_sample.withColumn("context.tokens", F.col("prompt_tokens")).withColumn("is_correct", F.col("is_correct").cast("double"))
    x = ML.assemble(df, names, ["is_correct", "total_latency_ms"])
    gbt = GBTClassifier(labelCol="is_correct", maxIter=3, maxDepth=2, seed=1).fit(x)
    scored = ML._p1(gbt.transform(x))
    iso = ML.isotonic_calibrator(scored, "is_correct")
    reg = GBTRegressor(labelCol="total_latency_ms", maxIter=2, maxDepth=2, seed=1).fit(ML.assemble(df, names[:2], ["total_latency_ms"]))
    ML.scoring_pipeline(names, (gbt, iso, 0.6), (gbt, iso, 0.3), (reg, names[:2]), (reg, names[:2])).write().save(f"{tmp_path}/pipeline")
    twice = df.union(df).select("run_id", *[f"`{n}`" for n in names])   # a repeated id stays two rows
    out = ML.load_pipeline(f"{tmp_path}/pipeline").transform(twice)
    assert out.count() == 200 and gbt.getFeaturesCol() == "features" and iso.getFeaturesCol() == "p1" and not [c for c in out.columns if c.startswith("_")]
    want = {r["run_id"]: round(r["p_cal"], 4) for r in iso.transform(ML._p1(gbt.transform(ML.assemble(df, names, ["run_id"])))).collect()}
    for r in out.collect():
        assert r["correctness_prob"] == pytest.approx(want[r["run_id"]], abs=1e-4) and r["correctness_calibrated"]
        assert r["hallucination"] in ("HIGH", "LOW") and r["correctness_threshold"] == 0.6
