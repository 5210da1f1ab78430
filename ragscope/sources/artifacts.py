"""Small artifacts written next to the models.

Artifacts are DataFrames written with the normal writers; their size is bounded
by the number of features / categories / tasks, never by the number of runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import NOMINAL_FEATURES


def feature_list_frame(spark: SparkSession, features: Sequence[str]) -> DataFrame:
    """Ordered feature list as a (pos, feature) table."""
    return spark.createDataFrame([(i, f) for i, f in enumerate(features)], "pos INT, feature STRING")


def save_feature_list(spark: SparkSession, features: Sequence[str], path: str) -> str:
    feature_list_frame(spark, features).coalesce(1).write.mode("overwrite").json(path)
    return path


def load_feature_list(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.schema("pos INT, feature STRING").json(path).orderBy("pos").collect()
    return [r.feature for r in rows]


def category_table(df: DataFrame, cols: Sequence[str] = NOMINAL_FEATURES) -> DataFrame:
    """Distinct sorted non-null values per nominal column, one row per (column, value).

    Long form (``unpivot`` then one distinct) so the work is one shuffle of at
    most (#columns × #distinct values) keys per map task.
    """
    present = [c for c in cols if c in df.columns]
    long = df.select(*[F.col(c).cast("string").alias(c) for c in present]).unpivot(
        [], present, "column", "value")
    out = long.where(F.col("value").isNotNull()).distinct()
    order = F.array_position(F.array(*[F.lit(c) for c in present]), F.col("column"))
    return out.withColumn("col_pos", order.cast("int")).orderBy("col_pos", "value").drop("col_pos")


def categories_dict(df: DataFrame, cols: Sequence[str] = NOMINAL_FEATURES,
                    max_values: int = 10_000) -> dict[str, list[str]]:
    """Driver-side copy of the category vocabulary (bounded: fails past ``max_values``)."""
    rows = category_table(df, cols).limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(f"more than {max_values} categories; not a nominal vocabulary")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["column"], []).append(r["value"])
    return {c: out[c] for c in cols if c in out}


def save_categories(df: DataFrame, path: str, cols: Sequence[str] = NOMINAL_FEATURES) -> str:
    category_table(df, cols).coalesce(1).write.mode("overwrite").json(path)
    return path


def load_categories(spark: SparkSession, path: str) -> dict[str, list[str]]:
    rows = spark.read.schema("column STRING, value STRING").json(path).collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["column"], []).append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


CLASSIFICATION_METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("task", T.StringType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("auc", T.DoubleType()),
    T.StructField("f1_macro", T.DoubleType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("recall_minority", T.DoubleType()), T.StructField("auc_calibrated", T.DoubleType()),
])
REGRESSION_METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("task", T.StringType()),
    T.StructField("rmse", T.DoubleType()), T.StructField("mae", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
])


def save_metrics(classification: DataFrame | None, regression: DataFrame | None, path: str) -> str:
    """Metrics store as two JSON tables."""
    if classification is not None:
        classification.coalesce(1).write.mode("overwrite").json(f"{path}/classification")
    if regression is not None:
        regression.coalesce(1).write.mode("overwrite").json(f"{path}/regression")
    return path


def load_metrics(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {
        "classification": spark.read.schema(CLASSIFICATION_METRICS_SCHEMA).json(f"{path}/classification"),
        "regression": spark.read.schema(REGRESSION_METRICS_SCHEMA).json(f"{path}/regression"),
    }


PREDICTION_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("input_hash", T.StringType()),
    T.StructField("predictions", T.StructType([
        T.StructField("correctness", T.StringType()),
        T.StructField("correctness_prob", T.DoubleType()),
        T.StructField("hallucination", T.StringType()),
        T.StructField("hallucination_prob", T.DoubleType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("cost_usd", T.DoubleType()),
    ])),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("warnings", T.ArrayType(T.StringType())),
])


def append_prediction_log(log_rows: DataFrame, path: str) -> str:
    """Append JSON-lines records (timestamp, input_hash, predictions, latency, warnings)."""
    log_rows.select([f.name for f in PREDICTION_LOG_SCHEMA.fields]).write.mode("append").json(path)
    return path


def prediction_log_summary(spark: SparkSession, path: str) -> DataFrame:
    """Number of log records and the most recent record (by timestamp; of equal ones the largest by the other fields)."""
    log = spark.read.schema(PREDICTION_LOG_SCHEMA).json(path)
    return log.agg(F.count(F.lit(1)).alias("n_records"), F.max(F.struct(*[F.col(c) for c in log.columns])).alias("last"))
