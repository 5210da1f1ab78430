"""Scans and sinks.

Every reader declares its schema (or relies on Parquet's), so no inference
pass is made over large inputs.  Writers are plain DataFrame writers; a
missing input raises Spark's ``AnalysisException`` (PATH_NOT_FOUND).
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TEST_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def load_tables(spark: SparkSession, sf_dir: str, names: Iterable[str] = TEST_TABLES) -> dict[str, DataFrame]:
    """Named tables → dict of DataFrames (lazy; a missing file fails on first use)."""
    return {n: read_table(spark, sf_dir, n) for n in names}


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


#: How CSV files are written and read: quotes are doubled, white space stays, a null is \\N and an empty text is quoted.
CSV = {"quote": '"', "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   sep: str = ",", header: bool = True) -> DataFrame:
    """CSV scan with a declared schema: quoted separators, quotes and line breaks are part of a value; a header
    that differs from the schema and a malformed row are errors."""
    r = spark.read.options(**CSV, header=header, sep=sep, multiLine=True, mode="FAILFAST", enforceSchema=False)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: Iterable[str] | None = None) -> str:
    """Write a table (Parquet by default; ``fmt='csv'`` writes a header, no index)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**CSV, header=True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def read_training_curve(spark: SparkSession, learn_path: str, test_path: str) -> DataFrame:
    """The learner's TSV loss logs, joined on iteration."""
    schema = "iter INT, loss DOUBLE"
    learn = read_csv_table(spark, learn_path, schema, sep="\t").withColumnRenamed("loss", "learn_loss")
    test = read_csv_table(spark, test_path, schema, sep="\t").withColumnRenamed("loss", "test_loss")
    return learn.join(test, "iter", "full")


def cached(df: DataFrame) -> DataFrame:
    """Keep a derived table between queries (memory, spilling to disk)."""
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)
