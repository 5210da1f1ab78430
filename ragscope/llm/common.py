"""Helpers shared by the training-data operators: inputs, shared tables, literal lookups."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscope.session import ensure_checkpoint_dir

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of the batches that Spark and its Python workers hand each other; each side holds some of them beside its work.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES where the session sets no bound of its own (Spark's is 64 MB)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ragscope-{label}-{uuid.uuid4().hex}"


#: Delete a query's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost
    executors, and fixes values that a second evaluation might compute in another order. The shuffle
    files of the write are deleted with its end, as nothing reads them again."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = shared_path(spark, label)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialise`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/ragscope-" in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: So many keys are sent to all tasks at most; more meet the rows in a shuffled join.
LOOKED_UP = 1 << 20


def few(keys: DataFrame) -> DataFrame:
    """Keys, marked to be sent to the rows that are looked up by them where they are few, so that those rows are not shuffled."""
    return F.broadcast(keys) if keys.limit(LOOKED_UP + 1).count() <= LOOKED_UP else keys


def long_array(values) -> Column:
    """A literal array<bigint>, folded once at planning however long it is."""
    return F.from_json(F.lit(json.dumps([int(v) for v in values])), "array<bigint>")


def n_words(text) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
