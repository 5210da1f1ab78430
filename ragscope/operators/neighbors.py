"""Rebalancing by neighbours and weights (B1-B5, U1): SMOTE, edited nearest neighbours, class weights.

Neighbours come from the exact k-NN join of ``pivot_tree``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pivot_tree import knn

__all__ = ["balanced_weights", "enn", "knn", "positive_weight", "smote"]


def smote(df: DataFrame, id_col: str, label_col: str, vec_col: str, k_max: int = 5, seed: int = 42,
          chunk: int = 10_000) -> DataFrame:
    """B1: SMOTE oversampling with deterministic arithmetic instead of a random generator.

    Every non-majority class c gets (majority − n_c) synthetic rows.  Synthetic
    i of class c uses base row rank(i mod n_c) (rank by id within the class),
    neighbour number 1 + (i·31 + seed) mod k among its k = min(k_max, n_min − 1)
    nearest same-class rows, and λ = ((i·7919 + c·104729 + seed) mod 2147483647) / 2147483647:
    x = base + λ·(neighbour − base).  Returns (id, label, vec, is_synthetic) = originals ∪ synthetic (U1);
    synthetic ids are negative.  Rows are generated in chunks of ``chunk`` per task, so a
    class needing billions of rows is still spread over many tasks."""
    from ..session import cut_lineage
    from .metrics import prefix_sums

    base = df.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"),
                     F.col(vec_col).cast("array<double>").alias("_v"))
    # one row per class, of any number: size and place in text order
    classes = base.groupBy("_y").agg(F.count(F.lit(1)).alias("_nc")).withColumns({"_one": F.lit(1).cast("long"), "_text": F.col("_y").cast("string")})
    classes = cut_lineage(prefix_sums(classes, "_text", ["_one"], inclusive=False).select("_y", "_nc", F.col("cum__one").alias("_class")))
    maj, nmin, n_classes = classes.agg(F.max("_nc"), F.min("_nc"), F.count(F.lit(1))).first()
    k = max(1, min(k_max, (nmin or 0) - 1))
    ranked = prefix_sums(base.select("_id", "_y", F.lit(1).cast("long").alias("_one")), "_id", ["_one"], group_cols=["_y"], inclusive=False) \
        .withColumnRenamed("cum__one", "_rank").drop("_one").join(base.drop("_y"), "_id")
    ranked = ranked.join(classes, "_y").withColumn("_need", F.lit(maj) - F.col("_nc"))
    # number of synthetic rows based on this row: i = rank + j·n_c < need
    ranked = ranked.withColumn("_cnt", F.when(F.col("_rank") < F.col("_need"),
                                              F.floor((F.col("_need") - 1 - F.col("_rank")) / F.col("_nc")) + 1)
                               .otherwise(F.lit(0)).cast("long")).where(F.col("_cnt") > 0)
    # the k neighbours join their base row first; synthetic rows are then made without any further shuffle
    vecs = base.select(F.col("_id").alias("nn_id"), F.col("_v").alias("_nv"))
    nbrs = knn(base, "_id", "_v", k, group_cols=["_y"]).join(vecs, "nn_id").groupBy("_y", "_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "_nv"))).alias("_nn"))
    ranked = ranked.join(nbrs, ["_y", "_id"], "left")
    chunks = ranked.select("*", F.explode(F.sequence(F.lit(0).cast("long"),
                                                     F.floor((F.col("_cnt") - 1) / chunk).cast("long"))).alias("_ch"))
    chunks = chunks.repartition("_id", "_ch")
    gen = chunks.select("_id", "_y", "_v", "_nn", "_rank", "_nc", "_class", F.explode(F.sequence(
        F.col("_ch") * chunk, F.least(F.col("_ch") * chunk + chunk, F.col("_cnt")) - 1)).alias("_j"))
    gen = gen.withColumn("_i", F.col("_rank") + F.col("_j") * F.col("_nc"))
    gen = gen.withColumn("_nnr", ((F.col("_i") * 31 + seed) % k + 1).cast("int"))
    lam = ((F.col("_i") * 7919 + F.col("_class") * 104729 + seed) % 2147483647) / 2147483647.0
    syn = gen.withColumn("_nv", F.get("_nn", F.col("_nnr") - 1)["_nv"]).withColumn("_lam", lam)
    new_v = F.when(F.col("_nv").isNull(), F.col("_v")).otherwise(
        F.zip_with("_v", "_nv", lambda a, b: a + F.col("_lam") * (b - a)))
    # synthetic ids: −(1 + class index + i·#classes), unique and negative
    sid = -(F.lit(1) + F.col("_class") + F.col("_i") * n_classes)
    synthetic = syn.select(sid.cast(df.schema[id_col].dataType).alias(id_col), F.col("_y").alias(label_col),
                           new_v.alias(vec_col), F.lit(1).alias("is_synthetic"))
    originals = base.select(F.col("_id").alias(id_col), F.col("_y").alias(label_col), F.col("_v").alias(vec_col),
                            F.lit(0).alias("is_synthetic"))
    return originals.unionByName(synthetic)


def enn(df: DataFrame, id_col: str, label_col: str, vec_col: str, k: int = 3) -> DataFrame:
    """B2: edited nearest neighbours ("all" rule): keep a row only if all its k nearest rows
    (any class) share its label."""
    nb = knn(df, id_col, vec_col, k)
    lab = df.select(F.col(id_col).alias("nn_id"), F.col(label_col).alias("_nl"))
    own = df.select(F.col(id_col), F.col(label_col).alias("_ol"))
    agree = nb.join(lab, "nn_id").join(own, id_col).groupBy(id_col).agg(
        F.bool_and(F.col("_nl") == F.col("_ol")).alias("_keep"))
    return df.join(agree.where("_keep"), id_col, "left_semi")


def balanced_weights(df: DataFrame, label_col: str, out: str = "weight") -> DataFrame:
    """w_c = n / (k · n_c). Class counts are one row per class, joined (null-safe) whatever their number; up to 1,000
    are broadcast, so that the rows are not shuffled by their few classes."""
    from ..session import cut_lineage
    counts = cut_lineage(df.groupBy(F.col(label_col).alias("_class")).agg(F.count(F.lit(1)).alias("_n")))
    n, kk = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    weights = counts.select("_class", (F.lit(float(n or 0)) / (kk * F.col("_n"))).alias(out))
    weights = F.broadcast(weights) if kk <= 1000 else weights
    return df.drop(out).join(weights, F.col(label_col).eqNullSafe(F.col("_class"))).drop("_class")


def positive_weight(df: DataFrame, label_col: str, out: str = "weight") -> DataFrame:
    """Positives weighted by negatives / positives, negatives by 1."""
    r = df.agg(F.count_if(F.col(label_col) == 0).alias("neg"), F.count_if(F.col(label_col) == 1).alias("pos")).first()
    ratio = (r["neg"] / r["pos"]) if r["pos"] else 1.0
    return df.withColumn(out, F.when(F.col(label_col) == 1, F.lit(ratio)).otherwise(F.lit(1.0)))
