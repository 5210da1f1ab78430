"""Model-evaluation operators over (label, prediction/score) tables.

Everything is an aggregation.  Curves and rank statistics first collapse the
rows to one row per *distinct score* (partial aggregation, so a hot score value
costs nothing extra), then need running totals in score order.  A global
``Window.orderBy`` would put every distinct score in one task, so running
totals use ``prefix_sums``: rows are range-partitioned by score, each partition
gets a local running sum, and the totals of earlier partitions are added back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ─────────────────────────────── classification ───────────────────────────────
def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """A18 long form: (actual, predicted, count) for every observed pair."""
    return df.groupBy(F.col(y).cast("string").alias("actual"), F.col(p).cast("string").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(df: DataFrame, y: str, p: str, labels: Sequence[str]) -> DataFrame:
    """A18 matrix form: one row per actual label, one column per predicted label (pivot nulls → 0)."""
    src = df.select(F.col(y).cast("string").alias("actual"), F.col(p).cast("string").alias("_p"))
    m = src.groupBy("actual").pivot("_p", list(labels)).count()
    return m.fillna(0, subset=list(labels))


def class_report(df: DataFrame, y: str, p: str, digits: int | None = 4) -> DataFrame:
    """Per-class precision / recall / F1 / support (0 on division by zero), plus the rows
    ``accuracy``, ``macro avg`` and ``weighted avg``.  Label set = union of true and predicted labels."""
    yt = F.col(y).cast("string")
    pt = F.col(p).cast("string")
    pairs = df.select(yt.alias("_y"), pt.alias("_p"))
    per_label = pairs.select(F.explode(F.array(
        F.struct(F.col("_y").alias("label"), F.lit(1).alias("is_true"), (F.col("_y") == F.col("_p")).cast("int").alias("hit"), F.lit(0).alias("is_pred")),
        F.struct(F.col("_p").alias("label"), F.lit(0).alias("is_true"), F.lit(0).alias("hit"), F.lit(1).alias("is_pred")),
    )).alias("s")).select("s.*")
    c = per_label.groupBy("label").agg(F.sum("is_true").alias("support"), F.sum("hit").alias("tp"),
                                       F.sum("is_pred").alias("n_pred"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pred").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    per = c.select("label", prec.alias("precision"), rec.alias("recall"), "support")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
    tot = per.agg(F.sum("support").alias("n"), F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
                  F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    # accuracy = Σ tp / Σ support, from the same per-label counts (no second pass over the input)
    acc = c.agg((F.sum("tp") / F.sum("support")).alias("acc"))
    summary = tot.crossJoin(acc).select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.col("acc").alias("precision"), F.col("acc").alias("recall"),
                 F.col("n").alias("support"), F.col("acc").alias("f1")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("n").alias("support"), F.col("mf").alias("f1")),
        F.struct(F.lit("weighted avg").alias("label"), (F.col("wp") / F.col("n")).alias("precision"),
                 (F.col("wr") / F.col("n")).alias("recall"), F.col("n").alias("support"),
                 (F.col("wf") / F.col("n")).alias("f1")),
    )).alias("s")).select("s.*")
    out = per.select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support")) \
        .unionByName(summary.select("label", "precision", "recall", "f1", F.col("support").cast("long")))
    if digits is not None:
        out = out.select("label", *[F.round(c, digits).alias(c) for c in ["precision", "recall", "f1"]], "support")
    return out


def accuracy(df: DataFrame, y: str, p: str) -> Column:
    """A21 as an aggregate expression."""
    return F.avg((F.col(y).cast("string") == F.col(p).cast("string")).cast("double"))


def macro_f1(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean F1 over the label set."""
    r = class_report(df, y, p, digits=None)
    return r.where(~F.col("label").isin("accuracy", "macro avg", "weighted avg")).agg(F.avg("f1").alias("f1_macro"))


# ─────────────────────────────── running totals ───────────────────────────────
def prefix_sums(df: DataFrame, order_col: str, value_cols: Sequence[str], descending: bool = False,
                inclusive: bool = True, group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact running totals of ``value_cols`` in ``order_col`` order within ``group_cols``
    (rows of a group must have distinct order values; a null group is a group).

    Adds ``cum_<v>`` (inclusive of the row, or strictly before it if ``inclusive=False``).
    A prefix scan: rows are range-partitioned by (group, order), so that a group spans as many
    partitions as it fills and small groups share one; running sums stay inside a partition; totals
    per (group, partition), a table as long as groups plus partitions, give the offsets. The number
    of partitions is the session's, which adaptive execution fits to the bytes."""
    g = list(group_cols)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    from ..session import cut_lineage
    x = cut_lineage(df.repartitionByRange(*[F.col(c) for c in g], order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy(*g, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = x.withColumns({f"_l_{v}": F.sum(v).over(w) for v in value_cols})
    totals = x.groupBy(*g, "_part").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    earlier = Window.partitionBy(*g).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_g_{c}") for c in [*g, "_part"]],
                            *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    same = [local[c].eqNullSafe(offsets[f"_g_{c}"]) for c in [*g, "_part"]]
    j = local.join(offsets, reduce(lambda a, b: a & b, same))
    cums = {f"cum_{v}": F.col(f"_o_{v}") + F.col(f"_l_{v}") - (F.lit(0) if inclusive else F.col(v))
            for v in value_cols}
    return j.withColumns(cums).drop("_part", *[f"_l_{v}" for v in value_cols], *[f"_o_{v}" for v in value_cols],
                                    *[f"_g_{c}" for c in [*g, "_part"]])


def score_counts(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct score): positives and negatives at that score (partial aggregation).

    Rows whose label is null or whose score is null or NaN say nothing about the ranking and are left out."""
    pos = (F.col(y) == 1).cast("long")
    return df.where(F.col(y).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(*group_cols, F.col(score).cast("double").alias("score")).agg(F.sum(pos).alias("n_pos"),
                                                                                   F.sum(1 - pos).alias("n_neg"))


def _counts(df: DataFrame, y: str, score: str, group_cols: Sequence[str], materialize: bool) -> DataFrame:
    """The distinct-score table is read by several branches (bounds, running sums, totals), which Spark
    would each recompute from the source; a reliable checkpoint in the shared folder computes it once."""
    sc = score_counts(df, y, score, group_cols)
    if materialize:
        from ..session import cut_lineage
        sc = cut_lineage(sc)
    return sc


# ─────────────────────────────── ranking metrics ───────────────────────────────
def roc_auc(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = (),
            materialize: bool = True) -> DataFrame:
    """ROC-AUC with ties averaged (Mann-Whitney): Σ_s pos(s)·(neg_below(s) + ½·neg(s)) / (P·N),
    per group (e.g. one row per model when several scorers are stacked); null for a group of one class."""
    g = list(group_cols)
    c = prefix_sums(_counts(df, y, score, g, materialize), "score", ["n_neg"],
                    inclusive=False, group_cols=g)
    return c.groupBy(*g).agg(F.try_divide(F.sum(F.col("n_pos") * (F.col("cum_n_neg") + 0.5 * F.col("n_neg"))),
                                          F.sum("n_pos") * F.sum("n_neg")).alias("auc"))


def curve_points(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = (),
                 materialize: bool = True) -> DataFrame:
    """Per (group, distinct score), descending: tp/fp at threshold ≥ score, totals P and N."""
    g = list(group_cols)
    sc = _counts(df, y, score, g, materialize)
    c = prefix_sums(sc, "score", ["n_pos", "n_neg"], descending=True, group_cols=g)
    tot = (sc.groupBy(*g) if g else sc).agg(F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"))
    j = c.join(tot, g) if g else c.crossJoin(F.broadcast(tot))
    return j.select(*g, F.col("score").alias("threshold"), "n_pos", "n_neg",
                    F.col("cum_n_pos").alias("tp"), F.col("cum_n_neg").alias("fp"), "P", "N")


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score plus the (inf, 0, 0) starting point."""
    pts = curve_points(df, y, score)
    body = pts.select("threshold", F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                                            F.lit(0.0).alias("tpr"))
    return body.unionByName(start)


def pr_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, precision, recall) at every distinct score plus the closing point (null, 1, 0)."""
    pts = curve_points(df, y, score)
    body = pts.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                      F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("P")).alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return body.unionByName(end)


def average_precision(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = (),
                      materialize: bool = True) -> DataFrame:
    """Σ_n (R_n − R_{n−1})·P_n over thresholds in descending score order (step sum, no interpolation)."""
    g = list(group_cols)
    pts = curve_points(df, y, score, group_cols=g, materialize=materialize)
    return pts.groupBy(*g).agg((F.sum(F.try_divide("n_pos", "P") * (F.col("tp") / (F.col("tp") + F.col("fp")))))
                               .alias("average_precision"))


def best_threshold(df: DataFrame, y: str, score: str, eps: float = 1e-8, default: float = 0.5) -> DataFrame:
    """Threshold maximising 2PR/(P+R+eps) over the PR curve; ties → lowest threshold;
    the closing point (P=1, R=0) maps to ``default``."""
    pr = pr_curve(df, y, score)
    f1 = (2 * F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall") + F.lit(eps))
    scored = pr.withColumn("f1", f1)
    # closing point sorts after every real threshold (it is the last array element in ascending order)
    key = F.struct(F.col("f1"), F.when(F.col("threshold").isNull(), F.lit(float("-inf")))
                   .otherwise(-F.col("threshold")))
    best = scored.agg(F.max_by(F.struct("threshold", "f1"), key).alias("b"))
    return best.select(F.coalesce(F.col("b.threshold"), F.lit(default)).alias("threshold"), F.col("b.f1").alias("f1"))


# ─────────────────────────────── regression ───────────────────────────────
def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """RMSE, MAE, R² = 1 − SS_res / SS_tot (null for a constant target)."""
    e = F.col(y).cast("double") - F.col(p).cast("double")
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                  (F.lit(1.0) - F.try_divide(F.sum(e * e), F.count(F.lit(1)) * F.var_pop(F.col(y).cast("double")))).alias("r2"))


# ─────────────────────────────── selection ───────────────────────────────
def best_by(df: DataFrame, group: str, item: str, metric: str, pos: str | None = None) -> DataFrame:
    """Per group, the item with the highest metric; ties → first by ``pos`` (else by item name)."""
    tie = F.col(pos) if pos else F.col(item)
    w = Window.partitionBy(group).orderBy(F.col(metric).desc(), tie.asc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_n_by_abs(df: DataFrame, key: str, name: str, value: str, n: int = 10) -> DataFrame:
    """Per key, the n entries with the largest |value| (ties → name)."""
    w = Window.partitionBy(key).orderBy(F.abs(F.col(value)).desc(), F.col(name).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
