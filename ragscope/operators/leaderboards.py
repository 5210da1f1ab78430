"""Configuration rankings.

A ranking is aggregate → support filter (HAVING) → ordered limit.  The group
keys are always appended as tie-breakers, so equal metrics give one defined
order.  ``orderBy().limit()`` plans as ``TakeOrderedAndProject`` (per-partition
top-n, then a merge of n rows per partition), never a global sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import DASHBOARD_METRICS, group_metrics


def _order(order_by: Sequence[tuple[str, bool]], keys: Sequence[str]) -> list[Column]:
    cols = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order_by]
    return cols + [F.col(k).asc() for k in keys]


def leaderboard(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, tuple[str, str]] | None = None,
                min_count: int | None = 10, order_by: Sequence[tuple[str, bool]] = (("accuracy", True),),
                limit: int | None = 15, digits: int | None = 4, count_name: str = "count") -> DataFrame:
    """Top configurations by a metric among groups with enough support."""
    g = group_metrics(df, keys, metrics or DASHBOARD_METRICS, digits)
    if min_count is not None:
        g = g.where(F.col(count_name) >= min_count)          # P8
    g = g.orderBy(*_order(order_by, keys))
    return g.limit(limit) if limit is not None else g


def best_per_dimension(df: DataFrame, dims: Sequence[str], metric_col: str = "is_correct",
                       metric_name: str = "accuracy", digits: int = 4) -> DataFrame:
    """T4: the best value of each dimension by mean metric — one unpivot + one aggregation + a
    window over the (tiny) aggregated rows, instead of one scan per dimension."""
    long = df.select(F.col(metric_col), *[F.col(d).cast("string").alias(d) for d in dims]) \
        .unpivot([metric_col], list(dims), "dimension", "value").where(F.col("value").isNotNull())
    g = long.groupBy("dimension", "value").agg(F.avg(metric_col).alias(metric_name))
    w = Window.partitionBy("dimension").orderBy(F.col(metric_name).desc(), F.col("value").asc())
    return g.withColumn("_rn", F.row_number().over(w)).where("_rn = 1") \
        .select("dimension", "value", F.round(metric_name, digits).alias(metric_name))


def budget_filter(df: DataFrame, max_cost: float | Column | None = None, max_latency: float | Column | None = None,
                  cost_col: str = "avg_cost", latency_col: str = "avg_latency") -> DataFrame:
    """Keep configurations within a cost and a latency budget (both ``<=``)."""
    out = df
    if max_cost is not None:
        out = out.where(F.col(cost_col) <= (max_cost if isinstance(max_cost, Column) else F.lit(max_cost)))
    if max_latency is not None:
        out = out.where(F.col(latency_col) <= (max_latency if isinstance(max_latency, Column) else F.lit(max_latency)))
    return out


def pareto_base(df: DataFrame, keys: Sequence[str] = ("generator_model", "retrieval_strategy"),
                digits: int | None = None) -> DataFrame:
    """Per (generator, retrieval) accuracy, cost, latency, hallucination and support."""
    return group_metrics(df, keys, {
        "accuracy": ("mean", "is_correct"), "avg_cost": ("mean", "total_cost_usd"),
        "avg_latency": ("mean", "total_latency_ms"), "halluc_rate": ("mean", "hallucination_flag"),
        "count": ("count", "run_id")}, digits)


def recommendations(df: DataFrame, keys: Sequence[str] = ("generator_model", "retrieval_strategy"),
                    max_cost: float | None = None, max_latency: float | None = None, digits: int = 4) -> DataFrame:
    """T5 + P7: highest accuracy, cheapest and fastest configuration within the budget.

    Default budget = the dashboard's initial sliders: cost ≤ max(avg_cost) and
    latency ≤ floor(max(avg_latency)).  Ties → first configuration in key order.
    The budget bounds are a one-row aggregate; each pick is an ordered top-1 over the
    aggregated configurations."""
    base = pareto_base(df, keys)
    bounds = base.agg(F.max("avg_cost").alias("_mc"), F.floor(F.max("avg_latency")).alias("_ml"))
    b = base.crossJoin(F.broadcast(bounds))
    mc = F.lit(max_cost) if max_cost is not None else F.col("_mc")
    ml = F.lit(max_latency) if max_latency is not None else F.col("_ml")
    inb = budget_filter(b, mc, ml).drop("_mc", "_ml")
    picks = []
    for label, metric, desc in [("highest_accuracy", "accuracy", True), ("cheapest", "avg_cost", False),
                                ("fastest", "avg_latency", False)]:
        # distributed top-1 (TakeOrderedAndProject), ties → first configuration in key order
        picks.append(inb.orderBy(*_order([(metric, desc)], keys)).limit(1).withColumn("criterion", F.lit(label)))
    out = picks[0].unionByName(picks[1]).unionByName(picks[2])
    return out.select("criterion", *keys, *[F.round(c, digits).alias(c) for c in
                                            ["accuracy", "avg_cost", "avg_latency", "halluc_rate"]], "count")
