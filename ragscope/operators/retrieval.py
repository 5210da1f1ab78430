"""Retrieval-quality operators over a (run, retrieved item) event table.

Contract derivations C1-C5 (top-1 score, mean score, recall@k, MRR@10, relevance
flags) plus top-k helpers.  Skew: a single run may hold a large share of all
events, so nothing here sorts or collects a whole run:

* mean / count use a plain ``groupBy`` (partial aggregation before the shuffle);
* rank-based metrics only need the first ``k`` items of each run; the
  ``row_number() <= k`` filter is planned by Spark as a *WindowGroupLimit*
  that keeps at most ``k`` rows per run in every map task before the exchange,
  so the shuffled volume of a hot run is bounded by ``k × map tasks``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column],
                    k: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k inside each group by ``order_cols`` (ties broken by the given order)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def retrieval_metrics(events: DataFrame, run_col: str = "run_id", score_col: str = "score",
                      relevant_col: str = "is_relevant", rank_col: str | None = None,
                      order_cols: Sequence[Column] | None = None, doc_col: str | None = None,
                      ks: Sequence[int] = (5, 10), mrr_k: int = 10, prompt_docs: int = 3,
                      doc_sep: str = "|") -> DataFrame:
    """One row per run: n_retrieved_chunks, mean_retrieved_score, top1_score, recall_at_k,
    mrr_at_<mrr_k>, has_relevant_in_topk and (optionally) ``doc_ids_used``.

    If the events already carry a rank (1 = best), pass ``rank_col``; otherwise
    the rank is derived from ``order_cols`` (default: score descending).
    """
    kmax = max(max(ks), mrr_k, prompt_docs)
    # C2 + count over all events: partial aggregation, skew-safe.
    totals = events.groupBy(F.col(run_col).alias(run_col)).agg(
        F.count(F.lit(1)).alias("n_retrieved_chunks"),
        F.avg(F.col(score_col).cast("double")).alias("mean_retrieved_score"),
    )
    if rank_col is None:
        order = list(order_cols) if order_cols else [F.col(score_col).desc()]
        top = top_k_per_group(events, [run_col], order, kmax, "_rank")
    else:
        top = events.filter(F.col(rank_col) <= kmax).withColumnRenamed(rank_col, "_rank")
    r = F.col("_rank")
    rel = F.col(relevant_col).cast("int")
    aggs = [F.max(F.when(r == 1, F.col(score_col).cast("double"))).alias("top1_score")]
    for k in ks:
        aggs.append(F.coalesce(F.max(F.when(r <= k, rel)), F.lit(0)).cast("double").alias(f"recall_at_{k}"))
    aggs.append(F.coalesce(F.lit(1.0) / F.min(F.when((rel == 1) & (r <= mrr_k), r)), F.lit(0.0))
                .alias(f"mrr_at_{mrr_k}"))
    if doc_col is not None:
        # one plain max() per rank position keeps this a codegen'd hash aggregate (no object
        # buffers, no per-group arrays); concat_ws skips positions a short run does not have
        pos = [F.max(F.when(r == i, F.col(doc_col).cast("string"))) for i in range(1, prompt_docs + 1)]
        aggs.append(F.concat_ws(doc_sep, *pos).alias("doc_ids_used"))
    ranked = top.groupBy(F.col(run_col).alias(run_col)).agg(*aggs)
    out = totals.join(ranked, run_col, "left")
    for k in ks:
        out = out.withColumn(f"has_relevant_in_top{k}", F.col(f"recall_at_{k}").cast("int"))
    return out
