"""Adapter views: the RAG-evaluation tables expressed over the driver's test tables.

No run log exists in the test data, so the run table, the retrieval-event table,
the scenario dimension and the document dimension are *derived by Spark* from
``orders``, ``lineitem``, ``customer`` and ``part`` with integer arithmetic on
the keys (no engine hash, no random numbers), so the same rows can be written in
plain SQL for the oracle (``ragscope.plans.oracle_views``).  Their size grows
with the input tables.

Mapping (k = o_orderkey, c = o_custkey):

* retrieval_events: one row per lineitem; run_id = l_orderkey,
  doc_id = l_partkey, score = l_extendedprice / 100000, is_relevant = (l_returnflag = 'R').
* eval_runs: one row per order; retrieval metrics C1-C5 from the events; the
  configuration columns are picked from the fixed vocabularies by arithmetic on
  k and c; labels follow deterministic rules tied to retrieval quality.
* scenarios: one row per customer; documents_dim: one row per part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import first_list_item, pick
from ..operators.retrieval import retrieval_metrics
from ..schema import CATEGORIES, DIFFICULTY_ORDER
from .tables import read_table

# Full, deterministic ranking order of a run's retrieved items (best first).
EVENT_ORDER = ["l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def event_order_cols() -> list[Column]:
    return [F.col(EVENT_ORDER[0]).desc()] + [F.col(c).asc() for c in EVENT_ORDER[1:]]


def retrieval_events(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_partkey").alias("doc_id"),
        (F.col("l_extendedprice") / F.lit(100000.0)).alias("score"),
        (F.col("l_returnflag") == F.lit("R")).cast("int").alias("is_relevant"),
        *EVENT_ORDER,
    )


def _split_of(query_id: Column) -> Column:
    m = query_id % 10
    return F.when(m < 7, F.lit("train")).when(m == 7, F.lit("val")).otherwise(F.lit("test"))


def eval_runs(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The run table (49-column contract, minus free-text-only fields) derived from orders."""
    ev = retrieval_events(lineitem)
    metrics = retrieval_metrics(ev, order_cols=event_order_cols(), doc_col="doc_id")
    k = F.col("o_orderkey")
    c = F.col("o_custkey")
    base = orders.join(metrics, orders["o_orderkey"] == metrics["run_id"], "left").drop("run_id")
    cfg = base.select(
        k.alias("run_id"),
        c.alias("scenario_id"),
        (c % 26).alias("query_id"),
        _split_of(c % 26).alias("split"),
        pick(CATEGORIES["domain"], c % 8).alias("domain"),
        pick(CATEGORIES["task_type"], (c * 7 + 3) % 8).alias("task_type"),
        F.when(F.col("o_orderstatus") == "F", F.lit(DIFFICULTY_ORDER[0]))
         .when(F.col("o_orderstatus") == "O", F.lit(DIFFICULTY_ORDER[1]))
         .otherwise(F.lit(DIFFICULTY_ORDER[2])).alias("difficulty"),
        pick(CATEGORIES["retrieval_strategy"], k % 5).alias("retrieval_strategy"),
        pick(CATEGORIES["chunking_strategy"], (k + c) % 4).alias("chunking_strategy"),
        pick(CATEGORIES["generator_model"], (k * 7 + c) % 6).alias("generator_model"),
        pick(CATEGORIES["embedding_model"], (k + c * 2) % 6).alias("embedding_model"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
         .otherwise(pick(CATEGORIES["reranker_model"], (k * 13 + c) % 6)).alias("reranker_model"),
        F.when(k % 17 == 0, F.lit("length")).when(k % 23 == 0, F.lit("error"))
         .otherwise(F.lit("eos")).alias("stop_reason"),
        (F.lit(10) + (k * 37) % 490).alias("answer_tokens"),
        (F.lit(100) + (k * 53 + c) % 1900).alias("prompt_tokens"),
        F.when((k + c) % 3 == 0, F.lit(4096)).when((k + c) % 3 == 1, F.lit(8192))
         .otherwise(F.lit(16384)).alias("context_window_tokens"),
        F.when(k % 3 == 0, F.lit(256)).when(k % 3 == 1, F.lit(512))
         .otherwise(F.lit(1024)).alias("max_new_tokens"),
        F.when((k + c) % 4 == 0, F.lit(0.0)).when((k + c) % 4 == 1, F.lit(0.3))
         .when((k + c) % 4 == 2, F.lit(0.7)).otherwise(F.lit(1.0)).alias("temperature"),
        F.when(c % 4 == 0, F.lit(0.8)).when(c % 4 == 1, F.lit(0.9))
         .when(c % 4 == 2, F.lit(0.95)).otherwise(F.lit(1.0)).alias("top_p"),
        (F.lit(50) + (k * 31) % 450).alias("latency_ms_retrieval"),
        F.when(c % 10 == 0, F.lit(1)).otherwise(F.lit(0)).alias("is_noanswer_probe"),
        "n_retrieved_chunks", "top1_score", F.round("mean_retrieved_score", 10).alias("mean_retrieved_score"),
        "recall_at_5", "recall_at_10",
        "mrr_at_10", "has_relevant_in_top5", "has_relevant_in_top10", "doc_ids_used",
        F.col("o_orderdate").alias("created_at_utc"),
    )
    r5 = F.coalesce(F.col("has_relevant_in_top5"), F.lit(0))
    k_ = F.col("run_id")
    derived = cfg.withColumns({
        "latency_ms_generation": F.lit(200) + F.col("answer_tokens") * 4 + k_ * 97 % 500,
        "has_answer_in_corpus": F.lit(1) - F.col("is_noanswer_probe"),
        "used_long_context_window": F.when((F.col("context_window_tokens") == 16384) | (k_ % 9 == 0), 1)
                                     .otherwise(0),
        "total_cost_usd": (F.col("prompt_tokens") * 5 + F.col("answer_tokens") * 15).cast("double")
                          / F.lit(1000000.0),
        "is_correct": F.when(((r5 == 1) & (k_ % 10 < 9) & ~((F.col("temperature") == 1.0) & (k_ % 5 == 0)))
                             | (k_ % 10 < 3), 1).otherwise(0),
        "query": F.concat(F.lit("Explain "), F.replace(F.col("task_type"), F.lit("_"), F.lit(" ")),
                          F.lit(" question on "), F.replace(F.col("domain"), F.lit("_"), F.lit(" ")),
                          F.lit(" case "), (k_ % 97).cast("string")),
        "gold_answer": F.concat(F.lit("Answer "), k_.cast("string")),
    })
    derived = derived.withColumns({
        "total_latency_ms": F.col("latency_ms_retrieval") + F.col("latency_ms_generation") + k_ % 50,
        "correctness_label": F.when(F.col("is_correct") == 1, F.lit("correct"))
                              .when(k_ % 4 == 0, F.lit("partial")).otherwise(F.lit("incorrect")),
        "hallucination_flag": F.when((F.col("is_correct") == 0) & (k_ % 3 != 0), 1)
                               .when(k_ % 29 == 0, 1).otherwise(0),
        "answered_without_retrieval": F.when((F.col("is_correct") == 1)
                                             & (F.coalesce(F.col("recall_at_10"), F.lit(0.0)) == 0)
                                             & (F.col("has_answer_in_corpus") == 1), 1).otherwise(0),
        "eval_mode": F.when(F.col("is_noanswer_probe") == 1, F.lit("no_answer_probe"))
                      .otherwise(pick(["human_eval", "offline_batch", "online_shadow"], (k_ + F.col("scenario_id")) % 3)),
        "run_config_id": F.concat(F.lit("CFG"), F.upper(F.substring(F.md5(F.concat_ws(
            "|", "generator_model", "retrieval_strategy", "chunking_strategy", "embedding_model",
            F.coalesce(F.col("reranker_model"), F.lit("none")), F.col("max_new_tokens").cast("string"))), 1, 10))),
    })
    derived = derived.withColumn(
        "faithfulness_label",
        F.when(F.col("hallucination_flag") == 1, F.lit("unfaithful"))
         .when(k_ % 7 == 0, F.lit("unknown")).otherwise(F.lit("faithful")))
    return derived


def scenarios(customer: DataFrame) -> DataFrame:
    cc = F.col("c_custkey")
    return customer.select(
        cc.alias("scenario_id"),
        (cc % 26).alias("query_id"),
        pick(CATEGORIES["domain"], cc % 8).alias("domain"),
        ((cc * 7) % 1000).cast("string").alias("primary_doc_id"),
        F.concat(F.lit("Scenario question "), cc.cast("string")).alias("query"),
        F.when(cc % 10 == 0, F.lit("no_answer_probe")).otherwise(F.lit("standard_qa")).alias("scenario_type"),
        F.when(cc % 10 == 0, F.lit(0)).otherwise(F.lit(1)).alias("has_answer_in_corpus"),
        _split_of(cc % 26).alias("split"),
        pick(DIFFICULTY_ORDER, F.col("c_nationkey") % 3).alias("difficulty_level"),
        F.lit("rag_evaluation").alias("use_case"),
    )


def documents_dim(part: DataFrame) -> DataFrame:
    p = F.col("p_partkey")
    return part.select(
        p.cast("string").alias("doc_id"),
        F.lower(F.col("p_type")).alias("source_type"),
        (F.col("p_size") * 100).alias("n_tokens"),
        (F.col("p_size") % 10 + 1).alias("n_chunks"),
        F.col("p_brand").alias("owner_team"),
    )


def load_adapter_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")
    return {
        "eval_runs": eval_runs(orders, lineitem),
        "retrieval_events": retrieval_events(lineitem),
        "scenarios": scenarios(read_table(spark, sf_dir, "customer")),
        "documents_dim": documents_dim(read_table(spark, sf_dir, "part")),
    }


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_runs(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"))


__all__ = ["retrieval_events", "eval_runs", "scenarios", "documents_dim", "load_adapter_tables",
           "runs", "event_order_cols", "first_list_item"]


# Extra spellings injected into requests so validation sees unseen categories / unknown difficulty.
UNSEEN = {"domain": "finance", "task_type": "factual", "generator_model": "gpt-5",
          "chunking_strategy": "fixed_500", "eval_mode": "llm_judge"}


def requests_from_events(events: DataFrame) -> DataFrame:
    """Scoring requests (E13 schema) derived from the ``events`` table: one request per event, with
    not-provided (null), empty, out-of-range, negative and unseen values at fixed residues of the ids."""
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")

    def cat(name: str, idx: Column) -> Column:
        vals = CATEGORIES[name] + ([UNSEEN[name]] if name in UNSEEN else [])
        return pick(vals, idx % len(vals))

    null_if = lambda cond, x: F.when(cond, F.lit(None)).otherwise(x)
    return events.select(
        e.alias("request_id"),
        F.when(e % 13 == 0, F.lit(None).cast("string")).when(e % 13 == 1, F.lit(""))
         .otherwise(F.concat(F.lit("How do I "), F.col("event_type"), F.lit(" item "), u.cast("string"), F.lit("?")))
         .alias("query"),
        null_if(e % 17 == 0, cat("domain", u)).alias("domain"),
        cat("task_type", u + e).alias("task_type"),
        pick(DIFFICULTY_ORDER + ["extreme"], e % 4).alias("difficulty"),
        cat("generator_model", e).alias("generator_model"),
        cat("embedding_model", u).alias("embedding_model"),
        null_if(e % 19 == 0, cat("reranker_model", e)).alias("reranker_model"),
        cat("retrieval_strategy", u).alias("retrieval_strategy"),
        cat("chunking_strategy", e).alias("chunking_strategy"),
        cat("eval_mode", u).alias("eval_mode"),
        cat("stop_reason", e).alias("stop_reason"),
        null_if(e % 29 == 0, v / F.lit(100.0)).alias("top1_score"),
        (v / F.lit(200.0)).alias("mean_retrieved_score"),
        F.when(e % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("recall_at_5"),
        F.when(e % 3 == 2, F.lit(0.0)).otherwise(F.lit(1.0)).alias("recall_at_10"),
        ((e % 11).cast("double") / F.lit(10.0)).alias("mrr_at_10"),
        (((e % 30) - 5).cast("double") / F.lit(10.0)).alias("temperature"),
        ((u % 12).cast("double") / F.lit(10.0)).alias("top_p"),
        ((u % 20) - 2).cast("int").alias("n_retrieved_chunks"),
        ((e * 7) % 2000 - 100).cast("int").alias("prompt_tokens"),
        null_if(e % 23 == 0, ((u * 3) % 500).cast("int")).alias("answer_tokens"),
        F.lit(8192).alias("context_window_tokens"),
        F.when(e % 2 == 0, F.lit(512)).otherwise(F.lit(1024)).alias("max_new_tokens"),
        v.alias("latency_ms_retrieval"),
        (v * 5).alias("latency_ms_generation"),
        (v * 6 + 10).alias("total_latency_ms"),
        (v / F.lit(10000.0)).alias("total_cost_usd"),
        F.when(e % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("has_relevant_in_top5"),
        F.when(e % 3 == 2, F.lit(0)).otherwise(F.lit(1)).alias("has_relevant_in_top10"),
        null_if(e % 31 == 0, F.lit(1)).alias("has_answer_in_corpus"),
        F.lit(0).alias("is_noanswer_probe"),
        F.when(e % 5 == 0, F.lit(1)).otherwise(F.lit(0)).alias("used_long_context_window"),
        F.lit(0).alias("answered_without_retrieval"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
