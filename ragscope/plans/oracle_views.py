"""The adapter views of ``ragscope.sources.adapters`` written as plain SQL (DuckDB dialect).

Used only by the correctness oracle: every registered query's SQL is
``WITH <these views> <query>``.  Types are cast explicitly so both engines
return the same column types (DuckDB sums integers to HUGEINT and reads
``0.3`` as DECIMAL unless told otherwise).
"""

from __future__ import annotations

from ..schema import CATEGORIES, DIFFICULTY_ORDER


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _pick(values, idx: str) -> str:
    return f"{_list(values)}[({idx}) + 1]"


EVENT_ORDER_SQL = ("l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, "
                   "l_tax, l_returnflag, l_linestatus, l_shipdate")

RETRIEVAL_EVENTS = f"""
retrieval_events AS (
  SELECT l_orderkey AS run_id, l_partkey AS doc_id,
         l_extendedprice / CAST(100000.0 AS DOUBLE) AS score,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_relevant,
         l_extendedprice, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax,
         l_returnflag, l_linestatus, l_shipdate
  FROM lineitem),
ranked_events AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {EVENT_ORDER_SQL}) AS rnk
  FROM retrieval_events),
run_metrics AS (
  SELECT run_id,
         count(*) AS n_retrieved_chunks,
         avg(score) AS mean_retrieved_score,
         max(CASE WHEN rnk = 1 THEN score END) AS top1_score,
         CAST(coalesce(max(CASE WHEN rnk <= 5 THEN is_relevant END), 0) AS DOUBLE) AS recall_at_5,
         CAST(coalesce(max(CASE WHEN rnk <= 10 THEN is_relevant END), 0) AS DOUBLE) AS recall_at_10,
         coalesce(CAST(1 AS DOUBLE) / min(CASE WHEN is_relevant = 1 AND rnk <= 10 THEN rnk END),
                  CAST(0 AS DOUBLE)) AS mrr_at_10,
         string_agg(CASE WHEN rnk <= 3 THEN CAST(doc_id AS VARCHAR) END, '|' ORDER BY rnk) AS doc_ids_used
  FROM ranked_events GROUP BY run_id)"""

_SPLIT = ("CASE WHEN ({q}) % 10 < 7 THEN 'train' WHEN ({q}) % 10 = 7 THEN 'val' ELSE 'test' END")

EVAL_RUNS = f"""
runs_cfg AS (
  SELECT o.o_orderkey AS run_id, o.o_custkey AS scenario_id, o.o_custkey % 26 AS query_id,
         {_SPLIT.format(q='o.o_custkey % 26')} AS split,
         {_pick(CATEGORIES['domain'], 'o.o_custkey % 8')} AS domain,
         {_pick(CATEGORIES['task_type'], '(o.o_custkey * 7 + 3) % 8')} AS task_type,
         CASE WHEN o.o_orderstatus = 'F' THEN '{DIFFICULTY_ORDER[0]}'
              WHEN o.o_orderstatus = 'O' THEN '{DIFFICULTY_ORDER[1]}' ELSE '{DIFFICULTY_ORDER[2]}' END AS difficulty,
         {_pick(CATEGORIES['retrieval_strategy'], 'o.o_orderkey % 5')} AS retrieval_strategy,
         {_pick(CATEGORIES['chunking_strategy'], '(o.o_orderkey + o.o_custkey) % 4')} AS chunking_strategy,
         {_pick(CATEGORIES['generator_model'], '(o.o_orderkey * 7 + o.o_custkey) % 6')} AS generator_model,
         {_pick(CATEGORIES['embedding_model'], '(o.o_orderkey + o.o_custkey * 2) % 6')} AS embedding_model,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
              ELSE {_pick(CATEGORIES['reranker_model'], '(o.o_orderkey * 13 + o.o_custkey) % 6')} END AS reranker_model,
         CASE WHEN o.o_orderkey % 17 = 0 THEN 'length' WHEN o.o_orderkey % 23 = 0 THEN 'error' ELSE 'eos' END
           AS stop_reason,
         10 + (o.o_orderkey * 37) % 490 AS answer_tokens,
         100 + (o.o_orderkey * 53 + o.o_custkey) % 1900 AS prompt_tokens,
         CASE WHEN (o.o_orderkey + o.o_custkey) % 3 = 0 THEN 4096
              WHEN (o.o_orderkey + o.o_custkey) % 3 = 1 THEN 8192 ELSE 16384 END AS context_window_tokens,
         CASE WHEN o.o_orderkey % 3 = 0 THEN 256 WHEN o.o_orderkey % 3 = 1 THEN 512 ELSE 1024 END
           AS max_new_tokens,
         CASE WHEN (o.o_orderkey + o.o_custkey) % 4 = 0 THEN CAST(0.0 AS DOUBLE)
              WHEN (o.o_orderkey + o.o_custkey) % 4 = 1 THEN CAST(0.3 AS DOUBLE)
              WHEN (o.o_orderkey + o.o_custkey) % 4 = 2 THEN CAST(0.7 AS DOUBLE)
              ELSE CAST(1.0 AS DOUBLE) END AS temperature,
         CASE WHEN o.o_custkey % 4 = 0 THEN CAST(0.8 AS DOUBLE) WHEN o.o_custkey % 4 = 1 THEN CAST(0.9 AS DOUBLE)
              WHEN o.o_custkey % 4 = 2 THEN CAST(0.95 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS top_p,
         50 + (o.o_orderkey * 31) % 450 AS latency_ms_retrieval,
         CASE WHEN o.o_custkey % 10 = 0 THEN 1 ELSE 0 END AS is_noanswer_probe,
         m.n_retrieved_chunks, m.top1_score, round(m.mean_retrieved_score, 10) AS mean_retrieved_score, m.recall_at_5, m.recall_at_10,
         m.mrr_at_10, CAST(m.recall_at_5 AS INTEGER) AS has_relevant_in_top5,
         CAST(m.recall_at_10 AS INTEGER) AS has_relevant_in_top10, m.doc_ids_used,
         o.o_orderdate AS created_at_utc
  FROM orders o LEFT JOIN run_metrics m ON m.run_id = o.o_orderkey),
runs_d1 AS (
  SELECT *,
         200 + answer_tokens * 4 + run_id * 97 % 500 AS latency_ms_generation,
         1 - is_noanswer_probe AS has_answer_in_corpus,
         CASE WHEN context_window_tokens = 16384 OR run_id % 9 = 0 THEN 1 ELSE 0 END AS used_long_context_window,
         CAST(prompt_tokens * 5 + answer_tokens * 15 AS DOUBLE) / CAST(1000000.0 AS DOUBLE) AS total_cost_usd,
         CASE WHEN (coalesce(has_relevant_in_top5, 0) = 1 AND run_id % 10 < 9
                    AND NOT (temperature = 1.0 AND run_id % 5 = 0)) OR run_id % 10 < 3 THEN 1 ELSE 0 END AS is_correct,
         'Explain ' || replace(task_type, '_', ' ') || ' question on ' || replace(domain, '_', ' ')
           || ' case ' || CAST(run_id % 97 AS VARCHAR) AS query,
         'Answer ' || CAST(run_id AS VARCHAR) AS gold_answer
  FROM runs_cfg),
runs_d2 AS (
  SELECT *,
         latency_ms_retrieval + latency_ms_generation + run_id % 50 AS total_latency_ms,
         CASE WHEN is_correct = 1 THEN 'correct' WHEN run_id % 4 = 0 THEN 'partial' ELSE 'incorrect' END
           AS correctness_label,
         CASE WHEN is_correct = 0 AND run_id % 3 <> 0 THEN 1 WHEN run_id % 29 = 0 THEN 1 ELSE 0 END
           AS hallucination_flag,
         CASE WHEN is_correct = 1 AND coalesce(recall_at_10, 0.0) = 0 AND has_answer_in_corpus = 1 THEN 1 ELSE 0 END
           AS answered_without_retrieval,
         CASE WHEN is_noanswer_probe = 1 THEN 'no_answer_probe'
              ELSE {_pick(['human_eval', 'offline_batch', 'online_shadow'], '(run_id + scenario_id) % 3')} END
           AS eval_mode,
         'CFG' || upper(substring(md5(concat_ws('|', generator_model, retrieval_strategy, chunking_strategy,
             embedding_model, coalesce(reranker_model, 'none'), CAST(max_new_tokens AS VARCHAR))), 1, 10))
           AS run_config_id
  FROM runs_d1),
eval_runs AS (
  SELECT *,
         CASE WHEN hallucination_flag = 1 THEN 'unfaithful' WHEN run_id % 7 = 0 THEN 'unknown' ELSE 'faithful' END
           AS faithfulness_label
  FROM runs_d2)"""

SCENARIOS = f"""
scenarios AS (
  SELECT c_custkey AS scenario_id, c_custkey % 26 AS query_id,
         {_pick(CATEGORIES['domain'], 'c_custkey % 8')} AS domain,
         CAST((c_custkey * 7) % 1000 AS VARCHAR) AS primary_doc_id,
         'Scenario question ' || CAST(c_custkey AS VARCHAR) AS query,
         CASE WHEN c_custkey % 10 = 0 THEN 'no_answer_probe' ELSE 'standard_qa' END AS scenario_type,
         CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 1 END AS has_answer_in_corpus,
         {_SPLIT.format(q='c_custkey % 26')} AS split,
         {_pick(DIFFICULTY_ORDER, 'c_nationkey % 3')} AS difficulty_level,
         'rag_evaluation' AS use_case
  FROM customer)"""

DOCUMENTS_DIM = """
documents_dim AS (
  SELECT CAST(p_partkey AS VARCHAR) AS doc_id, lower(p_type) AS source_type, p_size * 100 AS n_tokens,
         p_size % 10 + 1 AS n_chunks, p_brand AS owner_team
  FROM part)"""

_UNSEEN = {"domain": "finance", "task_type": "factual", "generator_model": "gpt-5",
           "chunking_strategy": "fixed_500", "eval_mode": "llm_judge"}


def _cat(name: str, idx: str) -> str:
    vals = CATEGORIES[name] + ([_UNSEEN[name]] if name in _UNSEEN else [])
    return _pick(vals, f"({idx}) % {len(vals)}")


REQUESTS = f"""
requests AS (
  SELECT event_id AS request_id,
         CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 13 = 1 THEN ''
              ELSE 'How do I ' || event_type || ' item ' || CAST(user_id AS VARCHAR) || '?' END AS query,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE {_cat('domain', 'user_id')} END AS domain,
         {_cat('task_type', 'user_id + event_id')} AS task_type,
         {_pick(DIFFICULTY_ORDER + ['extreme'], 'event_id % 4')} AS difficulty,
         {_cat('generator_model', 'event_id')} AS generator_model,
         {_cat('embedding_model', 'user_id')} AS embedding_model,
         CASE WHEN event_id % 19 = 0 THEN NULL ELSE {_cat('reranker_model', 'event_id')} END AS reranker_model,
         {_cat('retrieval_strategy', 'user_id')} AS retrieval_strategy,
         {_cat('chunking_strategy', 'event_id')} AS chunking_strategy,
         {_cat('eval_mode', 'user_id')} AS eval_mode,
         {_cat('stop_reason', 'event_id')} AS stop_reason,
         CASE WHEN event_id % 29 = 0 THEN NULL ELSE value / CAST(100.0 AS DOUBLE) END AS top1_score,
         value / CAST(200.0 AS DOUBLE) AS mean_retrieved_score,
         CASE WHEN event_id % 3 = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS recall_at_5,
         CASE WHEN event_id % 3 = 2 THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS recall_at_10,
         CAST(event_id % 11 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS mrr_at_10,
         CAST(event_id % 30 - 5 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS temperature,
         CAST(user_id % 12 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS top_p,
         CAST(user_id % 20 - 2 AS INTEGER) AS n_retrieved_chunks,
         CAST((event_id * 7) % 2000 - 100 AS INTEGER) AS prompt_tokens,
         CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST((user_id * 3) % 500 AS INTEGER) END AS answer_tokens,
         8192 AS context_window_tokens,
         CASE WHEN event_id % 2 = 0 THEN 512 ELSE 1024 END AS max_new_tokens,
         value AS latency_ms_retrieval, value * 5 AS latency_ms_generation, value * 6 + 10 AS total_latency_ms,
         value / CAST(10000.0 AS DOUBLE) AS total_cost_usd,
         CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS has_relevant_in_top5,
         CASE WHEN event_id % 3 = 2 THEN 0 ELSE 1 END AS has_relevant_in_top10,
         CASE WHEN event_id % 31 = 0 THEN NULL ELSE 1 END AS has_answer_in_corpus,
         0 AS is_noanswer_probe,
         CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS used_long_context_window,
         0 AS answered_without_retrieval,
         ts
  FROM events)"""

ALL_VIEWS = ",".join([RETRIEVAL_EVENTS, EVAL_RUNS, SCENARIOS, DOCUMENTS_DIM, REQUESTS])


def with_views(query: str) -> str:
    """Prefix a query with every adapter view (DuckDB only evaluates the ones used)."""
    q = query.strip()
    if q[:4].upper() == "WITH":
        return "WITH " + ALL_VIEWS.strip() + ",\n" + q[4:].lstrip()
    return "WITH " + ALL_VIEWS.strip() + "\n" + q
