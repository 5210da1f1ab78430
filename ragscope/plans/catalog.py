"""Registered queries: name → (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole test tables.  Oracle SQL is written independently against the same
parquet views (adapter views prefixed by ``with_views``).  ``None`` marks a
rows-only query (model training, iterative algorithms, streaming).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import first_list_item
from ..operators import aggregates as A
from ..operators import contract as C
from ..operators import explain as XP
from ..operators import features as FE
from ..operators import joins as J
from ..operators import leaderboards as L
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import neighbors as NB
from ..operators import text as TX
from ..operators import validate as V
from ..operators.retrieval import retrieval_metrics as _retrieval_metrics
from ..schema import (ALLOWED_VALUES, BEST_OF_DIMENSIONS, BINARY_FLAGS, BREAKDOWN_DIMENSIONS, CATEGORIES, CLAMP_RULES,
                      CLUSTER_FEATURES, COST_LEAKAGE, FLAG_FEATURES, ID_PATTERNS, LABEL_ENCODED_FEATURES, LATENCY_LEAKAGE,
                      NOMINAL_FEATURES, NON_NEGATIVE_FIELDS, NUMERIC_FEATURES, REQUEST_FIELDS, reference_features)
from ..session import cut_lineage
from ..sources import adapters as AD
from ..sources import artifacts as AR
from ..sources.adapters import runs
from ..sources.artifacts import categories_dict
from ..sources.tables import read_csv_table, read_table, save_table
from ..streaming import scoring as ST
from .oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, with_views(sql) if sql is not None else None)
        return fn
    return deco


def _nn(*cols: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def _dash_aggs(digits: int = 4) -> str:
    return (f"round(avg(is_correct), {digits}) AS accuracy, round(avg(hallucination_flag), {digits}) AS halluc_rate, "
            f"round(avg(total_latency_ms), {digits}) AS avg_latency, round(avg(total_cost_usd), {digits}) AS avg_cost, "
            "count(run_id) AS count")


# ───────────────────────────── rankings (T1-T6) ─────────────────────────────
T1_KEYS = ["generator_model", "retrieval_strategy", "embedding_model"]


@register("leaderboard_top15", f"""
SELECT generator_model, retrieval_strategy, embedding_model, {_dash_aggs()}
FROM eval_runs WHERE {_nn(*T1_KEYS)}
GROUP BY generator_model, retrieval_strategy, embedding_model HAVING count(run_id) >= 10
ORDER BY accuracy DESC, generator_model, retrieval_strategy, embedding_model LIMIT 15""")
def leaderboard_top15(spark, sf):
    return L.leaderboard(runs(spark, sf), T1_KEYS, min_count=10, order_by=[("accuracy", True)], limit=15)


@register("safest_top10", f"""
SELECT generator_model, retrieval_strategy, round(avg(hallucination_flag), 4) AS halluc_rate,
       round(avg(is_correct), 4) AS accuracy, count(run_id) AS count
FROM eval_runs WHERE {_nn('generator_model', 'retrieval_strategy')}
GROUP BY generator_model, retrieval_strategy HAVING count(run_id) >= 10
ORDER BY halluc_rate, generator_model, retrieval_strategy LIMIT 10""")
def safest_top10(spark, sf):
    m = {"halluc_rate": ("mean", "hallucination_flag"), "accuracy": ("mean", "is_correct"), "count": ("count", "run_id")}
    return L.leaderboard(runs(spark, sf), ["generator_model", "retrieval_strategy"], m, 10,
                         [("halluc_rate", False)], 10)


@register("lowest_halluc5", f"""
SELECT generator_model, retrieval_strategy, round(avg(hallucination_flag), 4) AS halluc_rate
FROM eval_runs WHERE {_nn('generator_model', 'retrieval_strategy')}
GROUP BY generator_model, retrieval_strategy
ORDER BY halluc_rate, generator_model, retrieval_strategy LIMIT 5""")
def lowest_halluc5(spark, sf):
    return L.leaderboard(runs(spark, sf), ["generator_model", "retrieval_strategy"],
                         {"halluc_rate": ("mean", "hallucination_flag")}, None, [("halluc_rate", False)], 5)


@register("top10_then_safest", f"""
SELECT * FROM (
  SELECT generator_model, retrieval_strategy, embedding_model, {_dash_aggs()}
  FROM eval_runs WHERE {_nn(*T1_KEYS)}
  GROUP BY generator_model, retrieval_strategy, embedding_model HAVING count(run_id) >= 10
  ORDER BY accuracy DESC, generator_model, retrieval_strategy, embedding_model LIMIT 10)
ORDER BY halluc_rate, generator_model, retrieval_strategy, embedding_model""")
def top10_then_safest(spark, sf):
    """Top 10 by accuracy, re-sorted by hallucination rate."""
    top = L.leaderboard(runs(spark, sf), T1_KEYS, min_count=10, order_by=[("accuracy", True)], limit=10)
    return top.orderBy(F.col("halluc_rate").asc(), *[F.col(k) for k in T1_KEYS])


_BEST_DIM_SQL = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, is_correct FROM eval_runs WHERE {d} IS NOT NULL"
    for d in BEST_OF_DIMENSIONS)


@register("best_per_dimension", f"""
SELECT dimension, value, round(accuracy, 4) AS accuracy FROM (
  SELECT dimension, value, avg(is_correct) AS accuracy,
         row_number() OVER (PARTITION BY dimension ORDER BY avg(is_correct) DESC, value) AS rn
  FROM ({_BEST_DIM_SQL}) GROUP BY dimension, value) WHERE rn = 1""")
def best_per_dimension(spark, sf):
    return L.best_per_dimension(runs(spark, sf), BEST_OF_DIMENSIONS)


@register("argbest_in_budget", """
WITH p AS (
  SELECT generator_model, retrieval_strategy, avg(is_correct) AS accuracy, avg(total_cost_usd) AS avg_cost,
         avg(total_latency_ms) AS avg_latency, avg(hallucination_flag) AS halluc_rate, count(run_id) AS count
  FROM eval_runs WHERE generator_model IS NOT NULL AND retrieval_strategy IS NOT NULL
  GROUP BY generator_model, retrieval_strategy),
b AS (SELECT max(avg_cost) AS mc, floor(max(avg_latency)) AS ml FROM p),
f AS (SELECT p.* FROM p, b WHERE p.avg_cost <= b.mc AND p.avg_latency <= b.ml),
r AS (
  SELECT *, row_number() OVER (ORDER BY accuracy DESC, generator_model, retrieval_strategy) AS r_acc,
            row_number() OVER (ORDER BY avg_cost, generator_model, retrieval_strategy) AS r_cost,
            row_number() OVER (ORDER BY avg_latency, generator_model, retrieval_strategy) AS r_lat
  FROM f)
SELECT c.criterion, generator_model, retrieval_strategy, round(accuracy, 4) AS accuracy, round(avg_cost, 4) AS avg_cost,
       round(avg_latency, 4) AS avg_latency, round(halluc_rate, 4) AS halluc_rate, count
FROM r JOIN (VALUES ('highest_accuracy'), ('cheapest'), ('fastest')) c(criterion)
  ON (c.criterion = 'highest_accuracy' AND r_acc = 1) OR (c.criterion = 'cheapest' AND r_cost = 1)
  OR (c.criterion = 'fastest' AND r_lat = 1)""")
def argbest_in_budget(spark, sf):
    return L.recommendations(runs(spark, sf))


# ───────────────────────────── profiles (A1-A16) ─────────────────────────────
@register("kpis", """
SELECT count(*) AS total_runs, round(avg(is_correct), 4) AS accuracy, round(avg(hallucination_flag), 4) AS halluc_rate,
       round(avg(total_latency_ms), 4) AS avg_latency FROM eval_runs""")
def kpis(spark, sf):
    return A.kpis(runs(spark, sf))


_BREAK_SQL = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, is_correct, hallucination_flag, total_latency_ms, "
    f"total_cost_usd, run_id FROM eval_runs" for d in BREAKDOWN_DIMENSIONS)


@register("breakdown_by_dim", f"""
SELECT dimension, value, {_dash_aggs()} FROM ({_BREAK_SQL}) WHERE value IS NOT NULL GROUP BY dimension, value""")
def breakdown_by_dim(spark, sf):
    return A.breakdown_all_dims(runs(spark, sf), BREAKDOWN_DIMENSIONS)


@register("by_generator", f"""
SELECT generator_model, round(avg(is_correct), 4) AS acc, round(avg(hallucination_flag), 4) AS hal,
       round(avg(total_cost_usd), 4) AS cost, count(run_id) AS n
FROM eval_runs WHERE {_nn('generator_model')} GROUP BY generator_model""")
def by_generator(spark, sf):
    return A.group_metrics(runs(spark, sf), ["generator_model"], {
        "acc": ("mean", "is_correct"), "hal": ("mean", "hallucination_flag"), "cost": ("mean", "total_cost_usd"),
        "n": ("count", "run_id")})


@register("by_strategy", f"""
SELECT retrieval_strategy, round(avg(is_correct), 4) AS acc, round(avg(recall_at_5), 4) AS r5,
       round(avg(recall_at_10), 4) AS r10, round(avg(mrr_at_10), 4) AS mrr, round(avg(hallucination_flag), 4) AS hal
FROM eval_runs WHERE {_nn('retrieval_strategy')} GROUP BY retrieval_strategy""")
def by_strategy(spark, sf):
    return A.group_metrics(runs(spark, sf), ["retrieval_strategy"], {
        "acc": ("mean", "is_correct"), "r5": ("mean", "recall_at_5"), "r10": ("mean", "recall_at_10"),
        "mrr": ("mean", "mrr_at_10"), "hal": ("mean", "hallucination_flag")})


@register("by_domain", f"""
SELECT domain, round(avg(is_correct), 4) AS acc, round(avg(hallucination_flag), 4) AS hal, count(run_id) AS n
FROM eval_runs WHERE {_nn('domain')} GROUP BY domain""")
def by_domain(spark, sf):
    return A.group_metrics(runs(spark, sf), ["domain"], {
        "acc": ("mean", "is_correct"), "hal": ("mean", "hallucination_flag"), "n": ("count", "run_id")})


@register("pareto_base", f"""
SELECT generator_model, retrieval_strategy, round(avg(is_correct), 4) AS accuracy,
       round(avg(total_cost_usd), 4) AS avg_cost, round(avg(total_latency_ms), 4) AS avg_latency,
       round(avg(hallucination_flag), 4) AS halluc_rate, count(run_id) AS count
FROM eval_runs WHERE {_nn('generator_model', 'retrieval_strategy')} GROUP BY generator_model, retrieval_strategy""")
def pareto_base(spark, sf):
    return L.pareto_base(runs(spark, sf), digits=4)


@register("config_leaderboard_3d", f"""
SELECT generator_model, retrieval_strategy, embedding_model, {_dash_aggs()}
FROM eval_runs WHERE {_nn(*T1_KEYS)} GROUP BY generator_model, retrieval_strategy, embedding_model""")
def config_leaderboard_3d(spark, sf):
    """Every (generator, retrieval, embedding) configuration with its metrics."""
    return A.group_metrics(runs(spark, sf), T1_KEYS)


@register("null_profile", r"""
SELECT col_name, sum(v)::BIGINT AS nulls
FROM (UNPIVOT (SELECT CAST(COLUMNS('(.*)') IS NULL AS INTEGER) AS '\1' FROM eval_runs) ON COLUMNS(*) INTO NAME col_name VALUE v)
GROUP BY col_name HAVING sum(v) > 0""")
def null_profile(spark, sf):
    """A8 over all columns of the run table."""
    return A.null_profile(runs(spark, sf))


_VC_COLS = ["split", "correctness_label", "faithfulness_label", "is_correct", "hallucination_flag", "reranker_model"]


@register("value_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS col_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM eval_runs "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in _VC_COLS))
def value_counts(spark, sf):
    return A.value_counts(runs(spark, sf), _VC_COLS)


@register("class_share", """
SELECT class, count, round(count / sum(count) OVER (), 4) AS share,
       round(max(count) OVER () / min(count) OVER (), 4) AS imbalance_ratio
FROM (SELECT CAST(is_correct AS VARCHAR) AS class, count(*) AS count FROM eval_runs
      WHERE is_correct IS NOT NULL GROUP BY is_correct)""")
def class_share(spark, sf):
    return A.class_share(runs(spark, sf), "is_correct")


@register("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr "
    f"FROM eval_runs"
    for i, a in enumerate(NUMERIC_FEATURES) for j, b in enumerate(NUMERIC_FEATURES) if i > j))
def corr_matrix(spark, sf):
    return A.corr_matrix(runs(spark, sf), NUMERIC_FEATURES)


@register("latency_histogram", """
WITH b AS (SELECT min(CAST(total_latency_ms AS DOUBLE)) AS lo, max(CAST(total_latency_ms AS DOUBLE)) AS hi FROM eval_runs),
h AS (
  SELECT CAST(CASE WHEN hi - lo = 0 THEN 1
              ELSE least(50, CAST(floor((CAST(total_latency_ms AS DOUBLE) - lo) / (hi - lo) * 50) + 1 AS INTEGER)) END
              AS INTEGER) AS bin, lo, hi
  FROM eval_runs, b WHERE total_latency_ms IS NOT NULL)
SELECT bin, round(lo + (bin - 1) * (hi - lo) / 50, 6) AS bin_lo, round(lo + bin * (hi - lo) / 50, 6) AS bin_hi,
       count(*) AS count
FROM h GROUP BY bin, lo, hi""")
def latency_histogram(spark, sf):
    return A.histogram(runs(spark, sf), "total_latency_ms", 50)


@register("latency_boxplot", """
WITH q AS (
  SELECT difficulty, count(*) AS n,
         quantile_cont(CAST(total_latency_ms AS DOUBLE), 0.25) AS q1,
         quantile_cont(CAST(total_latency_ms AS DOUBLE), 0.5) AS median,
         quantile_cont(CAST(total_latency_ms AS DOUBLE), 0.75) AS q3
  FROM eval_runs WHERE difficulty IS NOT NULL AND total_latency_ms IS NOT NULL GROUP BY difficulty),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q)
SELECT f.difficulty, f.n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(min(CASE WHEN r.total_latency_ms BETWEEN lo_f AND hi_f THEN CAST(r.total_latency_ms AS DOUBLE) END), 4)
         AS whisker_lo,
       round(max(CASE WHEN r.total_latency_ms BETWEEN lo_f AND hi_f THEN CAST(r.total_latency_ms AS DOUBLE) END), 4)
         AS whisker_hi,
       count(*) FILTER (WHERE NOT (r.total_latency_ms BETWEEN lo_f AND hi_f)) AS n_outliers
FROM f JOIN eval_runs r ON r.difficulty = f.difficulty
GROUP BY f.difficulty, f.n, q1, median, q3""")
def latency_boxplot(spark, sf):
    return A.box_stats(runs(spark, sf), "difficulty", "total_latency_ms")


@register("smallest_class", """
SELECT min(n) AS min_class_size FROM (SELECT correctness_label, count(*) AS n FROM eval_runs GROUP BY correctness_label)""")
def smallest_class(spark, sf):
    return A.smallest_class(runs(spark, sf), "correctness_label")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """entry(): T1 leaderboard over the run table."""
    return leaderboard_top15(spark, sf)


# ──────────────────────── joins, keys, contract (J1, J2, F4-F6, C1-C13) ────────────────────────

_SU_SQL = """su AS (
  SELECT s.*, coalesce(c.n, 0) AS n_eval_examples, CASE WHEN coalesce(c.n, 0) > 0 THEN 1 ELSE 0 END AS is_used_in_eval
  FROM scenarios s LEFT JOIN (SELECT scenario_id, count(*) AS n FROM eval_runs GROUP BY scenario_id) c
    ON c.scenario_id = s.scenario_id)"""
_FIRST_DOC_SQL = "trim(split_part(trim(CAST({c} AS VARCHAR), '[]''\"'), '{sep}', 1))"


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """S3: runs ⟕ scenarios (with C8 usage columns) ⟕ documents."""
    r = runs(spark, sf)
    scen = C.scenario_usage(AD.scenarios(read_table(spark, sf, "customer")), r)
    return J.merge_datasets(r, scen, AD.documents_dim(read_table(spark, sf, "part")))


_ENRICHED_COLS = ["run_id", "scenario_id", "primary_doc_id", "scenario_doc_id", "scenario_type", "n_eval_examples",
                  "is_used_in_eval", "difficulty_level", "use_case", "source_type", "domain", "split"]


@register("enriched_runs", f"""
WITH {_SU_SQL}
SELECT r.run_id, r.scenario_id, {_FIRST_DOC_SQL.format(c='r.doc_ids_used', sep='|')} AS primary_doc_id,
       su.primary_doc_id AS scenario_doc_id, su.scenario_type, su.n_eval_examples, su.is_used_in_eval,
       su.difficulty_level, su.use_case, d.source_type, r.domain, r.split
FROM eval_runs r LEFT JOIN su ON su.scenario_id = r.scenario_id
LEFT JOIN documents_dim d ON d.doc_id = {_FIRST_DOC_SQL.format(c='r.doc_ids_used', sep='|')}""")
def enriched_runs(spark, sf):
    return enriched(spark, sf).select(*_ENRICHED_COLS)


def _doc_list_variants(r: DataFrame) -> DataFrame:
    d = F.col("doc_ids_used")
    m = F.col("run_id") % 5
    v = (F.when(m == 0, F.concat(F.lit("['"), F.replace(d, F.lit("|"), F.lit("', '")), F.lit("']")))
         .when(m == 1, F.lit("")).when(m == 2, F.lit(None).cast("string"))
         .when(m == 3, F.replace(d, F.lit("|"), F.lit(","))).otherwise(d))
    return r.select("run_id", v.alias("doc_list"))


@register("primary_doc_key", f"""
WITH v AS (
  SELECT run_id, CASE WHEN run_id % 5 = 0 THEN '[''' || replace(doc_ids_used, '|', ''', ''') || ''']'
                      WHEN run_id % 5 = 1 THEN '' WHEN run_id % 5 = 2 THEN NULL
                      WHEN run_id % 5 = 3 THEN replace(doc_ids_used, '|', ',') ELSE doc_ids_used END AS doc_list
  FROM eval_runs)
SELECT run_id, doc_list, {_FIRST_DOC_SQL.format(c='doc_list', sep='|')} AS primary_doc_id,
       {_FIRST_DOC_SQL.format(c='doc_list', sep=',')} AS legacy_doc_id
FROM v""")
def primary_doc_key(spark, sf):
    """First document id from a delimited list, by the contract rule ('|') and the legacy rule (',')."""
    v = _doc_list_variants(runs(spark, sf))
    return v.select("run_id", "doc_list", first_list_item("doc_list", "|").alias("primary_doc_id"),
                    first_list_item("doc_list", ",").alias("legacy_doc_id"))


@register("retrieval_metrics", """
SELECT run_id, n_retrieved_chunks, round(mean_retrieved_score, 10) AS mean_retrieved_score, top1_score,
       recall_at_5, recall_at_10, mrr_at_10, CAST(recall_at_5 AS INTEGER) AS has_relevant_in_top5,
       CAST(recall_at_10 AS INTEGER) AS has_relevant_in_top10, doc_ids_used
FROM run_metrics""")
def retrieval_metrics(spark, sf):
    """C1-C5 over the whole event table."""
    ev = AD.retrieval_events(read_table(spark, sf, "lineitem"))
    m = _retrieval_metrics(ev, order_cols=AD.event_order_cols(), doc_col="doc_id")
    # scores carry 7 decimals and a run has few items, so 10 digits never lands on a rounding tie
    return m.withColumn("mean_retrieved_score", F.round("mean_retrieved_score", 10))


@register("answered_without_retrieval", """
SELECT run_id, CASE WHEN is_correct = 1 AND coalesce(recall_at_10, 0.0) = 0 AND has_answer_in_corpus = 1
                    THEN 1 ELSE 0 END AS answered_without_retrieval
FROM eval_runs""")
def answered_without_retrieval(spark, sf):
    return runs(spark, sf).select("run_id", C.answered_without_retrieval().alias("answered_without_retrieval"))


@register("latency_consistency", """
SELECT count(*) AS n_runs,
       count(*) FILTER (WHERE total_latency_ms < latency_ms_retrieval + latency_ms_generation) AS n_violations,
       round(avg(CAST(total_latency_ms - latency_ms_retrieval - latency_ms_generation AS DOUBLE)), 4) AS avg_overhead,
       min(CAST(total_latency_ms - latency_ms_retrieval - latency_ms_generation AS DOUBLE)) AS min_overhead,
       max(CAST(total_latency_ms - latency_ms_retrieval - latency_ms_generation AS DOUBLE)) AS max_overhead
FROM eval_runs""")
def latency_consistency(spark, sf):
    return C.latency_consistency(runs(spark, sf))


@register("scenario_usage", f"""
WITH {_SU_SQL}
SELECT scenario_id, split, n_eval_examples, is_used_in_eval FROM su""")
def scenario_usage(spark, sf):
    scen = AD.scenarios(read_table(spark, sf, "customer"))
    return C.scenario_usage(scen, runs(spark, sf)).select("scenario_id", "split", "n_eval_examples", "is_used_in_eval")


@register("split_leak_check", """
SELECT count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_leaking_keys
FROM (SELECT query_id, count(DISTINCT split) AS n FROM eval_runs GROUP BY query_id)""")
def split_leak_check(spark, sf):
    return C.split_leak_check(runs(spark, sf))


_CFG_COLS = ["generator_model", "retrieval_strategy", "chunking_strategy", "embedding_model", "reranker_model",
             "max_new_tokens"]


@register("config_id", """
SELECT 'CFG' || upper(substring(md5(concat_ws('|', generator_model, retrieval_strategy, chunking_strategy,
         embedding_model, coalesce(reranker_model, 'none'), CAST(max_new_tokens AS VARCHAR))), 1, 10)) AS run_config_id,
       count(*) AS n_runs
FROM eval_runs GROUP BY 1""")
def config_id(spark, sf):
    """C11: deterministic configuration ids and the number of runs of each."""
    return runs(spark, sf).groupBy(C.config_id(_CFG_COLS).alias("run_config_id")) \
        .agg(F.count(F.lit(1)).alias("n_runs"))


_DICT_ALLOWED = {**ALLOWED_VALUES, **CATEGORIES}
#: The identifiers as the dictionary writes them, by SQL that both engines read.
_DICT_CODES = {"doc_id": "'DOC' || primary_doc_id", "chunk_id": "'C' || CAST(run_id % 120000 AS VARCHAR)", "run_id": "'run_' || CAST(run_id AS VARCHAR)",
               "example_id": "'QA' || lpad(CAST(run_id % 1000000 AS VARCHAR), 6, '0')", "scenario_id": "'SC' || lpad(CAST(scenario_id AS VARCHAR), 4, '0')",
               "query_id": "'Q' || lpad(CAST(query_id AS VARCHAR), 4, '0')"}
_DICT_PATTERNS = {f"{c}_code" if c in _DICT_CODES else c: rx for c, rx in ID_PATTERNS.items()}


def _dict_sql() -> str:
    parts = []
    for c, vals in _DICT_ALLOWED.items():
        lst = ", ".join(f"'{v}'" for v in vals)
        parts.append(f"SELECT 'allowed_values' AS rule, '{c}' AS col_name, count(*) FILTER "
                     f"(WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) NOT IN ({lst})) AS violations FROM r")
    for c, rx in _DICT_PATTERNS.items():
        parts.append(f"SELECT 'pattern' AS rule, '{c}' AS col_name, count(*) FILTER "
                     f"(WHERE {c} IS NOT NULL AND NOT regexp_matches(CAST({c} AS VARCHAR), '{rx}')) AS violations FROM r")
    for c in BINARY_FLAGS:
        parts.append(f"SELECT 'binary_flag' AS rule, '{c}' AS col_name, count(*) FILTER "
                     f"(WHERE {c} IS NOT NULL AND {c} NOT IN (0, 1)) AS violations FROM r")
    parts.append("SELECT 'numeric_cast' AS rule, 'primary_doc_id' AS col_name, count(*) FILTER "
                 "(WHERE primary_doc_id IS NOT NULL AND TRY_CAST(primary_doc_id AS DOUBLE) IS NULL) AS violations FROM r")
    codes = ", ".join(f"{sql} AS {c}_code" for c, sql in _DICT_CODES.items())
    return (f"WITH q AS (SELECT *, {_FIRST_DOC_SQL.format(c='doc_ids_used', sep='|')} AS primary_doc_id FROM eval_runs),\n"
            f"r AS (SELECT *, {codes} FROM q)\n"
            + "\nUNION ALL ".join(parts))


@register("dictionary_violations", _dict_sql())
def dictionary_violations(spark, sf):
    r = runs(spark, sf).withColumn("primary_doc_id", first_list_item("doc_ids_used", "|"))
    r = r.select("*", *[F.expr(sql.replace("VARCHAR", "STRING")).alias(f"{c}_code") for c, sql in _DICT_CODES.items()])
    return C.dictionary_violations(r, _DICT_ALLOWED, _DICT_PATTERNS, BINARY_FLAGS, ["primary_doc_id"])


@register("failure_modes", """
SELECT CASE WHEN hallucination_flag = 1 AND coalesce(has_relevant_in_top10, 0) = 0 THEN 'no_relevant_chunk_hallucinated'
            WHEN hallucination_flag = 1 AND is_noanswer_probe = 1 THEN 'noanswer_probe_hallucinated'
            WHEN hallucination_flag = 1 THEN 'other_hallucination' ELSE 'no_hallucination' END AS failure_mode,
       count(*) AS count
FROM eval_runs GROUP BY 1""")
def failure_modes(spark, sf):
    return runs(spark, sf).groupBy(C.failure_mode().alias("failure_mode")).agg(F.count(F.lit(1)).alias("count"))


# ─────────────────────── features, validation, requests (E1-E13, P5, P10) ───────────────────────

_ORD_SQL = ("CASE {c} WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 WHEN 'hard' THEN 2 ELSE 1 END")


def _onehot_sql(cats=CATEGORIES) -> list[str]:
    return [f"CASE WHEN CAST({c} AS VARCHAR) = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, vals in cats.items()
            for v in vals]


def _interactions_sql(ord_expr: str) -> list[str]:
    return [f"top1_score * {ord_expr} AS retrieval_x_difficulty",
            "recall_at_5 * n_retrieved_chunks AS recall5_x_nchunks",
            "top1_score - mean_retrieved_score AS score_gap",
            "CAST(latency_ms_generation AS DOUBLE) / CAST(latency_ms_retrieval + 1 AS DOUBLE) AS latency_ratio",
            "CAST(total_cost_usd AS DOUBLE) / CAST(prompt_tokens + answer_tokens + 1 AS DOUBLE) AS cost_per_token"]


_WORDS_SQL = "CAST(len(regexp_extract_all({c}, '\\S+')) AS INTEGER)"


@register("one_hot", f"SELECT run_id, {', '.join(_onehot_sql())} FROM eval_runs")
def one_hot(spark, sf):
    """E2 with the vocabulary learned from the data."""
    r = runs(spark, sf)
    return r.select("run_id", *FE.one_hot_exprs(categories_dict(r)))


@register("label_encode", "SELECT run_id, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({c} AS VARCHAR), 'nan')) - 1 AS INTEGER) AS {c}_enc"
    for c in LABEL_ENCODED_FEATURES) + " FROM eval_runs")
def label_encode(spark, sf):
    """Notebook-style alphabetical codes for the 10 categorical columns."""
    return FE.label_encode(runs(spark, sf), LABEL_ENCODED_FEATURES).select(
        "run_id", *[f"{c}_enc" for c in LABEL_ENCODED_FEATURES])


@register("target_codes", """
SELECT correctness_label, CAST(dense_rank() OVER (ORDER BY correctness_label) - 1 AS INTEGER) AS label_index, n
FROM (SELECT correctness_label, count(*) AS n FROM eval_runs GROUP BY correctness_label)""")
def target_codes(spark, sf):
    """Target label ↔ integer code (alphabetical), with class sizes."""
    enc = FE.label_encode(runs(spark, sf).select("correctness_label"), ["correctness_label"], "_idx")
    return enc.groupBy("correctness_label", F.col("correctness_label_idx").alias("label_index")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("target_inverse", """
SELECT run_id, correctness_label, CAST(dense_rank() OVER (ORDER BY correctness_label) - 1 AS INTEGER) AS label_index,
       correctness_label AS decoded FROM eval_runs WHERE correctness_label IS NOT NULL""")
def target_inverse(spark, sf):
    """E7 both ways: labels to codes, and codes back to labels by the dictionary."""
    r = runs(spark, sf).select("run_id", "correctness_label").where("correctness_label IS NOT NULL")
    enc = FE.label_encode(r, ["correctness_label"], "_idx").withColumnRenamed("correctness_label_idx", "label_index")
    return FE.decode(enc, "correctness_label", FE.dictionary(r, ["correctness_label"]), "label_index", "decoded")


@register("encode_customers", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name_enc,
       CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment_enc,
       [CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER),
        CAST((SELECT count(DISTINCT c_name) FROM customer) + dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER)] AS slots
FROM customer""")
def encode_customers(spark, sf):
    """E2 / E6 over a vocabulary that grows with the input (customer names): a joined dictionary."""
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return FE.one_hot_slots(FE.label_encode(c, ["c_name", "c_mktsegment"]), ["c_name", "c_mktsegment"]) \
        .select("c_custkey", "c_name_enc", "c_mktsegment_enc", "slots")


@register("csv_round_trip", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' ELSE md5(text || '"' || chr(10) || ',') END AS digest, source, n_chars
FROM documents""")
def csv_round_trip(spark, sf):
    """S1 + S4: documents with quotes, commas, line breaks, empty and null texts written as CSV and read back strictly."""
    d = read_table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat("text", F.lit('"\n,'))).alias("text"),
        "source", "n_chars")
    path = save_table(d, ST.stream_paths(spark, "csv")[0], "csv")
    back = read_csv_table(spark, path, d.schema)
    return back.select("doc_id", F.when(F.col("text") == "", F.lit("")).otherwise(F.md5(F.col("text").cast("binary"))).alias("digest"), "source", "n_chars")


@register("interactions", f"""
SELECT run_id, {_ORD_SQL.format(c='difficulty')} AS difficulty_ord,
       {', '.join(_interactions_sql(_ORD_SQL.format(c='difficulty')))} FROM eval_runs""")
def interactions(spark, sf):
    """E3 + E4: ordinal difficulty and the five interaction features."""
    ordc = FE.difficulty_ord()
    return runs(spark, sf).select("run_id", ordc, *FE.interaction_exprs())


@register("text_features", f"""
SELECT run_id, CAST(length(query) AS INTEGER) AS query_len, {_WORDS_SQL.format(c='query')} AS query_word_count
FROM eval_runs""")
def text_features(spark, sf):
    """E5 / F1 / F2 on the run queries."""
    return runs(spark, sf).select("run_id", *FE.text_exprs("query"))


@register("doc_text_stats", f"""
SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars_text, {_WORDS_SQL.format(c='text')} AS n_words
FROM documents""")
def doc_text_stats(spark, sf):
    """F1 / F2 over whole document texts."""
    from ..functions.scalar import char_length, word_count
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", char_length("text").alias("n_chars_text"), word_count("text").alias("n_words"))


def _features_sql() -> str:
    ordx = _ORD_SQL.format(c="difficulty")
    cols = (NUMERIC_FEATURES + FLAG_FEATURES + [f"{ordx} AS difficulty_ord"] + _onehot_sql()
            + _interactions_sql(ordx)
            + ["CAST(length(query) AS INTEGER) AS query_len", f"{_WORDS_SQL.format(c='query')} AS query_word_count"])
    return "SELECT run_id, " + ", ".join(cols) + " FROM eval_runs"


@register("features_full", _features_sql())
def features_full(spark, sf):
    """The 80-column feature table (vocabulary learned from the data)."""
    df, names = FE.engineer_features(runs(spark, sf), keep=["run_id"])
    return df.select("run_id", *[F.col(f"`{n}`") for n in names])


@register("split_counts", f"""
SELECT split, count(*) AS n_rows, {len(reference_features())} AS n_features FROM eval_runs GROUP BY split""")
def split_counts(spark, sf):
    """P5: rows per split and the width of the feature matrix."""
    r = runs(spark, sf)
    _, names = FE.engineer_features(r, keep=["run_id"])
    return FE.split_counts(r, len(names))


@register("zscore", "WITH st AS (SELECT " + ", ".join(
    f"avg(CAST(coalesce({c}, 0) AS DOUBLE)) AS m_{c}, stddev_pop(CAST(coalesce({c}, 0) AS DOUBLE)) AS s_{c}"
    for c in CLUSTER_FEATURES) + " FROM eval_runs)\nSELECT run_id, " + ", ".join(
    f"round((CAST(coalesce({c}, 0) AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END, 8) AS {c}_z"
    for c in CLUSTER_FEATURES) + " FROM eval_runs, st")
def zscore(spark, sf):
    """Population z-scores of the clustering inputs (rounded to 8 decimals)."""
    z = FE.zscore(runs(spark, sf), CLUSTER_FEATURES)
    return z.select("run_id", *[F.round(f"{c}_z", 8).alias(f"{c}_z") for c in CLUSTER_FEATURES])


def _sq(s: str) -> str:
    return s.replace("'", "''")


def _validate_parts():
    """SQL pieces of E12: (warning expressions in order, sanitized column expressions)."""
    warns, fixed = [], {}
    for f, lo, hi in CLAMP_RULES:
        bad = f"({f} IS NOT NULL AND NOT isnan({f}) AND ({f} < {lo} OR {f} > {hi}))"
        clamped = f"greatest(CAST({lo} AS DOUBLE), least(CAST({hi} AS DOUBLE), {f}))"
        warns.append(f"CASE WHEN {bad} THEN '{f}=' || CAST({f} AS VARCHAR) || ' clamped to [{lo},{hi}] → ' "
                     f"|| CAST({clamped} AS VARCHAR) END")
        fixed[f] = f"CASE WHEN {bad} THEN {clamped} ELSE {f} END"
    for f in NON_NEGATIVE_FIELDS:
        warns.append(f"CASE WHEN {f} < 0 THEN '{f}=' || CAST({f} AS VARCHAR) || ' is negative, set to 0' END")
        fixed[f] = f"CASE WHEN {f} < 0 THEN 0 ELSE {f} END"
    for c, vals in CATEGORIES.items():
        lst = ", ".join(f"'{v}'" for v in vals)
        pylist = _sq("[" + ", ".join(f"'{v}'" for v in vals) + "]")
        warns.append(f"CASE WHEN {c} IS NOT NULL AND {c} <> '' AND {c} NOT IN ({lst}) THEN '{c}=''' || {c} || "
                     f"''' is unseen (valid: {pylist}); all one-hot columns will be 0 (safe fallback)' END")
    anynull = " OR ".join(f"{f} IS NULL" for f in V.EXPECTED_FIELDS)
    names = ", ".join(f"CASE WHEN {f} IS NULL THEN '''{f}''' END" for f in V.EXPECTED_FIELDS)
    warns.append(f"CASE WHEN {anynull} THEN 'Defaulted fields: [' || concat_ws(', ', {names}) || ']' END")
    return warns, fixed


_VAL_OUT = ["top1_score", "temperature", "top_p", "n_retrieved_chunks", "prompt_tokens"]


def _validate_sql() -> str:
    warns, fixed = _validate_parts()
    return (f"SELECT request_id, concat_ws('; ', {', '.join(warns)}) AS warnings_text, "
            f"CAST({' + '.join(f'(({w}) IS NOT NULL)::INTEGER' for w in warns)} AS INTEGER) AS n_warnings, "
            + ", ".join(f"{fixed[c]} AS {c}" for c in _VAL_OUT) + " FROM requests")


@register("validate_requests", _validate_sql())
def validate_requests(spark, sf):
    """E12 + U4 over a batch of requests."""
    req = AD.requests_from_events(read_table(spark, sf, "events"))
    v = V.validate_requests(req)
    return v.select("request_id", F.array_join("warnings", "; ").alias("warnings_text"),
                    F.size("warnings").alias("n_warnings"), *_VAL_OUT)


def _request_features_sql() -> str:
    _, fixed = _validate_parts()
    sanit = ", ".join(f"{fixed[c]} AS {c}" for c in fixed)
    others = [n for n, _, _ in REQUEST_FIELDS if n not in fixed]
    defaults = []
    for n, t, d in REQUEST_FIELDS:
        typ = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER"}[t]
        lit = f"'{_sq(d)}'" if t == "string" else f"CAST({d} AS {typ})"
        defaults.append(f"coalesce(CAST({n} AS {typ}), {lit}) AS {n}")
    ordx = _ORD_SQL.format(c="coalesce(difficulty, 'medium')")
    feats = ([f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in NUMERIC_FEATURES]
             + [f"coalesce(CAST({c} AS INTEGER), 0) AS {c}" for c in FLAG_FEATURES]
             + [f"{ordx} AS difficulty_ord"] + _onehot_sql()
             + [f"n.top1_score * ({ordx}) AS retrieval_x_difficulty",
                "recall_at_5 * n_retrieved_chunks AS recall5_x_nchunks",
                "top1_score - mean_retrieved_score AS score_gap",
                "latency_ms_generation / (latency_ms_retrieval + 1) AS latency_ratio",
                "total_cost_usd / (prompt_tokens + answer_tokens + 1) AS cost_per_token",
                "CAST(coalesce(length(query), 0) AS INTEGER) AS query_len",
                f"CAST(coalesce({_WORDS_SQL.format(c='query')}, 0) AS INTEGER) AS query_word_count"])
    return (f"WITH s AS (SELECT request_id, {sanit}, {', '.join(others)} FROM requests),\n"
            f"d AS (SELECT request_id, {', '.join(defaults)} FROM s),\n"
            f"n AS (SELECT request_id, query, difficulty, {', '.join(CATEGORIES)}, "
            + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in NUMERIC_FEATURES)
            + ", " + ", ".join(FLAG_FEATURES) + " FROM d)\n"
            f"SELECT request_id, {', '.join(feats)} FROM n")


@register("request_features", _request_features_sql())
def request_features(spark, sf):
    """E11 + E12 + E13: validated, defaulted requests → the 80 trained features (saved vocabulary)."""
    req = AD.requests_from_events(read_table(spark, sf, "events"))
    ready = V.apply_defaults(V.validate_requests(req))
    return V.transform_requests(ready, reference_features(), CATEGORIES, keep=["request_id"])


# ─────────────────────────── evaluation metrics (A18-A26, W2-W6, U2) ───────────────────────────

_SCORE = "coalesce(top1_score, 0.0)"
_MC_PRED = ("CASE WHEN coalesce(top1_score, 0.0) >= 0.6 THEN 'correct' WHEN coalesce(top1_score, 0.0) >= 0.3 "
            "THEN 'partial' ELSE 'incorrect' END")


def _scored(spark, sf) -> DataFrame:
    """Fixed predictions over the run table: retrieval score as a correctness score, rule labels."""
    r = runs(spark, sf)
    s = F.coalesce(F.col("top1_score"), F.lit(0.0))
    return r.select("run_id", "is_correct", "correctness_label", "total_latency_ms", "latency_ms_retrieval",
                    "latency_ms_generation", "mean_retrieved_score", "mrr_at_10", "recall_at_5",
                    s.alias("score"), (s >= 0.5).cast("int").alias("pred"),
                    F.when(s >= 0.6, "correct").when(s >= 0.3, "partial").otherwise("incorrect").alias("pred_label"))


@register("confusion", f"""
SELECT CAST(is_correct AS VARCHAR) AS actual, CAST(CAST({_SCORE} >= 0.5 AS INTEGER) AS VARCHAR) AS predicted,
       count(*) AS count FROM eval_runs GROUP BY 1, 2""")
def confusion(spark, sf):
    return M.confusion(_scored(spark, sf), "is_correct", "pred")


@register("confusion_matrix_mc", f"""
SELECT correctness_label AS actual,
       count(*) FILTER (WHERE ({_MC_PRED}) = 'correct') AS correct,
       count(*) FILTER (WHERE ({_MC_PRED}) = 'incorrect') AS incorrect,
       count(*) FILTER (WHERE ({_MC_PRED}) = 'partial') AS partial
FROM eval_runs GROUP BY correctness_label""")
def confusion_matrix_mc(spark, sf):
    """A18 pivot form, 3 classes, missing cells filled with 0."""
    return M.confusion_matrix(_scored(spark, sf), "correctness_label", "pred_label", ["correct", "incorrect", "partial"])


def _class_report_sql(y: str, p: str) -> str:
    return f"""
WITH d AS (SELECT CAST({y} AS VARCHAR) AS y, CAST({p} AS VARCHAR) AS p FROM eval_runs),
lab AS (SELECT y AS label FROM d UNION SELECT p FROM d),
c AS (SELECT label, (SELECT count(*) FROM d WHERE d.y = lab.label) AS support,
             (SELECT count(*) FROM d WHERE d.y = lab.label AND d.p = lab.label) AS tp,
             (SELECT count(*) FROM d WHERE d.p = lab.label) AS n_pred FROM lab),
per AS (SELECT label, CASE WHEN n_pred = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / n_pred END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall, support FROM c),
per2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
         FROM per),
acc AS (SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM d)
SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
       CAST(support AS BIGINT) AS support FROM per2
UNION ALL SELECT 'accuracy', round(a, 4), round(a, 4), round(a, 4), n FROM acc
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4),
                 CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4),
                 round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4),
                 CAST(sum(support) AS BIGINT) FROM per2"""


@register("class_report", _class_report_sql("correctness_label", _MC_PRED))
def class_report(spark, sf):
    """3-class report of rule predictions vs correctness labels."""
    return M.class_report(_scored(spark, sf), "correctness_label", "pred_label")


@register("class_report_binary", _class_report_sql("is_correct", f"CAST({_SCORE} >= 0.5 AS INTEGER)"))
def class_report_binary(spark, sf):
    """A19 + A25 (minority-class recall is the row of label 0)."""
    return M.class_report(_scored(spark, sf), "is_correct", "pred")


def _auc_sql(score: str) -> str:
    return f"""(
  SELECT round((sum(ar) FILTER (WHERE y = 1) - CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE)
               * (count(*) FILTER (WHERE y = 1) + 1) / 2)
               / (CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) * count(*) FILTER (WHERE y = 0)), 10)
  FROM (SELECT is_correct AS y,
               rank() OVER (ORDER BY {score}) + CAST(count(*) OVER (PARTITION BY {score}) - 1 AS DOUBLE) / 2 AS ar
        FROM eval_runs))"""


def _ap_sql(score: str) -> str:
    return f"""(
  SELECT round(sum(CAST(n_pos AS DOUBLE) / P * (CAST(tp AS DOUBLE) / (tp + fp))), 10)
  FROM (SELECT n_pos, sum(n_pos) OVER (ORDER BY s DESC) AS tp, sum(n_neg) OVER (ORDER BY s DESC) AS fp,
               sum(n_pos) OVER () AS P
        FROM (SELECT CAST({score} AS DOUBLE) AS s, sum(is_correct) AS n_pos, sum(1 - is_correct) AS n_neg
              FROM eval_runs GROUP BY 1)))"""


@register("roc_auc", f"SELECT {_auc_sql(_SCORE)} AS auc")
def roc_auc(spark, sf):
    """Tie-averaged ROC-AUC of the retrieval score for correctness."""
    return M.roc_auc(_scored(spark, sf), "is_correct", "score").select(F.round("auc", 10).alias("auc"))


@register("avg_precision", f"SELECT {_ap_sql(_SCORE)} AS average_precision")
def avg_precision(spark, sf):
    """Average precision (step sum)."""
    return M.average_precision(_scored(spark, sf), "is_correct", "score") \
        .select(F.round("average_precision", 10).alias("average_precision"))


_CURVE_SQL = f"""
WITH c AS (SELECT CAST({_SCORE} AS DOUBLE) AS s, sum(is_correct) AS n_pos, sum(1 - is_correct) AS n_neg
           FROM eval_runs GROUP BY 1),
k AS (SELECT s, sum(n_pos) OVER (ORDER BY s DESC) AS tp, sum(n_neg) OVER (ORDER BY s DESC) AS fp,
             sum(n_pos) OVER () AS P, sum(n_neg) OVER () AS N FROM c)"""


@register("roc_curve", _CURVE_SQL + """
SELECT s AS threshold, CAST(fp AS DOUBLE) / N AS fpr, CAST(tp AS DOUBLE) / P AS tpr FROM k
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def roc_curve(spark, sf):
    """Every distinct threshold (no intermediate points dropped) plus the starting point."""
    return M.roc_curve(_scored(spark, sf), "is_correct", "score")


@register("pr_curve", _CURVE_SQL + """
SELECT s AS threshold, CAST(tp AS DOUBLE) / (tp + fp) AS precision,
       CASE WHEN P = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / P END AS recall FROM k
UNION ALL SELECT NULL, 1.0, 0.0""")
def pr_curve(spark, sf):
    """precision/recall at every distinct threshold plus the closing point (1, 0)."""
    return M.pr_curve(_scored(spark, sf), "is_correct", "score")


@register("best_threshold", _CURVE_SQL + """,
pr AS (SELECT s AS threshold, CAST(tp AS DOUBLE) / (tp + fp) AS precision,
              CASE WHEN P = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / P END AS recall FROM k
       UNION ALL SELECT NULL, 1.0, 0.0),
f AS (SELECT threshold, 2 * precision * recall / (precision + recall + CAST(1e-8 AS DOUBLE)) AS f1 FROM pr)
SELECT coalesce(threshold, 0.5) AS threshold, round(f1, 10) AS f1 FROM f
ORDER BY f1 DESC, threshold ASC NULLS LAST LIMIT 1""")
def best_threshold(spark, sf):
    """F1-optimal threshold on the PR curve (ties → lowest threshold)."""
    return M.best_threshold(_scored(spark, sf), "is_correct", "score").select(
        "threshold", F.round("f1", 10).alias("f1"))


@register("regression_metrics", """
SELECT round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae,
       round(1 - sum(e * e) / (count(*) * var_pop(y)), 8) AS r2
FROM (SELECT CAST(total_latency_ms AS DOUBLE) AS y,
             CAST(total_latency_ms AS DOUBLE) - CAST(latency_ms_retrieval + latency_ms_generation AS DOUBLE) AS e
      FROM eval_runs)""")
def regression_metrics(spark, sf):
    """RMSE / MAE / R² of (retrieval + generation) as a predictor of total latency."""
    d = _scored(spark, sf).withColumn("pred", (F.col("latency_ms_retrieval") + F.col("latency_ms_generation"))
                                      .cast("double"))
    m = M.regression_metrics(d, "total_latency_ms", "pred")
    return m.select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), F.round("r2", 8).alias("r2"))


_PREDICTORS = [("top1_score", "coalesce(top1_score, 0.0)"), ("mean_retrieved_score", "coalesce(mean_retrieved_score, 0.0)"),
               ("mrr_at_10", "coalesce(mrr_at_10, 0.0)"), ("recall_at_5", "coalesce(recall_at_5, 0.0)")]


def _comparison(spark, sf) -> DataFrame:
    """All scorers stacked in long form (model, label, score) → AUC and AP per model in one pass each."""
    r = runs(spark, sf)
    names = [n for n, _ in _PREDICTORS]
    long = r.select("is_correct", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names]) \
        .unpivot(["is_correct"], names, "model", "score")
    counts = M.score_counts(long, "is_correct", "score", ["model"])
    from ..session import cut_lineage
    counts = cut_lineage(counts.withColumnRenamed("score", "s"))
    # counts are already per (model, distinct score): feed them back as weighted rows
    auc = M.prefix_sums(counts.withColumnRenamed("s", "score"), "score", ["n_neg"], inclusive=False,
                        group_cols=["model"]).groupBy("model").agg(
        (F.sum(F.col("n_pos") * (F.col("cum_n_neg") + 0.5 * F.col("n_neg")))
         / (F.sum("n_pos") * F.sum("n_neg"))).alias("auc"))
    c = counts.withColumnRenamed("s", "score")
    cum = M.prefix_sums(c, "score", ["n_pos", "n_neg"], descending=True, group_cols=["model"])
    tot = c.groupBy("model").agg(F.sum("n_pos").alias("P"))
    ap = cum.join(tot, "model").groupBy("model").agg(
        F.sum(F.col("n_pos") / F.col("P") * (F.col("cum_n_pos") / (F.col("cum_n_pos") + F.col("cum_n_neg"))))
        .alias("average_precision"))
    pos = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return auc.join(ap, "model").select("model", F.lit("Correctness").alias("task"),
                                        F.element_at(pos, F.col("model")).alias("pos"),
                                        F.round("auc", 10).alias("auc"),
                                        F.round("average_precision", 10).alias("average_precision"))


@register("auc_edge_groups", """
WITH s AS (
  SELECT 'all' AS grp, is_correct AS y, CASE WHEN run_id % 7 <> 0 THEN top1_score END AS s FROM eval_runs
  UNION ALL SELECT 'one class', is_correct, top1_score FROM eval_runs WHERE is_correct = 1
  UNION ALL SELECT NULL, is_correct, mrr_at_10 FROM eval_runs),
c AS (SELECT grp, s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM s
      WHERE s IS NOT NULL AND y IS NOT NULL GROUP BY grp, s),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY grp ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT grp, round(CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (below + 0.5 * n)) / (sum(p) * sum(n)) END, 10) AS auc FROM b GROUP BY grp""")
def auc_edge_groups(spark, sf):
    """A22 per group: with null scores, of one class (null), and of a null group."""
    r = runs(spark, sf).select("run_id", "is_correct", "top1_score", "mrr_at_10")
    some = r.select(F.lit("all").alias("grp"), "is_correct", F.when(F.col("run_id") % 7 != 0, F.col("top1_score")).alias("s"))
    ones = r.where("is_correct = 1").select(F.lit("one class"), "is_correct", "top1_score")
    none = r.select(F.lit(None).cast("string"), "is_correct", "mrr_at_10")
    auc = M.roc_auc(some.union(ones).union(none), "is_correct", "s", group_cols=["grp"])
    return auc.select("grp", F.round("auc", 10).alias("auc"))


_COMPARISON_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS model, 'Correctness' AS task, {i} AS pos, {_auc_sql(e)} AS auc, {_ap_sql(e)} AS average_precision"
    for i, (n, e) in enumerate(_PREDICTORS))


@register("model_comparison", _COMPARISON_SQL)
def model_comparison(spark, sf):
    """One result table stacked from several scorers of the same task."""
    return _comparison(spark, sf)


@register("best_model", f"""
SELECT task, model, auc FROM (
  SELECT *, row_number() OVER (PARTITION BY task ORDER BY auc DESC, pos) AS rn FROM ({_COMPARISON_SQL})) WHERE rn = 1""")
def best_model(spark, sf):
    """Best scorer per task by AUC (ties → first listed)."""
    return M.best_by(_comparison(spark, sf), "task", "model", "auc", "pos").select("task", "model", "auc")


# ─────────────────────────── rebalancing (J3, J4, B1-B5, U1) ───────────────────────────

_EMB_SQL = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _knn_sql(k: str, same_label: bool) -> str:
    cond = "a.label = b.label AND " if same_label else ""
    part = "a.label, " if same_label else ""
    return f"""SELECT * FROM (
  SELECT {part}a.vec_id, b.vec_id AS nn_id, round(list_distance(a.v, b.v), 9) AS dist,
         CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id)
              AS INTEGER) AS rank
  FROM e a JOIN e b ON {cond}a.vec_id <> b.vec_id) WHERE rank <= {k}"""


def _embeddings(spark, sf) -> DataFrame:
    return read_table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>")
                                                      .alias("embedding"))


@register("knn_in_class", f"WITH {_EMB_SQL}\n{_knn_sql('5', True)}")
def knn_in_class(spark, sf):
    """Exact 5 nearest same-class neighbours of every embedding."""
    return NB.knn(_embeddings(spark, sf), "vec_id", "embedding", 5, group_cols=["label"])


@register("knn_all", f"WITH {_EMB_SQL}\n{_knn_sql('3', False)}")
def knn_all(spark, sf):
    """Exact 3 nearest neighbours over all rows (the ENN neighbourhood)."""
    return NB.knn(_embeddings(spark, sf), "vec_id", "embedding", 3)


_SMOTE_SQL = f"""WITH {_EMB_SQL},
cnt AS (SELECT label, count(*) AS n_c FROM e GROUP BY label),
par AS (SELECT max(n_c) AS maj, greatest(1, least(5, min(n_c) - 1)) AS k FROM cnt),
lab AS (SELECT label, row_number() OVER (ORDER BY CAST(label AS VARCHAR)) - 1 AS li FROM cnt),
rk AS (SELECT e.*, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM e),
nn AS (SELECT * FROM (
  SELECT a.label, a.vec_id, b.vec_id AS nn_id,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id) AS nnr
  FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id), par WHERE nnr <= par.k),
gen AS (
  SELECT rk.label, rk.vec_id, rk.v, rk.r + t.j * cnt.n_c AS i, lab.li, par.k
  FROM rk JOIN cnt USING (label) JOIN lab USING (label) CROSS JOIN par CROSS JOIN range(0, 100000) t(j)
  WHERE rk.r + t.j * cnt.n_c < par.maj - cnt.n_c),
syn AS (
  SELECT g.label, g.v, e2.v AS nv,
         CAST((g.i * 7919 + g.li * 104729 + 42) % 2147483647 AS DOUBLE) / 2147483647.0 AS lam
  FROM gen g LEFT JOIN nn ON nn.vec_id = g.vec_id AND nn.nnr = (g.i * 31 + 42) % g.k + 1
  LEFT JOIN e e2 ON e2.vec_id = nn.nn_id),
allrows AS (
  SELECT label, v AS x, 0 AS is_synthetic FROM e
  UNION ALL
  SELECT label, CASE WHEN nv IS NULL THEN v ELSE list_transform(range(1, len(v) + 1), lambda i: v[i] + lam * (nv[i] - v[i]))
                END, 1 FROM syn)"""


@register("smote", _SMOTE_SQL + """
SELECT label, count(*) AS n_rows, CAST(sum(is_synthetic) AS BIGINT) AS n_synthetic,
       round(sum(x[1]), 6) AS sum_x0, round(sum(x[2]), 6) AS sum_x1,
       round(sum(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * i))), 5) AS sum_weighted,
       round(sum(list_sum(list_transform(x, lambda y: y * y))), 5) AS sum_squares
FROM allrows GROUP BY label""")
def smote(spark, sf):
    """B1 + U1 + B3: classes equalised to the majority count; per-class counts and sums over all coordinates."""
    out = NB.smote(_embeddings(spark, sf), "vec_id", "label", "embedding")
    x = F.col("embedding")
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.round(F.sum(add(F.transform(x, lambda v, i: v * (i + 1)))), 5).alias("sum_weighted"),
                                    F.round(F.sum(add(F.transform(x, lambda v: v * v))), 5).alias("sum_squares"),
                                    F.sum("is_synthetic").cast("long").alias("n_synthetic"),
                                    F.round(F.sum(F.col("embedding")[0]), 6).alias("sum_x0"),
                                    F.round(F.sum(F.col("embedding")[1]), 6).alias("sum_x1"))


@register("enn", f"""WITH {_EMB_SQL},
nn AS ({_knn_sql('3', False)}),
keep AS (SELECT nn.vec_id FROM nn JOIN e a ON a.vec_id = nn.vec_id JOIN e b ON b.vec_id = nn.nn_id
         GROUP BY nn.vec_id HAVING bool_and(a.label = b.label))
SELECT e.label, count(*) AS n_rows, count(keep.vec_id) AS n_kept FROM e LEFT JOIN keep USING (vec_id) GROUP BY e.label""")
def enn(spark, sf):
    """B2: rows kept by edited nearest neighbours (3-NN, all must agree), per class."""
    emb = _embeddings(spark, sf)
    kept = NB.enn(emb, "vec_id", "label", "embedding", 3).select("vec_id", F.lit(1).alias("_k"))
    return emb.join(kept, "vec_id", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"),
                                                                 F.count("_k").alias("n_kept"))


@register("balanced_weights", """
SELECT is_correct, count(*) AS n, round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 10)
       AS weight
FROM eval_runs GROUP BY is_correct""")
def balanced_weights(spark, sf):
    """Balanced class weights n / (k · n_c)."""
    w = NB.balanced_weights(runs(spark, sf).select("is_correct"), "is_correct")
    return w.groupBy("is_correct").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("weight"), 10).alias("weight"))


@register("pos_weight", """
SELECT hallucination_flag, count(*) AS n,
       round(CASE WHEN hallucination_flag = 1
                  THEN CAST((SELECT count(*) FROM eval_runs WHERE hallucination_flag = 0) AS DOUBLE)
                       / (SELECT count(*) FROM eval_runs WHERE hallucination_flag = 1) ELSE 1.0 END, 10) AS weight
FROM eval_runs GROUP BY hallucination_flag""")
def pos_weight(spark, sf):
    """Positive-class weight = negatives / positives."""
    w = NB.positive_weight(runs(spark, sf).select("hallucination_flag"), "hallucination_flag")
    return w.groupBy("hallucination_flag").agg(F.count(F.lit(1)).alias("n"),
                                               F.round(F.first("weight"), 10).alias("weight"))


# ─────────────────────────────────── text (E9) ───────────────────────────────────

_TFIDF_SQL = """WITH tok AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM documents),
terms AS (
  SELECT doc_id, unnest(t) AS term FROM tok
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM tok
  WHERE len(t) >= 2),
cnt AS (SELECT doc_id, term, count(*) AS c FROM terms GROUP BY doc_id, term),
st AS (SELECT term, sum(c) AS freq, count(*) AS df FROM cnt GROUP BY term),
voc AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf
        FROM st ORDER BY freq DESC, term LIMIT 3000),
w AS (SELECT doc_id, cnt.term, (1.0 + ln(CAST(c AS DOUBLE))) * idf AS w FROM cnt JOIN voc USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
SELECT doc_id, term, round(w / norm, 8) AS tfidf FROM w JOIN nrm USING (doc_id)"""


@register("tfidf", _TFIDF_SQL)
def tfidf(spark, sf):
    """TF-IDF (unigrams + bigrams, top 3,000 terms, sublinear tf, smoothed idf, L2) over whole documents."""
    t = TX.tfidf(read_table(spark, sf, "documents"), "doc_id", "text", 3000)
    return t.select("doc_id", "term", F.round("tfidf", 8).alias("tfidf"))


# ────────────────────── Spark ML tasks (M1-M15, M10, M11, A17, A26, T7, S5-S8) — rows-only ──────────────────────

N_ITER = 20          # boosting rounds / trees for the registered runs (library default: 300, as the reference)


#: Keys, targets and texts that models, scoring and explanations read beside the features.
MODEL_COLUMNS = ["run_id", "split", "is_correct", "hallucination_flag", "correctness_label", "faithfulness_label", "total_latency_ms",
                 "total_cost_usd", "query", "task_type"]

_FITTED: dict = {}   # per (session, data folder): checkpointed features and fitted models, reused by queries


def _model_data(spark, sf):
    """Features learned on all rows (reference rule D12), split by the `split` column.

    The run table is read several times by the vocabulary, training and evaluation, so its lineage is cut
    with a reliable checkpoint in the shared checkpoint folder (survives executor loss); features are one
    projection of it."""
    key = ("data", id(spark), sf)
    if key not in _FITTED:
        from ..session import cut_lineage
        r = runs(spark, sf)
        kept = [c for c in r.columns if c in {*MODEL_COLUMNS, *NOMINAL_FEATURES, *NUMERIC_FEATURES, *FLAG_FEATURES, "difficulty"}]
        df, names = FE.engineer_features(cut_lineage(r.select(*kept)))   # the vocabulary and the features come from the same rows
        _FITTED[key] = (FE.split_data(df, names) | {"all": df}, names)
    return _FITTED[key]


def _binary(spark, sf, label="is_correct", task="Correctness", weighting="balanced", minority=0, rebalance=None):
    key = ("binary", id(spark), sf, label, weighting, rebalance)
    if key not in _FITTED:
        sp, names = _model_data(spark, sf)
        _FITTED[key] = ML.train_binary(sp["train"], sp["val"], sp["test"], names, label, task, N_ITER, weighting,
                                       minority=minority, rebalance=rebalance)
    return _FITTED[key]


@register("correctness_model", None)
def correctness_model(spark, sf):
    """M1: binary correctness — boosted trees, weighted boosted trees, weighted forest; threshold tuned on val."""
    return _binary(spark, sf)[0]


@register("hallucination_model", None)
def hallucination_model(spark, sf):
    """M3: hallucination — positive-class weight (B5); threshold tuned on val; minority class 1."""
    return _binary(spark, sf, "hallucination_flag", "Hallucination", "positive", 1)[0]


@register("multiclass_model", None)
def multiclass_model(spark, sf):
    """M2: 3-class correctness (forest, one-vs-rest boosted trees)."""
    sp, names = _model_data(spark, sf)
    return ML.train_multiclass(sp["train"], sp["test"], names, "correctness_label", "MultiCorrectness", N_ITER)[0]


@register("faithfulness_model", None)
def faithfulness_model(spark, sf):
    """M4: 3-class faithfulness."""
    sp, names = _model_data(spark, sf)
    return ML.train_multiclass(sp["train"], sp["test"], names, "faithfulness_label", "Faithfulness", N_ITER)[0]


@register("latency_model", None)
def latency_model(spark, sf):
    """M5: latency regression without the 6 leakage columns."""
    sp, names = _model_data(spark, sf)
    return ML.train_regression(sp["train"], sp["test"], names, "total_latency_ms", "Latency", LATENCY_LEAKAGE,
                               N_ITER)[0]


@register("cost_model", None)
def cost_model(spark, sf):
    """M6: cost regression without the 2 leakage columns."""
    sp, names = _model_data(spark, sf)
    return ML.train_regression(sp["train"], sp["test"], names, "total_cost_usd", "Cost", COST_LEAKAGE, N_ITER)[0]


@register("task_classifier", None)
def task_classifier(spark, sf):
    """M7: the language of a document from the exact E9 weights of its text (``tfidf``): balanced logistic regression and
    linear SVM, fitted on documents whose id is not divisible by 5 and judged on the others."""
    docs = read_table(spark, sf, "documents")
    vectors, _ = ML.term_vectors(cut_lineage(TX.tfidf(docs, "doc_id", "text", 3000)), "doc_id")   # read for the terms, then for the vectors
    labelled = vectors.join(docs.select("doc_id", "lang"), "doc_id")
    return ML.train_text_classifier(labelled, "lang", F.col("doc_id") % 5 != 0)[0]


@register("isotonic", None)
def isotonic(spark, sf):
    """Isotonic calibration of the correctness model on val; raw vs calibrated AUC on test."""
    sp, names = _model_data(spark, sf)
    model, _thr = _binary(spark, sf)[1]["GBT"]
    return ML.calibrate(model, sp["val"], sp["test"], names, "is_correct")[0]


def _cluster_input(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    z = FE.zscore(runs(spark, sf), CLUSTER_FEATURES)
    return VectorAssembler(inputCols=[f"{c}_z" for c in CLUSTER_FEATURES], outputCol="zfeat").transform(z)


@register("elbow", None)
def elbow(spark, sf):
    """K-means inertia for k = 2..10 on standardised clustering inputs."""
    return ML.elbow(_cluster_input(spark, sf), "zfeat")


@register("kmeans_profile", None)
def kmeans_profile(spark, sf):
    """M13 + A17: 5 clusters and their outcome profile."""
    return ML.kmeans_profile(_cluster_input(spark, sf), "zfeat", 5)


_CENTRES = [[0.0] * 10, [1.0, 1.0, 0.5, 0.5, 0.5, 0.0, 0.0, -1.0, -1.0, 0.0], [-1.0, -1.0, -0.5, -0.5, -0.5, 0.0, 0.0, 1.0, 1.0, 0.0]]


def _nearest_sql() -> str:
    far = ["(" + " + ".join(f"pow(({z}) - ({v}), 2)" for z, v in zip(
        [f"(CAST(coalesce({c}, 0) AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END" for c in CLUSTER_FEATURES], centre)) + ")"
        for centre in _CENTRES]
    return f"list_position([{', '.join(far)}], list_min([{', '.join(far)}])) - 1"


@register("cluster_profile", "WITH st AS (SELECT " + ", ".join(
    f"avg(CAST(coalesce({c}, 0) AS DOUBLE)) AS m_{c}, stddev_pop(CAST(coalesce({c}, 0) AS DOUBLE)) AS s_{c}" for c in CLUSTER_FEATURES)
    + f""" FROM eval_runs), a AS (SELECT eval_runs.*, CAST({_nearest_sql()} AS INTEGER) AS cluster FROM eval_runs, st)
SELECT cluster, round(avg(is_correct), 4) AS acc, round(avg(hallucination_flag), 4) AS hal, round(avg(recall_at_5), 4) AS r5,
       round(avg(total_latency_ms), 4) AS lat, round(avg(total_cost_usd), 4) AS cost, count(*) AS n FROM a GROUP BY cluster""")
def cluster_profile(spark, sf):
    """M13 + A17 with fixed centres: assignment and profile."""
    return ML.cluster_profile(ML.assign_clusters(_cluster_input(spark, sf), "zfeat", _CENTRES))


@register("pca2", None)
def pca2(spark, sf):
    """2-D PCA projection of every run."""
    return ML.pca2(_cluster_input(spark, sf), "zfeat", ["run_id", "is_correct"])


@register("feature_importance", None)
def feature_importance(spark, sf):
    """Top-20 feature importances of the boosted correctness model."""
    _, names = _model_data(spark, sf)
    top = ML.top_importances(_binary(spark, sf)[1]["GBT"][0], names, 20)
    return spark.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(top)], "rank int, feature string, importance double")


# ─────────────────────────── streaming, log, artifacts (R1, R2, S5-S11) ───────────────────────────


def _event_stream(spark, sf):
    # event times are UTC wall-clock values (TIMESTAMP_NTZ); watermarks need TIMESTAMP, so the
    # session zone must be UTC for windows to fall on UTC day boundaries
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = read_table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(os.path.join(sf, "events*.parquet"))


@register("stream_scoring", _request_features_sql())
def stream_scoring(spark, sf):
    """Requests arrive as a file stream → validate → hash → defaults → features, written by a
    checkpointed availableNow query; the sink is read back (equals the batch result)."""
    req = AD.requests_from_events(_event_stream(spark, sf))
    out = ST.score_requests(req, reference_features())
    sink, ck = ST.stream_paths(spark, "scoring")
    ST.run_to_sink(out.drop("warnings"), sink, ck)
    return spark.read.parquet(sink).select("request_id", *[F.col(f"`{c}`") for c in reference_features()])


#: A fixed scorer, as SQL that both engines read: probabilities, latency and cost from request features.
_FIXED_SCORER = ("least(greatest(0.5 * top1_score + 0.3 * recall_at_5 + 0.2 * mrr_at_10, 0.0), 1.0) AS correctness_prob, "
                 "0.9 - 0.8 * mrr_at_10 AS hallucination_prob, 1.1 * total_latency_ms AS predicted_latency_ms, "
                 "0.5 * total_cost_usd AS predicted_cost_usd")
_SERVED_SQL = f"""
WITH f AS ({_request_features_sql()}), p AS (SELECT request_id, {_FIXED_SCORER.replace('0.', 'CAST(0 AS DOUBLE) + 0.')} FROM f)
SELECT request_id, ts, CASE WHEN correctness_prob >= 0.5 THEN 'CORRECT' ELSE 'INCORRECT' END AS correctness, correctness_prob,
       CASE WHEN hallucination_prob >= 0.5 THEN 'HIGH' ELSE 'LOW' END AS hallucination, hallucination_prob,
       predicted_latency_ms AS latency_ms, predicted_cost_usd AS cost_usd
FROM p JOIN (SELECT request_id, ts FROM requests) USING (request_id)"""


def _served(spark, sf) -> str:
    """Requests streamed through the saved fixed scorer; returns the sink with predictions and log."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer
    sink, ck = ST.stream_paths(spark, "serve")
    scorer = f"{os.path.dirname(sink)}/scorer"
    PipelineModel([SQLTransformer(statement=f"SELECT *, {_FIXED_SCORER.replace('0.', '0D + 0.')} FROM __THIS__")]).write().save(scorer)
    ST.serve(AD.requests_from_events(_event_stream(spark, sf)), scorer, reference_features(), CATEGORIES, sink, ck)
    return sink


@register("stream_predictions", f"""
SELECT request_id, round(correctness_prob, 6) AS correctness_prob, round(hallucination_prob, 6) AS hallucination_prob,
       round(latency_ms, 6) AS latency_ms, round(cost_usd, 9) AS cost_usd FROM ({_SERVED_SQL})""")
def stream_predictions(spark, sf):
    """A request stream scored by a pipeline loaded from the shared folder, batch by batch, into an idempotent sink."""
    p = spark.read.parquet(f"{_served(spark, sf)}/predictions")
    return p.select("request_id", *[F.round(c, digits).alias(a) for c, a, digits in (
        ("correctness_prob", "correctness_prob", 6), ("hallucination_prob", "hallucination_prob", 6),
        ("predicted_latency_ms", "latency_ms", 6), ("predicted_cost_usd", "cost_usd", 9))])


@register("log_monitoring", f"""
WITH s AS ({_SERVED_SQL})
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n,
       round(avg(CASE WHEN correctness = 'CORRECT' THEN 1.0 ELSE 0.0 END), 4) AS share_correct,
       round(avg(CASE WHEN hallucination = 'HIGH' THEN 1.0 ELSE 0.0 END), 4) AS share_high,
       round(avg(round(latency_ms, 2)), 4) AS mean_latency_ms
FROM s GROUP BY date_trunc('day', ts)
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM s)""")
def log_monitoring(spark, sf):
    """R2: the prediction log that ``stream_predictions`` writes, monitored as a stream; closed days only."""
    log = ST.monitor_log(spark, f"{_served(spark, sf)}/log")
    sink, ck = ST.stream_paths(spark, "log-monitor")
    ST.run_to_sink(log, sink, ck)
    return spark.read.parquet(sink)


@register("isotonic_curve", """
WITH c AS (SELECT round(coalesce(top1_score, 0.0), 2) AS score, sum(is_correct)::DOUBLE AS y, count(*)::DOUBLE AS n
           FROM eval_runs WHERE is_correct IS NOT NULL GROUP BY 1),
k AS (SELECT score, row_number() OVER (ORDER BY score) AS i, sum(y) OVER (ORDER BY score) AS cy, sum(n) OVER (ORDER BY score) AS cn FROM c),
z AS (SELECT i, cy, cn FROM k UNION ALL SELECT 0, 0, 0),
m AS (SELECT k.i, a.i AS a, min((b.cy - a.cy) / (b.cn - a.cn)) AS low
      FROM k JOIN z a ON a.i < k.i JOIN z b ON b.i >= k.i GROUP BY k.i, a.i)
SELECT k.score, round(max(m.low), 8) AS calibrated FROM k JOIN m ON m.i = k.i GROUP BY k.score""")
def isotonic_curve(spark, sf):
    """M10 with a fixed score (two digits): the calibrated probability of every score. The oracle states pool-adjacent-violators
    as the largest over starts of the smallest over ends of running means."""
    r = runs(spark, sf).where("is_correct IS NOT NULL").select(
        F.col("is_correct").cast("double").alias("y"), F.round(F.coalesce("top1_score", F.lit(0.0)), 2).alias("score"))
    model = ML.isotonic_calibrator(r, "y", "score")
    return model.transform(r.select("score").distinct()).select("score", F.round("p_cal", 8).alias("calibrated"))


@register("log_windows", """
WITH mx AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM requests)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       count(*) AS n, round(avg(latency_ms_retrieval), 4) AS mean_latency,
       round(avg(CAST(has_relevant_in_top5 AS DOUBLE)), 4) AS share_flagged
FROM requests GROUP BY date_trunc('day', ts)
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT wm FROM mx)""")
def log_windows(spark, sf):
    """R2: daily monitoring windows with a 10-minute watermark, append mode (closed windows only)."""
    req = AD.requests_from_events(_event_stream(spark, sf))
    mon = ST.monitor(req, "ts", "latency_ms_retrieval", "has_relevant_in_top5")
    sink, ck = ST.stream_paths(spark, "monitor")
    ST.run_to_sink(mon, sink, ck)
    return spark.read.parquet(sink)


@register("log_hash", None)
def log_hash(spark, sf):
    """12-hex input hash of every request's canonical JSON (self-consistent, not byte-equal
    to another engine's JSON text)."""
    req = AD.requests_from_events(read_table(spark, sf, "events"))
    from ..functions.scalar import canonical_hash
    return req.select("request_id", canonical_hash([n for n, _, _ in REQUEST_FIELDS]).alias("input_hash"))


@register("prediction_log", None)
def prediction_log(spark, sf):
    """S9 + S10: log records of scored requests appended as JSON lines, then read back: count and last record.
    Scores here are fixed functions of the request (retrieval score, reciprocal rank) so the log path is
    exercised without a model; ``ST.log_records`` takes any scored frame."""
    feats = ST.score_requests(AD.requests_from_events(read_table(spark, sf, "events")), reference_features(),
                              keep=["request_id"])
    scored = feats.select("*", F.col("top1_score").alias("correctness_prob"),
                          (1.0 - F.col("mrr_at_10")).alias("hallucination_prob"),
                          F.col("total_latency_ms").alias("predicted_latency_ms"),
                          F.col("total_cost_usd").alias("predicted_cost_usd"))
    sink, _ = ST.stream_paths(spark, "predlog")
    AR.append_prediction_log(ST.log_records(scored), sink)
    return AR.prediction_log_summary(spark, sink).select("n_records", "last.input_hash", "last.predictions.*")


@register("categories", " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS column, CAST({c} AS VARCHAR) AS value FROM eval_runs WHERE {c} IS NOT NULL"
    for c in NOMINAL_FEATURES))
def categories(spark, sf):
    """Distinct sorted values per nominal column, written and read back as the vocabulary."""
    path = ST.stream_paths(spark, "categories")[0]
    AR.save_categories(runs(spark, sf), path)
    return spark.read.schema("column string, value string").json(path)


@register("feature_list", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{f}')" for i, f in enumerate(reference_features())) + ") t(pos, feature)")
def feature_list(spark, sf):
    """The ordered feature list learned from the data, written and read back."""
    _, names = FE.engineer_features(runs(spark, sf))
    path = ST.stream_paths(spark, "features")[0]
    AR.save_feature_list(spark, names, path)
    return spark.read.schema("pos int, feature string").json(path)


# ─────────────────────────── explanations (M16, M17, A27, W5) ───────────────────────────


def _shap_long(spark, sf, label="is_correct", task="Correctness", weighting="balanced", minority=0, top=None):
    sp, names = _model_data(spark, sf)
    model = _binary(spark, sf, label, task, weighting, minority)[1]["GBT"][0]
    ens = XP.export_trees(model, spark, f"{task.lower()}_gbt")
    te = ML.assemble(sp["test"], names, ["run_id"])
    return XP.tree_shap_long(te, "run_id", "features", ens, names, top=top)


def _top_shap(*args):
    return _shap_long(*args, top=10).select("run_id", "rank", "feature", "value", F.round("impact", 4).alias("impact"),
                                            F.round("base", 6).alias("base"), F.round("raw", 6).alias("raw"))


@register("tree_shap", None)
def tree_shap(spark, sf):
    """M16 + W5: TreeSHAP impacts of the boosted correctness model on the test split, top 10 per run."""
    return _top_shap(spark, sf)


@register("tree_shap_hallucination", None)
def tree_shap_hallucination(spark, sf):
    """M16 + W5: the same of the boosted hallucination model."""
    return _top_shap(spark, sf, "hallucination_flag", "Hallucination", "positive", 1)


@register("shap_importance", None)
def shap_importance(spark, sf):
    """Global importance = mean |SHAP| per feature, top 20."""
    return XP.mean_abs_impact(_shap_long(spark, sf), 20)


_LIN_COEF = {"top1_score": 2.0, "mrr_at_10": 1.5, "recall_at_5": 1.0, "total_cost_usd": -50.0}


@register("topn_impacts", "WITH m AS (SELECT " + ", ".join(
    f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in _LIN_COEF) + " FROM eval_runs),\nl AS (" + " UNION ALL ".join(
    f"SELECT run_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, "
    f"CAST({c} AS DOUBLE) * (CAST({f} AS DOUBLE) - m_{f}) AS impact FROM eval_runs, m"
    for f, c in _LIN_COEF.items()) + """)
SELECT run_id, rank, feature, value, round(impact, 8) AS impact FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY abs(impact) DESC NULLS LAST, feature) AS INTEGER)
         AS rank FROM l) WHERE rank <= 2""")
def topn_impacts(spark, sf):
    """M17 + W5: linear-explainer impacts coef·(x − mean) with fixed coefficients, top 2 per run by |impact|."""
    long = XP.linear_explain(runs(spark, sf), "run_id", _LIN_COEF)
    top = M.top_n_by_abs(long, "run_id", "feature", "impact", 2)
    return top.select("run_id", "rank", "feature", "value", F.round("impact", 8).alias("impact"))


# ─────────────────────────── batch scoring, end-to-end job (M9, M11, A26, S7, S8, S11) ───────────────────────────
def _tasks_at_once(spark, sp, names, jobs, learners):
    """Results of the tasks' jobs: side by side if all their learners together have room, else in turn."""
    together = ML.at_once(spark, sp["train"].count(), len(names), learners, 1) == learners
    return ML.side_by_side(spark, jobs, len(jobs) if together else 1)


def _train_scoring_models(spark, sf, rebalance=None):
    """The four tasks that requests are scored with; ``rebalance`` applies B1/B2 to the training split of the classifiers."""
    sp, names = _model_data(spark, sf)
    jobs = [lambda: _binary(spark, sf, rebalance=rebalance),
            lambda: _binary(spark, sf, "hallucination_flag", "Hallucination", "positive", 1, rebalance),
            lambda: ML.train_regression(sp["train"], sp["test"], names, "total_latency_ms", "Latency", LATENCY_LEAKAGE, N_ITER, binned=True),
            lambda: ML.train_regression(sp["train"], sp["test"], names, "total_cost_usd", "Cost", COST_LEAKAGE, N_ITER, binned=True)]
    learners = 10   # three and three, two and two
    (res_c, fit_c), (res_h, fit_h), (res_l, fit_l), (res_k, fit_k) = _tasks_at_once(spark, sp, names, jobs, learners)
    best = {}
    for key, res, fit in [("correctness", res_c, fit_c), ("hallucination", res_h, fit_h)]:
        top = M.best_by(res.withColumn("t", F.lit(1)), "t", "model", "f1_macro", "pos").first()
        best[key] = (top["model"], fit[top["model"]])
    for key, res, fit in [("latency", res_l, fit_l), ("cost", res_k, fit_k)]:
        top = M.best_by(res.withColumn("t", F.lit(1)).withColumn("neg_rmse", -F.col("rmse")), "t", "model",
                        "neg_rmse", "pos").first()
        best[key] = (top["model"], fit[top["model"]])
    return sp, names, best, [res_c, res_h, res_l, res_k]


def _scorer(spark, sf):
    """The trained scoring pipeline with its feature list and vocabulary, saved to the shared folder and loaded again."""
    sp, names, best, _ = _train_scoring_models(spark, sf)
    calibrated = {}
    for key, label in [("correctness", "is_correct"), ("hallucination", "hallucination_flag")]:
        model = best[key][1][0]
        calibrated[key] = (model, *ML.calibrate(model, sp["val"], sp["test"], names, label)[1:])
    task = ML.train_task_classifier(sp["train"], sp["test"], max_iter=50)[1]["LogReg"]
    pipeline = ML.scoring_pipeline(names, calibrated["correctness"], calibrated["hallucination"], best["latency"][1], best["cost"][1], task)
    root = ST.stream_paths(spark, "scorer")[0]
    pipeline.write().overwrite().save(f"{root}/pipeline")
    AR.save_feature_list(spark, names, f"{root}/feature_list")
    AR.save_categories(sp["all"], f"{root}/categories")
    return ML.load_pipeline(f"{root}/pipeline"), AR.load_feature_list(spark, f"{root}/feature_list"), AR.load_categories(spark, f"{root}/categories")


@register("batch_scoring", None)
def batch_scoring(spark, sf):
    """M11 + S7: every request → validated features → the saved and reloaded pipeline of the best correctness and
    hallucination classifiers (isotonic-calibrated on val, thresholds tuned after it), latency and cost regressors and
    the query task type."""
    pipeline, names, vocabulary = _scorer(spark, sf)
    req = AD.requests_from_events(read_table(spark, sf, "events"))
    ready = V.apply_defaults(V.validate_requests(req))
    feats = V.transform_requests(ready, names, vocabulary, keep=["request_id"]).join(ready.select("request_id", "query"), "request_id") \
        if "query" not in names else V.transform_requests(ready, names, vocabulary, keep=["request_id"])
    return pipeline.transform(feats).drop("query")


@register("train_all", None)
def train_all(spark, sf):
    """M9 + A26 + S5-S8: train all seven tasks (M1-M7; B1/B2 on the training split of the classifiers, as the reference does),
    calibrate the binary models (M10), save models, calibrators, thresholds, labels, feature list, vocabulary and the compiled
    metrics table to the shared model folder; return the metrics read back."""
    sp, names, best, results = _train_scoring_models(spark, sf, rebalance="smoteenn")
    root = ML.model_dir(spark, "train_all")
    for key, (name, fitted) in best.items():
        ML.save_model(fitted[0], spark, f"train_all/{key}_{name}")
    jobs = [lambda: ML.train_multiclass(sp["train"], sp["test"], names, "correctness_label", "MultiCorrectness", N_ITER, rebalance="smote", binned=True),
            lambda: ML.train_multiclass(sp["train"], sp["test"], names, "faithfulness_label", "Faithfulness", N_ITER, rebalance="smote", binned=True),
            lambda: ML.train_task_classifier(sp["train"], sp["test"])]
    multi, faith, text = _tasks_at_once(spark, sp, names, jobs, 10)   # a forest and three one-vs-rest learners twice, two on texts
    for key, (res, fitted) in [("multiclass", multi), ("faithfulness", faith), ("task_type", text)]:
        top = M.best_by(res.withColumn("t", F.lit(1)), "t", "model", "f1_macro", "pos").first()["model"]
        ML.save_model(fitted[top], spark, f"train_all/{key}_{top}")
    tuned, calibrated = [], {}
    for key, task, label in [("correctness", "Correctness", "is_correct"), ("hallucination", "Hallucination", "hallucination_flag")]:
        name, (model, threshold) = best[key]
        auc, calibrator, after = ML.calibrate(model, sp["val"], sp["test"], names, label)
        ML.save_model(calibrator, spark, f"train_all/{key}_{name}_calibrator")
        tuned.append((key, name, float(threshold), float(after)))
        calibrated[task, name] = auc.first()["auc_calibrated"]
    spark.createDataFrame(tuned, "task string, model string, threshold double, threshold_calibrated double").coalesce(1) \
        .write.mode("overwrite").json(f"{root}/thresholds")
    AR.save_feature_list(spark, names, f"{root}/feature_list")
    AR.save_categories(sp["all"], f"{root}/categories")
    auc = spark.createDataFrame([(*k, v) for k, v in calibrated.items()], "task string, model string, auc_calibrated double")
    cls = results[0].unionByName(results[1])
    for res in (multi[0], faith[0], text[0]):
        cls = cls.unionByName(res.drop("recall_by_class"), allowMissingColumns=True)
    cls = cls.join(F.broadcast(auc), ["task", "model"], "left").select(
        "model", "task", *[F.round(c, 4).alias(c) for c in ["accuracy", "auc", "f1_macro"]],
        F.round("threshold", 3).alias("threshold"), F.round("recall_minority", 4).alias("recall_minority"),
        F.round("auc_calibrated", 4).alias("auc_calibrated"))
    reg = results[2].unionByName(results[3]).select(
        "model", "task", *[F.round(c, 4).alias(c) for c in ["rmse", "mae", "r2"]])
    AR.save_metrics(cls, reg, f"{root}/metrics")
    back = AR.load_metrics(spark, f"{root}/metrics")
    return back["classification"].unionByName(back["regression"], allowMissingColumns=True)


@register("training_curve", None)
def training_curve(spark, sf):
    """Per-iteration learn / test loss of the boosted correctness model, written as TSV logs and read
    back joined on the iteration; plus the best test iteration (min_by)."""
    sp, names = _model_data(spark, sf)
    model = _binary(spark, sf)[1]["GBT"][0]
    root = ST.stream_paths(spark, "curve")[0]
    for part, frame in [("learn", sp["train"]), ("test", sp["test"])]:
        curve = ML.training_curve(model, ML.assemble(frame, names, ["is_correct"]))
        spark.createDataFrame(curve, "iter int, loss double").coalesce(1).write.mode("overwrite") \
            .option("sep", "\t").option("header", True).csv(f"{root}/{part}")
    from ..sources.tables import read_training_curve
    c = read_training_curve(spark, f"{root}/learn", f"{root}/test")
    best = c.agg(F.min_by("iter", "test_loss").alias("best_iter"))
    return c.crossJoin(best)


# ─────────────────────────── sampling, preview, chunk statistics (P12, P13, C9) ───────────────────────────
@register("sample_1500", """
SELECT run_id, is_correct, total_latency_ms FROM eval_runs
ORDER BY (run_id * 7919 + 42) % 1000003, run_id LIMIT 1500""")
def sample_1500(spark, sf):
    """1,500 runs without replacement, fixed seed, by an arithmetic hash of the key (the limit is the feature)."""
    r = runs(spark, sf).select("run_id", "is_correct", "total_latency_ms")
    key = F.struct((F.col("run_id") * 7919 + 42) % 1000003, F.col("run_id"))
    return A.sample_rows(r, 1500, key)


@register("preview", """
SELECT run_id, split, generator_model, is_correct FROM eval_runs ORDER BY run_id LIMIT 3""")
def preview(spark, sf):
    """head(3) by run id."""
    return A.preview(runs(spark, sf).select("run_id", "split", "generator_model", "is_correct"), "run_id", 3)


@register("shape", "SELECT count(*) AS n_rows, 45 AS n_cols FROM eval_runs")
def shape(spark, sf):
    """Rows and columns of the run table."""
    return A.shape(runs(spark, sf))


@register("chunk_stats", """
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS w,
                  unnest(range(0, len(regexp_extract_all(text, '\\S+')))) AS pos FROM documents),
c AS (SELECT doc_id, CAST(floor(pos / 256) AS INTEGER) AS chunk_index, count(*) AS estimated_tokens
      FROM w GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_chunks, round(avg(estimated_tokens), 4) AS avg_chunk_tokens,
       sum(estimated_tokens) AS n_tokens FROM c GROUP BY doc_id""")
def chunk_stats(spark, sf):
    """Documents cut into 256-word chunks (whole texts), then chunks / mean tokens / tokens per document."""
    ch = TX.chunk_words(read_table(spark, sf, "documents"), "doc_id", "text", 256)
    return TX.document_chunk_stats(ch)
