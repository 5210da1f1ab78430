"""Derivations and checks stated by the data dictionary.

The dictionary defines how some columns follow from others; these operators
compute or verify them over the whole tables with column expressions and
partial aggregations only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def answered_without_retrieval(is_correct: str = "is_correct", recall_at_10: str = "recall_at_10",
                               has_answer: str = "has_answer_in_corpus") -> Column:
    """Correct although nothing relevant was retrieved in the top 10 and the answer exists."""
    return F.when((F.col(is_correct) == 1) & (F.coalesce(F.col(recall_at_10), F.lit(0.0)) == 0)
                  & (F.col(has_answer) == 1), 1).otherwise(0)


def latency_consistency(df: DataFrame, total: str = "total_latency_ms", parts: Sequence[str] = (
        "latency_ms_retrieval", "latency_ms_generation"), digits: int = 4) -> DataFrame:
    """Total latency must cover its parts; violation count and overhead statistics."""
    s = None
    for p in parts:
        s = F.col(p) if s is None else s + F.col(p)
    over = (F.col(total) - s).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n_runs"),
                  F.count_if(F.col(total) < s).alias("n_violations"),
                  F.round(F.avg(over), digits).alias("avg_overhead"),
                  F.min(over).alias("min_overhead"), F.max(over).alias("max_overhead"))


def scenario_usage(scenarios: DataFrame, runs: DataFrame, key: str = "scenario_id") -> DataFrame:
    """``n_eval_examples`` (runs per scenario) and ``is_used_in_eval`` on the scenario table.

    Runs are pre-aggregated to one row per key before the join (partial aggregation)."""
    counts = runs.groupBy(key).agg(F.count(F.lit(1)).alias("n_eval_examples"))
    out = scenarios.join(counts, key, "left")
    return out.withColumns({
        "n_eval_examples": F.coalesce(F.col("n_eval_examples"), F.lit(0)).cast("long"),
        "is_used_in_eval": (F.coalesce(F.col("n_eval_examples"), F.lit(0)) > 0).cast("int"),
    })


def split_by_key(key: Column, train: int = 7, val: int = 1, buckets: int = 10) -> Column:
    """Deterministic split from an integer key (all rows of a key land in one split)."""
    m = F.pmod(key, F.lit(buckets))
    return F.when(m < train, F.lit("train")).when(m < train + val, F.lit("val")).otherwise(F.lit("test"))


def split_by_hash(key: Column, train: int = 7, val: int = 1, buckets: int = 10, seed: int = 42) -> Column:
    """C10 for non-integer keys: bucket by a stable 64-bit hash of the key."""
    return split_by_key(F.xxhash64(key, F.lit(seed)), train, val, buckets)


def split_leak_check(df: DataFrame, key: str = "query_id", split: str = "split") -> DataFrame:
    """C10 check: number of keys, and keys found in more than one split (must be 0)."""
    per_key = df.groupBy(key).agg(F.count_distinct(F.col(split)).alias("_n"))
    return per_key.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("_n") > 1).alias("n_leaking_keys"))


def config_id(cols: Sequence[str], prefix: str = "CFG", n_hex: int = 10, null_as: str = "none") -> Column:
    """C11: deterministic configuration id: prefix + upper hex digits of md5 over the joined fields."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(null_as)) for c in cols]
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(F.concat_ws("|", *parts)), 1, n_hex)))


def dictionary_violations(df: DataFrame, allowed: Mapping[str, Sequence[str]] | None = None,
                          patterns: Mapping[str, str] | None = None, flags: Sequence[str] = (),
                          numeric: Sequence[str] = ()) -> DataFrame:
    """Rule checks compiled into ONE aggregation → long form (rule, col_name, violations).

    allowed: value not in the list (nulls are not violations); patterns: non-null
    value not matching the regex; flags: value not in {0, 1}; numeric: non-null
    text that does not cast to double."""
    checks: list[tuple[str, str, Column]] = []
    for c, vals in (allowed or {}).items():
        if c in df.columns:
            checks.append(("allowed_values", c, F.col(c).isNotNull() & ~F.col(c).cast("string").isin(list(vals))))
    for c, rx in (patterns or {}).items():
        if c in df.columns:
            checks.append(("pattern", c, F.col(c).isNotNull() & ~F.col(c).cast("string").rlike(rx)))
    for c in flags:
        if c in df.columns:
            checks.append(("binary_flag", c, F.col(c).isNotNull() & ~F.col(c).isin(0, 1)))
    for c in numeric:
        if c in df.columns:
            checks.append(("numeric_cast", c, F.col(c).isNotNull()
                           & F.col(c).cast("string").try_cast("double").isNull()))
    wide = df.agg(*[F.count_if(cond).alias(f"v{i}") for i, (_, _, cond) in enumerate(checks)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("col_name"), F.col(f"v{i}").alias("violations"))
        for i, (r, c, _) in enumerate(checks)])).alias("s")).select("s.*")


def failure_mode(halluc: str = "hallucination_flag", relevant10: str = "has_relevant_in_top10",
                 probe: str = "is_noanswer_probe") -> Column:
    """Failure segments derivable from columns."""
    h = F.col(halluc) == 1
    return (F.when(h & (F.coalesce(F.col(relevant10), F.lit(0)) == 0), F.lit("no_relevant_chunk_hallucinated"))
            .when(h & (F.col(probe) == 1), F.lit("noanswer_probe_hallucinated"))
            .when(h, F.lit("other_hallucination")).otherwise(F.lit("no_hallucination")))
