"""Column groups, category vocabularies and request defaults of the RAG-evaluation data model.

Everything in the FIXED VALUES block must equal the reference data model
(column names, their order, category spellings, clamp ranges, defaults); the
rest of the package takes column names as parameters and only uses these as
defaults.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ───────────────────────────── FIXED VALUES ─────────────────────────────
NUMERIC_FEATURES = [
    "top1_score", "mean_retrieved_score", "recall_at_5", "recall_at_10",
    "mrr_at_10", "answer_tokens", "prompt_tokens", "n_retrieved_chunks",
    "context_window_tokens", "max_new_tokens", "latency_ms_retrieval",
    "latency_ms_generation", "total_latency_ms", "total_cost_usd",
    "temperature", "top_p",
]

FLAG_FEATURES = [
    "used_long_context_window", "has_relevant_in_top5", "has_relevant_in_top10",
    "is_noanswer_probe", "has_answer_in_corpus", "answered_without_retrieval",
]

NOMINAL_FEATURES = [
    "domain", "task_type", "retrieval_strategy", "chunking_strategy",
    "generator_model", "embedding_model", "reranker_model", "eval_mode",
    "stop_reason",
]

ORDINAL_FEATURES = ["difficulty"]
DIFFICULTY_ORDER = ["easy", "medium", "hard"]

INTERACTION_FEATURES = [
    "retrieval_x_difficulty", "recall5_x_nchunks", "score_gap", "latency_ratio", "cost_per_token",
]
TEXT_FEATURES = ["query_len", "query_word_count"]

TARGETS = {
    "binary_correctness": "is_correct",
    "multiclass_correctness": "correctness_label",
    "hallucination": "hallucination_flag",
    "faithfulness": "faithfulness_label",
    "latency": "total_latency_ms",
    "cost": "total_cost_usd",
    "task_type": "task_type",
}

# Notebook label-encoding variant: these 10 columns get alphabetical integer codes.
LABEL_ENCODED_FEATURES = [
    "domain", "task_type", "difficulty", "retrieval_strategy", "chunking_strategy",
    "generator_model", "embedding_model", "reranker_model", "eval_mode", "stop_reason",
]

# Request validation: clamp ranges (field, low, high) and non-negative fields.
CLAMP_RULES = [
    ("temperature", 0.0, 2.0),
    ("top_p", 0.0, 1.0),
    ("top1_score", 0.0, 1.0),
    ("mean_retrieved_score", 0.0, 1.0),
    ("recall_at_5", 0.0, 1.0),
    ("recall_at_10", 0.0, 1.0),
    ("mrr_at_10", 0.0, 1.0),
]
NON_NEGATIVE_FIELDS = [
    "n_retrieved_chunks", "prompt_tokens", "answer_tokens",
    "context_window_tokens", "max_new_tokens",
    "latency_ms_retrieval", "latency_ms_generation",
    "total_latency_ms", "total_cost_usd",
]

# Leakage columns dropped before the regression tasks (product rules; the notebook used 4 and 2).
LATENCY_LEAKAGE = [
    "total_latency_ms", "latency_ms_generation", "latency_ms_retrieval",
    "latency_ratio", "total_cost_usd", "cost_per_token",
]
COST_LEAKAGE = ["total_cost_usd", "cost_per_token"]

# Dashboard dimensions for the performance breakdown, and the 4 "best of" dimensions.
BREAKDOWN_DIMENSIONS = [
    "generator_model", "retrieval_strategy", "embedding_model", "domain", "difficulty",
    "chunking_strategy",
]
BEST_OF_DIMENSIONS = ["retrieval_strategy", "generator_model", "embedding_model", "chunking_strategy"]

# Clustering inputs of the notebook (standardised before K-means / PCA).
CLUSTER_FEATURES = [
    "top1_score", "mean_retrieved_score", "recall_at_5", "recall_at_10", "mrr_at_10",
    "answer_tokens", "prompt_tokens", "total_latency_ms", "total_cost_usd", "temperature",
]

# Scoring-request defaults (field, Spark type, default).
REQUEST_FIELDS = [
    ("query", "string", "What causes inflation?"),
    ("domain", "string", "finance"),
    ("task_type", "string", "factual"),
    ("difficulty", "string", "medium"),
    ("generator_model", "string", "gpt-4o"),
    ("embedding_model", "string", "text-embedding-3-large"),
    ("reranker_model", "string", "none"),
    ("retrieval_strategy", "string", "hybrid"),
    ("chunking_strategy", "string", "fixed_500"),
    ("eval_mode", "string", "llm_judge"),
    ("stop_reason", "string", "eos"),
    ("top1_score", "double", 0.75),
    ("mean_retrieved_score", "double", 0.55),
    ("recall_at_5", "double", 1.0),
    ("recall_at_10", "double", 1.0),
    ("mrr_at_10", "double", 0.6),
    ("temperature", "double", 0.3),
    ("top_p", "double", 0.9),
    ("n_retrieved_chunks", "int", 5),
    ("prompt_tokens", "int", 800),
    ("answer_tokens", "int", 150),
    ("context_window_tokens", "int", 8192),
    ("max_new_tokens", "int", 1024),
    ("latency_ms_retrieval", "double", 150.0),
    ("latency_ms_generation", "double", 800.0),
    ("total_latency_ms", "double", 950.0),
    ("total_cost_usd", "double", 0.01),
    ("has_relevant_in_top5", "int", 1),
    ("has_relevant_in_top10", "int", 1),
    ("has_answer_in_corpus", "int", 1),
    ("is_noanswer_probe", "int", 0),
    ("used_long_context_window", "int", 0),
    ("answered_without_retrieval", "int", 0),
]

# Identifier patterns of the data dictionary (column -> regex).
ID_PATTERNS = {
    "doc_id": r"^DOC[0-9]{4}$",
    "chunk_id": r"^C[0-9]{5}$",
    "run_id": r"^run_[0-9]+$",
    "example_id": r"^QA[0-9]{6}$",
    "scenario_id": r"^SC[0-9]{4}$",
    "query_id": r"^Q[0-9]{4}$",
    "run_config_id": r"^CFG[A-F0-9]{10}$",
}

# Allowed values of the run table's categorical columns (data dictionary).
ALLOWED_VALUES = {
    "difficulty": ["easy", "hard", "medium"],
    "correctness_label": ["correct", "incorrect", "partial"],
    "faithfulness_label": ["faithful", "unfaithful", "unknown"],
    "split": ["train", "val", "test"],
}
# Category vocabularies of the nine nominal columns (alphabetical, as trained).
CATEGORIES = {
    "domain": ["developer_docs", "financial_reports", "hr_policies", "medical_guides", "policies",
               "product_docs", "research_papers", "support_faq"],
    "task_type": ["comparison", "explanation", "factoid", "instruction_following", "multi_hop",
                  "summarization", "table_qa", "temporal_reasoning"],
    "retrieval_strategy": ["bm25", "bm25_then_rerank", "dense", "dense_then_rerank", "hybrid"],
    "chunking_strategy": ["by_heading", "fixed_512_tokens", "semantic", "sliding_window_256_overlap"],
    "generator_model": ["claude-3.5-sonnet", "gpt-4o", "gpt-4o-mini", "llama-3.1-70b-instruct",
                        "llama-3.1-8b-instruct", "mistral-large"],
    "embedding_model": ["all-minilm-l12-v2", "bge-m3", "e5-mistral-7b", "gte-large",
                        "text-embedding-3-large", "text-embedding-3-small"],
    "reranker_model": ["bge-reranker-base", "colbert-v2", "cross-encoder-ms-marco", "gte-qwen-reranker",
                       "jina-reranker-v1", "none"],
    "eval_mode": ["human_eval", "no_answer_probe", "offline_batch", "online_shadow"],
    "stop_reason": ["eos", "error", "length"],
}
BINARY_FLAGS = ["is_correct", "hallucination_flag"] + FLAG_FEATURES
# ─────────────────────────── END FIXED VALUES ───────────────────────────


def reference_features(categories=None) -> list[str]:
    """Trained feature order: numeric, flags, ordinal, one-hot (vocabulary order), interactions, text."""
    cats = categories if categories is not None else CATEGORIES
    return (NUMERIC_FEATURES + FLAG_FEATURES + ["difficulty_ord"]
            + [f"{c}_{v}" for c, vals in cats.items() for v in vals] + INTERACTION_FEATURES + TEXT_FEATURES)


_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(),
          "long": T.LongType()}


def request_schema() -> T.StructType:
    """Schema of a batch or stream of scoring requests (all fields nullable = may be defaulted)."""
    return T.StructType([T.StructField("request_id", T.LongType(), True)]
                        + [T.StructField(n, _TYPES[t], True) for n, t, _ in REQUEST_FIELDS])
