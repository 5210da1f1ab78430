"""Enrichment joins of the run table.

Run table ⟕ scenarios on ``scenario_id`` and ⟕ documents on the first document
id used by the run.  Only columns the left side lacks are brought in (P1), the
document key is renamed before the join (P2) and optional columns are taken
only if present (P3), all decided at plan-build time from the schemas.

Join strategy is left to Spark: a dimension whose estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` is broadcast (statically, or by AQE
at runtime from the real shuffle size); a large one stays a sort-merge join,
with AQE splitting skewed partitions.  No unchecked ``broadcast()`` hint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import first_list_item


def new_columns(left: DataFrame, right: DataFrame, key: str) -> list[str]:
    """The key plus every right-side column the left side does not have."""
    return [key] + [c for c in right.columns if c not in left.columns and c != key]


def join_scenarios(runs: DataFrame, scenarios: DataFrame, key: str = "scenario_id",
                   keep_scenario_doc_as: str | None = "scenario_doc_id") -> DataFrame:
    """Runs ⟕ scenarios adding only new columns; skipped if either side lacks the key.

    The scenario's own ``primary_doc_id`` is kept under ``keep_scenario_doc_as``
    so the run-derived ``primary_doc_id`` (J2) does not overwrite it."""
    if key not in runs.columns or key not in scenarios.columns:
        return runs
    right = scenarios
    if keep_scenario_doc_as and "primary_doc_id" in right.columns:
        right = right.withColumnRenamed("primary_doc_id", keep_scenario_doc_as)
    return runs.join(right.select(*new_columns(runs, right, key)), key, "left")


def join_documents(runs: DataFrame, documents: DataFrame, ids_col: str = "doc_ids_used", sep: str = "|",
                   doc_key: str = "doc_id", doc_cols: Sequence[str] = ("source_type", "word_count", "num_chunks"),
                   out_key: str = "primary_doc_id") -> DataFrame:
    """Derive the primary document id (first list item, F6) and left-join document columns.

    ``sep='|'`` follows the data contract; ``sep=','`` reproduces the legacy rule."""
    if ids_col not in runs.columns:
        return runs
    with_key = runs.withColumn(out_key, first_list_item(ids_col, sep))
    docs = documents.withColumnRenamed(doc_key, out_key)                       # P2
    cols = [out_key] + [c for c in doc_cols if c in docs.columns]             # P3
    if len(cols) == 1:
        return with_key
    return with_key.join(docs.select(*cols), out_key, "left")


def merge_datasets(runs: DataFrame, scenarios: DataFrame | None, documents: DataFrame | None,
                   sep: str = "|") -> DataFrame:
    """S3: the enriched run table (J1 then J2), returned lazily."""
    out = runs
    if scenarios is not None:
        out = join_scenarios(out, scenarios)
    if documents is not None:
        out = join_documents(out, documents, sep=sep)
    return out


def lookup_index(df: DataFrame, col: str, vocabulary: DataFrame, value_col: str = "value",
                 index_col: str = "index", out: str | None = None) -> DataFrame:
    """Category → integer code through a vocabulary table (value, index), left join."""
    v = vocabulary.select(F.col(value_col).alias(col), F.col(index_col).alias(out or f"{col}_enc"))
    return df.join(v, col, "left")
