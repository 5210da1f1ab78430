"""Corpus pipeline: from raw documents to token files, one operator of ``ragscope.llm`` per stage.

Quality rules drop documents, near-duplicates keep one document of each group, documents that have a
benchmark item go, sources are mixed to target weights in curriculum order (a document stands there as often
as the mix takes it), and what is left becomes token sequences. Each stage is written as Parquet to the
cluster's shared folder and read again by the next; it works on all rows that the one before it kept. A table is deleted
once the next one is written.

Null and empty texts fail the quality rules. Repeated rows are rows of their own up to near_dedup, which keeps or drops all rows
of an id. Texts of any length go through every stage whole. Without documents all stages are empty; without labels only
the fixed quality rules hold, without benchmark items nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragscope.llm.common import discard, few, materialise, table
from ragscope.llm.decontaminate import without_contaminated
from ragscope.llm.minhash import near_duplicates
from ragscope.llm.mixing import curriculum_order
from ragscope.llm.quality import fit_quality, keep_quality
from ragscope.llm.token_output import token_files, written_order


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id are kept; of rows that share id and text, all are kept or none."""
    gone = near_duplicates(docs, k=5).where("not kept").select("doc_id").distinct()
    return docs.join(few(gone), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: part files and their rows ascend by position."""
    return curriculum_order(docs).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which the stage before wrote its rows."""
    return token_files(spark, docs, written_order(docs))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate),
          ("source_mixing", mix_sources), ("token_output", token_output)]

#: Trees, signatures, the latent space and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # only tables that were written on the way
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return out
