"""Mixing sources to target weights with a time-varying curriculum.

Targets share the token demand by weight, bounded by ``max_repeat`` x each source's size. Each source's
weight is a schedule over training time; its integral is the source's cumulative demand, and inverting
it turns a document's place in the source's own order into a training position. Documents are range-sorted
by position.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words, table

WEIGHTS = (5, 2, 1)
#: Relative change of a source's weight over training: 1 + slope * (2t - 1) at time t, repeating.
SLOPES = (0.5, 0.0, -0.5)


def _cycle(values, rank: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), (rank - 1) % len(values))


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = 1.5,
                   max_repeat: float = 2.0) -> DataFrame:
    """(source_key, source, source_size) to targets: ``share`` x all words by weight, at most ``max_repeat`` x
    the source's size, the excess going to the others by weight.

    In ascending order of cap per weight the capped sources come first, so the level is the first one that
    does not reach its source's cap. One row per source: the windows run over sources, not documents.
    """
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return (sizes
            .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
            .withColumn("weight", _cycle(weights, F.col("rank"))).withColumn("slope", _cycle(slopes, F.col("rank")))
            .withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
            .withColumn("ratio", F.col("cap") / F.col("weight"))
            .withColumn("rest", F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            .withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
            .withColumn("level", F.min(F.when(F.col("ratio") > F.col("rest") / F.col("heavy"), F.struct("ratio", "rank", (F.col("rest") / F.col("heavy")).alias("at")))).over(everything)["at"])
            .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
            .select("source_key", "source_size", "target", "slope"))


def position(share: Column, slope: Column) -> Column:
    """The time t at which t + slope * (t * t - t), the integral of the schedule, reaches ``share``."""
    return 2 * share / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share))


def curriculum_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                   keep: list[str] | None = None, weights=WEIGHTS, slopes=SLOPES, share: float = 1.5, max_repeat: float = 2.0,
                   rows_per_bucket: int = 5_000) -> DataFrame:
    """One row per document: columns ``keep``, its ``size`` in words, ``source_size``, ``target``, and ``positions``,
    the training times in [0, 1] at which the mix takes it (as many as it is taken; empty: not in the mix).

    A source's documents are ordered by the MD5 of id and text, so that reruns agree on any partitioning; a
    document is taken in pass p when its middle word, counted over passes, lies within the source's target. The
    taken words therefore differ from the target by at most half of one document. Null texts have size 0, null
    sources are one source, and repeated rows are rows of their own. Documents without words keep their place in
    the order and take none of the demand. An empty table gives an empty result.

    The words before a document come from two levels: sums per (source, hash bucket), accumulated over buckets, and
    a window within a bucket. The number of buckets follows the rows, so that a source with a third of all rows
    is spread over as many tasks as its rows fill.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "source_size", "target", "positions")]
    n_buckets = max(1, ceil(docs.count() / rows_per_bucket))
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    rows = docs.select(
        F.struct(*keep).alias("row"), n_words(text).alias("size"), F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("source_key"), digest.alias("digest")
    ).withColumn("bucket", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / 2.0**32 * n_buckets).cast("long"))
    sums = materialise(rows.groupBy("source_key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "mix-sums")
    sums = sums.withColumn("earlier", F.coalesce(F.sum("words").over(
        Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = sums.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, slopes, share, max_repeat)
    within = Window.partitionBy("source_key", "bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
              .join(sums.select("source_key", "bucket", "earlier").join(targets, "source_key"), ["source_key", "bucket"])
              .withColumn("middle", F.col("earlier") + F.col("before") + F.col("size") / 2))
    passes = F.array(*[F.col("middle") + F.col("source_size") * e for e in range(ceil(max_repeat))])
    taken = F.filter(passes, lambda m: m <= F.col("target"))
    return placed.withColumn("positions", F.transform(taken, lambda m: position(
        F.when(F.col("target") > 0, m / F.col("target")).otherwise(F.lit(0.0)), F.col("slope")))
    ).select("row.*", "size", "source_size", "target", "positions")


def _in_order(mixed: DataFrame) -> DataFrame:
    """Rows of ``curriculum_mix`` as often as the mix takes them, with ``training_position`` and the number of the take (from 0),
    range-sorted by position."""
    return mixed.select("*", F.posexplode("positions").alias("take", "training_position")).drop("positions").orderBy("training_position")


def curriculum_order(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each taken document as often as it is taken, range-sorted by training position.
    Columns of ``docs`` plus ``training_position``; a column of that name in ``docs`` is replaced."""
    kept = [c for c in docs.columns if c != "training_position"]
    named = docs.select(F.struct(*kept).alias("doc"), *[F.col(options.get(k, k)).alias(k) for k in ("doc_id", "text", "source")])
    mixed = curriculum_mix(named, keep=["doc"], **{k: v for k, v in options.items() if k not in ("doc_id", "text", "source")})
    return _in_order(mixed).select("doc.*", "training_position")


def op10_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    """All documents mixed: word sizes, targets, words taken, and the first training position (null: not taken).

    The mix is written in training order and read back: what is taken of a document is what the written mix has of it. Rows
    that the mix leaves out follow. Rows of equal id are told apart by a number of their own."""
    docs = table(spark, sf_dir, "documents")
    mixed = materialise(curriculum_mix(docs, keep=["doc_id"]).withColumn("row_no", F.monotonically_increasing_id()), "mix-rows")
    order = materialise(_in_order(mixed.select("row_no", "size", "positions")), "mix-order")
    taken = order.groupBy("row_no").agg(F.sum("size").alias("taken"), F.min("training_position").alias("first"))
    return mixed.join(taken, "row_no", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.round("first", 6).alias("first_position"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             CASE (rank - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope,
             2.0::DOUBLE * source_size AS cap FROM r),
o AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0::DOUBLE))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
      FROM o WINDOW b AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, slope,
             least(cap, coalesce((SELECT arg_min(level, (ratio, rank)) FROM l WHERE ratio > level) * weight, cap)) AS target
      FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, (CASE WHEN middle <= target THEN 1 ELSE 0 END)
             + (CASE WHEN middle + source_size <= target THEN 1 ELSE 0 END) AS n,
             CASE WHEN target > 0 THEN middle / target ELSE 0.0::DOUBLE END AS share FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * n)::BIGINT AS taken,
       CASE WHEN n > 0 THEN round(2 * share / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)), 6) END AS first_position
FROM y
"""
