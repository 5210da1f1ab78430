"""Group-by profiles of a run table.

All operators are ``DataFrame -> DataFrame`` with column names as parameters.
Grouped results are small (bounded by the number of distinct keys), every
aggregate is algebraic or has a partial form, so Spark combines map-side before
the shuffle; a hot key never sends its raw rows to one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Named metric → (aggregate, input column).  "mean" skips nulls like pandas.
AGGS = {
    "mean": lambda c: F.avg(F.col(c)),
    "count": lambda c: F.count(F.col(c)),
    "sum": lambda c: F.sum(F.col(c)),
    "min": lambda c: F.min(F.col(c)),
    "max": lambda c: F.max(F.col(c)),
}

DASHBOARD_METRICS = {
    "accuracy": ("mean", "is_correct"),
    "halluc_rate": ("mean", "hallucination_flag"),
    "avg_latency": ("mean", "total_latency_ms"),
    "avg_cost": ("mean", "total_cost_usd"),
    "count": ("count", "run_id"),
}


def _agg_exprs(metrics: Mapping[str, tuple[str, str]], digits: int | None) -> list[Column]:
    out = []
    for name, (fn, col) in metrics.items():
        e = AGGS[fn](col)
        if digits is not None and fn == "mean":
            e = F.round(e, digits)
        out.append(e.alias(name))
    return out


def kpis(df: DataFrame, metrics: Mapping[str, tuple[str, str]] | None = None,
         digits: int | None = 4) -> DataFrame:
    """A1: global KPIs (row count + means) in one pass."""
    metrics = metrics or {"accuracy": ("mean", "is_correct"), "halluc_rate": ("mean", "hallucination_flag"),
                          "avg_latency": ("mean", "total_latency_ms")}
    return df.agg(F.count(F.lit(1)).alias("total_runs"), *_agg_exprs(metrics, digits))


def group_metrics(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, tuple[str, str]] | None = None,
                  digits: int | None = 4, drop_null_keys: bool = True) -> DataFrame:
    """``groupBy(keys).agg(metrics)`` with pandas semantics (null keys dropped, means rounded)."""
    metrics = metrics or DASHBOARD_METRICS
    src = df
    if drop_null_keys:
        cond = None
        for k in keys:
            cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
        src = src.where(cond)
    return src.groupBy(*keys).agg(*_agg_exprs(metrics, digits))


def breakdown_all_dims(df: DataFrame, dims: Sequence[str], metrics: Mapping[str, tuple[str, str]] | None = None,
                       digits: int | None = 4) -> DataFrame:
    """A2 for every dimension at once: unpivot the dimension columns, then ONE aggregation
    keyed by (dimension, value) instead of one scan per dimension."""
    metrics = metrics or DASHBOARD_METRICS
    needed = sorted({c for _, c in metrics.values()})
    long = df.select(*needed, *[F.col(d).cast("string").alias(d) for d in dims]) \
        .unpivot(needed, list(dims), "dimension", "value")
    return group_metrics(long, ["dimension", "value"], metrics, digits)


def null_profile(df: DataFrame, only_nonzero: bool = True) -> DataFrame:
    """A8 + P9: null count per column (long form), optionally only columns with nulls."""
    cols = df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "col_name", "nulls")
    return long.where(F.col("nulls") > 0) if only_nonzero else long


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A9 (+A15): per column, count of each non-null value; long form (column, value, count)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "col_name", "value")
    return long.where(F.col("value").isNotNull()).groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("count"))


def class_share(df: DataFrame, label: str, digits: int = 4) -> DataFrame:
    """A10 + W1: class counts, share of total, and majority/minority imbalance ratio.

    The share window runs over the already-aggregated classes (a handful of rows)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("class")) \
        .agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy()
    return counts.select(
        "class", "count",
        F.round(F.col("count") / F.sum("count").over(w), digits).alias("share"),
        F.round(F.max("count").over(w) / F.min("count").over(w), digits).alias("imbalance_ratio"),
    )


def smallest_class(df: DataFrame, label: str) -> DataFrame:
    """Size of the smallest class."""
    return df.groupBy(label).count().agg(F.min("count").alias("min_class_size"))


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6, lower_only: bool = True) -> DataFrame:
    """Pairwise-complete Pearson correlation, long form (col_a, col_b, corr).

    Built from plain ``sum`` sufficient statistics instead of n·(n-1)/2 ``corr``
    aggregates (each ``corr`` buffer is six doubles updated with divisions):

    1. centre every column on its mean (one-row aggregate, broadcast) for
       numerical stability;
    2. group rows by their *null pattern* (which columns are null, 62 to a
       number) and sum count, x and x·y of the present columns: one partial
       aggregation, usually a handful of groups, though any number is right;
    3. each pattern's sums go to the pairs whose two columns are both present,
       which is exactly the pairwise-complete sample, and are added up there.

    All of it is one lazy plan. The correlation is null where fewer than two
    rows have both values or one side is constant.
    """
    cols = list(cols)
    n = len(cols)
    x = [F.col(c).cast("double") for c in cols]
    means = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(x)])
    centred = df.crossJoin(F.broadcast(means)).select(*[(c - F.col(f"_m{i}")).alias(f"d{i}") for i, c in enumerate(x)])
    patterns = [sum((F.col(f"d{i}").isNull().cast("long") * (1 << (i - at)) for i in range(at, min(at + 62, n))),
                    F.lit(0).cast("long")).alias(f"pat{at // 62}") for at in range(0, n, 62)]
    d = [F.coalesce(F.col(f"d{i}"), F.lit(0.0)) for i in range(n)]
    by_pattern = centred.groupBy(*patterns).agg(
        F.count(F.lit(1)).alias("cnt"), *[F.sum(d[i]).alias(f"s{i}") for i in range(n)],
        *[F.sum(d[i] * d[j]).alias(f"p{i}_{j}") for i in range(n) for j in range(i + 1)])
    present = F.array(*[F.col(f"pat{i // 62}").bitwiseAND(F.lit(1 << (i % 62)).cast("long")) == 0 for i in range(n)])
    stats = by_pattern.select("cnt", present.alias("present"), F.array(*[f"s{i}" for i in range(n)]).alias("s"),
                              F.array(*[f"p{i}_{j}" for i in range(n) for j in range(i + 1)]).alias("p"))
    pairs = stats.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(F.get("present", F.col("i"))) \
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i")))).where(F.get("present", F.col("j")) & (F.col("i") > F.col("j")))

    def product(a: Column, b: Column) -> Column:
        return F.get("p", (a * (a + 1) / 2).cast("int") + b)

    i, j = F.col("i"), F.col("j")
    sums = pairs.groupBy("i", "j").agg(
        F.sum("cnt").cast("double").alias("n"), F.sum(F.get("s", i)).alias("si"), F.sum(F.get("s", j)).alias("sj"),
        F.sum(product(i, i)).alias("ii"), F.sum(product(j, j)).alias("jj"), F.sum(product(i, j)).alias("ij"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b, cols[a], cols[b]) for a in range(n) for b in range(a)],
                                 "i int, j int, col_a string, col_b string")
    vi, vj = F.col("n") * F.col("ii") - F.col("si") * F.col("si"), F.col("n") * F.col("jj") - F.col("sj") * F.col("sj")
    corr = F.when((F.col("n") >= 2) & (vi > 0) & (vj > 0),
                  F.round((F.col("n") * F.col("ij") - F.col("si") * F.col("sj")) / F.sqrt(vi * vj), digits))
    out = grid.join(sums, ["i", "j"], "left").select("col_a", "col_b", corr.alias("corr"))
    return out if lower_only else out.union(out.select(F.col("col_b"), F.col("col_a"), "corr"))


def histogram(df: DataFrame, col: str, bins: int = 50, digits: int = 6) -> DataFrame:
    """Equal-width histogram between min and max; the top edge is folded into the last bin.

    The bounds are a one-row aggregate joined back (broadcast of a single row)."""
    v = F.col(col).cast("double")
    bounds = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    src = df.select(v.alias("_v")).where(F.col("_v").isNotNull()).crossJoin(F.broadcast(bounds))
    width = (F.col("_hi") - F.col("_lo"))
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.lit(bins), (F.floor((F.col("_v") - F.col("_lo")) / width * bins) + 1).cast("int")))
    counts = src.groupBy(b.cast("int").alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        "bin",
        F.round(F.col("_lo") + (F.col("bin") - 1) * (F.col("_hi") - F.col("_lo")) / bins, digits).alias("bin_lo"),
        F.round(F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins, digits).alias("bin_hi"),
        "count")


def box_stats(df: DataFrame, group: str, value: str, whisker: float = 1.5, digits: int = 4) -> DataFrame:
    """Quartiles (linear interpolation, as numpy/pandas), 1.5·IQR whiskers and outlier count per group.

    Exact and skew-safe: the values are first reduced to a histogram of distinct
    (group, value) counts (partial aggregation); running counts over it come from the
    bucketed ``prefix_sums`` (no task holds a whole group); the value at rank i is the
    smallest value whose running count exceeds i.  Whiskers and outliers are one more
    pass over the histogram joined with its group's fences (one row per group)."""
    from .metrics import prefix_sums

    v = F.col(value).cast("double")
    src = df.where(F.col(group).isNotNull() & v.isNotNull())
    hist = src.groupBy(group, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cum = prefix_sums(hist, "_v", ["_c"], group_cols=[group])
    n = hist.groupBy(group).agg(F.sum("_c").alias("n"))
    c = cum.join(n, group)
    aggs = [F.first("n").alias("n")]
    for name, q in [("q1", 0.25), ("median", 0.5), ("q3", 0.75)]:
        h = (F.col("n") - 1) * q
        lo, hi = F.floor(h), F.ceil(h)
        aggs += [F.min(F.when(F.col("cum__c") > lo, F.col("_v"))).alias(f"_{name}_lo"),
                 F.min(F.when(F.col("cum__c") > hi, F.col("_v"))).alias(f"_{name}_hi"),
                 F.first(h - lo).alias(f"_{name}_f")]
    qs = c.groupBy(group).agg(*aggs)
    qs = qs.select(group, "n", *[(F.col(f"_{m}_lo") + F.col(f"_{m}_f") * (F.col(f"_{m}_hi") - F.col(f"_{m}_lo")))
                                 .alias(m) for m in ["q1", "median", "q3"]])
    qs = qs.withColumns({"lo_fence": F.col("q1") - whisker * (F.col("q3") - F.col("q1")),
                         "hi_fence": F.col("q3") + whisker * (F.col("q3") - F.col("q1"))})
    j = hist.join(qs.select(group, "lo_fence", "hi_fence"), group)
    inside = (F.col("_v") >= F.col("lo_fence")) & (F.col("_v") <= F.col("hi_fence"))
    wh = j.groupBy(group).agg(F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
                              F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
                              F.sum(F.when(~inside, F.col("_c")).otherwise(F.lit(0))).alias("n_outliers"))
    out = qs.join(wh, group)
    return out.select(group, "n", *[F.round(c, digits).alias(c) for c in ["q1", "median", "q3", "whisker_lo",
                                                                           "whisker_hi"]], "n_outliers")


def sample_rows(df: DataFrame, n: int, order_key: Column) -> DataFrame:
    """Deterministic sample without replacement: the ``n`` rows with the smallest ``order_key``
    (e.g. an arithmetic or xxhash64 hash of the row key and a seed).  Plans as TakeOrderedAndProject:
    each task keeps n rows, the driver merges n × tasks."""
    return df.withColumn("_o", order_key).orderBy("_o").limit(n).drop("_o")


def preview(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """First n rows by key (head)."""
    return df.orderBy(F.col(key).asc()).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
