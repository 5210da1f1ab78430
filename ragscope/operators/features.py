"""Feature engineering.

The whole feature matrix is ONE projection: one-hot, ordinal, interaction and
text columns are column expressions evaluated in a single whole-stage-codegen
span (no chain of ``withColumn``, no per-column frame copies).  The only
driver round trip is the category vocabulary, a bounded list of distinct values
(see ``artifacts.categories_dict``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import (DIFFICULTY_ORDER, FLAG_FEATURES, INTERACTION_FEATURES, NOMINAL_FEATURES, NUMERIC_FEATURES,
                      TEXT_FEATURES)
from ..session import cut_lineage
from ..sources.artifacts import categories_dict
from .metrics import prefix_sums


def one_hot_exprs(categories: Mapping[str, Sequence[str]]) -> list[Column]:
    """``col_value`` 0/1 int columns for every known value (null / unseen → all zeros)."""
    return [S.equals_as_int(c, v).alias(f"{c}_{v}") for c, vals in categories.items() for v in vals]


def one_hot_names(categories: Mapping[str, Sequence[str]]) -> list[str]:
    return [f"{c}_{v}" for c, vals in categories.items() for v in vals]


def difficulty_ord(col: str = "difficulty") -> Column:
    """Easy < medium < hard → 0, 1, 2; unknown or null → 1."""
    return S.ordinal(col, DIFFICULTY_ORDER, 1).alias("difficulty_ord")


def interaction_exprs(ord_col: Column | None = None) -> list[Column]:
    """The five interaction features."""
    ordc = ord_col if ord_col is not None else S.ordinal("difficulty", DIFFICULTY_ORDER, 1)
    return [
        (F.col("top1_score") * ordc).alias("retrieval_x_difficulty"),
        (F.col("recall_at_5") * F.col("n_retrieved_chunks")).alias("recall5_x_nchunks"),
        (F.col("top1_score") - F.col("mean_retrieved_score")).alias("score_gap"),
        S.guarded_ratio("latency_ms_generation", "latency_ms_retrieval").alias("latency_ratio"),
        S.guarded_ratio("total_cost_usd", "prompt_tokens", "answer_tokens").alias("cost_per_token"),
    ]


def text_exprs(col: str = "query") -> list[Column]:
    """E5: character length and whitespace word count of the query (F1, F2)."""
    return [S.char_length(col).alias("query_len"), S.word_count(col).alias("query_word_count")]


def engineer_features(df: DataFrame, categories: Mapping[str, Sequence[str]] | None = None,
                      keep: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The full feature set in one ``select``; returns (DataFrame, ordered feature names).

    ``categories`` defaults to the distinct values found in ``df`` (the
    reference learns them from all rows).  ``keep``: extra columns carried
    through (keys, targets, split); default = every input column."""
    cols = set(df.columns)
    cats = categories if categories is not None else categories_dict(df, [c for c in NOMINAL_FEATURES if c in cols])
    cats = {c: v for c, v in cats.items() if c in cols}
    numeric = [c for c in NUMERIC_FEATURES if c in cols]
    flags = [c for c in FLAG_FEATURES if c in cols]
    exprs: list[Column] = []
    names: list[str] = numeric + flags
    ord_expr = S.ordinal("difficulty", DIFFICULTY_ORDER, 1) if "difficulty" in cols else F.lit(1)
    exprs.append(ord_expr.alias("difficulty_ord"))
    names.append("difficulty_ord")
    exprs += one_hot_exprs(cats)
    names += one_hot_names(cats)
    exprs += interaction_exprs(ord_expr)
    names += INTERACTION_FEATURES
    if "query" in cols:
        exprs += text_exprs("query")
        names += TEXT_FEATURES
    carried = list(keep) if keep is not None else [c for c in df.columns if c not in set(names)]
    return df.select(*[F.col(c) for c in carried], *[F.col(c) for c in numeric + flags], *exprs), names


def feature_matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """P10: exactly ``features`` in order; absent columns as 0; nulls (and NaN) → 0."""
    present = set(df.columns)
    cols = [F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f)
            if f in present else F.lit(0.0).alias(f) for f in features]
    return df.select(*[F.col(k) for k in keep], *cols)


def split_data(df: DataFrame, features: Sequence[str], split_col: str = "split",
               keep: Sequence[str] = ()) -> dict[str, DataFrame]:
    """train/val/test frames and their null-filled feature matrices (filters push to the scan)."""
    out: dict[str, DataFrame] = {}
    for s in ("train", "val", "test"):
        part = df.where(F.col(split_col) == s)
        out[s] = part
        out[f"X_{s}"] = feature_matrix(part, features, keep)
    return out


def split_counts(df: DataFrame, n_features: int, split_col: str = "split") -> DataFrame:
    """P5 sizes: rows per split in one aggregation, plus the feature-matrix width."""
    return df.groupBy(F.col(split_col).alias("split")).agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("n_features", F.lit(n_features))


#: Entries of a dictionary that become literals of a plan; a longer one is joined.
LITERALS = 1_000


def dictionary(df: DataFrame, cols: Sequence[str], null_text: str | None = "nan") -> DataFrame:
    """(col_name, value, code) of the distinct values of each column, codes from 0 in text order. Nulls count as
    ``null_text`` (None: not at all). Any number of values: ranks are running counts over range partitions."""
    text = [F.col(c).cast("string") if null_text is None else F.coalesce(F.col(c).cast("string"), F.lit(null_text)) for c in cols]
    values = df.select(*[t.alias(c) for t, c in zip(text, cols)]).unpivot([], list(cols), "col_name", "value") \
        .where(F.col("value").isNotNull()).distinct().withColumn("_one", F.lit(1).cast("long"))
    ranked = prefix_sums(values, "value", ["_one"], inclusive=False, group_cols=["col_name"])
    return ranked.select("col_name", "value", F.col("cum__one").cast("int").alias("code"))


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "_enc", null_text: str = "nan") -> DataFrame:
    """Alphabetical integer codes per column (values cast to text; null → ``null_text``, as the notebook did).

    A short dictionary becomes a literal map, so encoding is one projection with no join; a longer one is
    joined column by column, whatever its size."""
    codes = cut_lineage(dictionary(df, cols, null_text))
    rows = codes.limit(LITERALS + 1).collect()
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(null_text)) for c in cols}
    if len(rows) <= LITERALS:
        maps = {c: [x for r in rows if r["col_name"] == c for x in (F.lit(r["value"]), F.lit(r["code"]))] for c in cols}
        return df.select("*", *[(F.element_at(F.create_map(*m), text[c]) if (m := maps[c]) else F.lit(None)).cast("int").alias(f"{c}{suffix}") for c in cols])
    out = df
    for c in cols:
        own = codes.where(F.col("col_name") == c).select(F.col("value").alias(f"_{c}_value"), F.col("code").alias(f"{c}{suffix}"))
        out = out.withColumn(f"_{c}_value", text[c]).join(own, f"_{c}_value", "left").drop(f"_{c}_value")
    return out.select(*df.columns, *[f"{c}{suffix}" for c in cols])


def decode(df: DataFrame, col: str, codes: DataFrame, code_col: str, out: str) -> DataFrame:
    """E7 inverse: the value of column ``col`` that each code stands for, by its dictionary; an unknown code has none."""
    own = codes.where(F.col("col_name") == col).select(F.col("code").alias("_code"), F.col("value").alias(out))
    return df.join(own, F.col(code_col) == F.col("_code"), "left").drop("_code")


def one_hot_slots(df: DataFrame, cols: Sequence[str], out: str = "slots") -> DataFrame:
    """E2 for vocabularies of any size: the ascending slots that are 1, of a vector with one slot per (column, value) in the
    order of ``cols`` and codes. Nulls have no slot."""
    codes = cut_lineage(dictionary(df, cols, None))
    sizes = dict(codes.groupBy("col_name").agg(F.count(F.lit(1))).collect())   # one row per column
    first = {c: sum(sizes.get(x, 0) for x in cols[:i]) for i, c in enumerate(cols)}
    encoded = df
    for c in cols:
        own = codes.where(F.col("col_name") == c).select(F.col("value").alias(f"_{c}_value"), (F.col("code") + first[c]).alias(f"_{c}_slot"))
        encoded = encoded.join(own, F.col(c).cast("string") == F.col(f"_{c}_value"), "left")
    return encoded.select(*df.columns, F.array_compact(F.array(*[f"_{c}_slot" for c in cols])).alias(out))


def zscore(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x − mean) / population std over the whole table, nulls → 0 first; constant column → divide by 1.

    Statistics are one aggregated row joined to every row (a one-row broadcast)."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    stats = df.agg(*[F.avg(filled[c]).alias(f"_m_{c}") for c in cols],
                   *[F.stddev_pop(filled[c]).alias(f"_s_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(stats))
    exprs = [((filled[c] - F.col(f"_m_{c}")) /
              F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))).alias(f"{c}{suffix}")
             for c in cols]
    return j.select(*[F.col(x) for x in df.columns], *exprs)
