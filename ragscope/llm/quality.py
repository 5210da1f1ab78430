"""Quality rules: fixed limits, then gradient-boosted trees over document statistics, one of them the share of words that
labelled toxic documents have far more often than others.

The trees are grown on labelled documents by histograms of binned statistics, with monotonic constraints on
statistics whose direction is known, and stored as flat numpy node arrays: a batch of documents goes down
every tree level in one indexing step.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, materialise, table
from .words import Words, chunks, word_hashes, words_of

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Labelled documents that the trees are fitted on, at most; the choice is by hash of doc_id.
MAX_TRAIN = 8_000
#: Statistic: +1 if more of it may only raise the score, -1 if it may only lower it, 0 if free.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "digits": 0,
            "exclamations": -1, "stops": 0, "commas": 0, "distinct": +1, "lines": 0, "toxic_words": -1}
#: A toxic word is in so many toxic documents at least, and its log-odds are so many standard errors above 0; of more words
#: than LEXICON, those in most toxic documents count.
LEAST_TOXIC, ERRORS, LEXICON = 3, 3.0, 4_096
#: Training documents get the share from a lexicon of the other parts, as documents to come would.
FOLDS = 4
_NO_WORDS = np.zeros(0, np.int64)

_CLASSES = ["space", "newline", "symbol", "upper", "digit", "exclamation", "stop", "comma", "continuation"]
_CLASS_OF = np.zeros(256, np.uint8)
for _i, _bytes in enumerate([b" \t\v\f\r", b"\n", b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!", b".", b",", bytes(range(128, 192))]):
    _CLASS_OF[list(_bytes)] = _i + 1


def _repeated_words(code: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray, n_codes: int) -> np.ndarray:
    """Per text, the words within windows of 8 words that occur twice or more in it.

    Windows of 2, 4, then 8 words get exact names, each from two names of the size below; only windows that
    occur again in the same text go on.
    """
    covered = np.zeros(len(code) + 1, np.int64)
    end = np.repeat(first + count, count)
    name, alive, names, width = code, np.arange(len(code)), max(n_codes, 1), 1
    while width < WINDOW and len(alive):
        there = np.full(len(code), -1)
        there[alive] = name
        ok = alive + 2 * width <= end[alive]
        at, left = alive[ok], name[ok]
        right = there[np.minimum(at + width, len(code) - 1)]
        at, left, right = at[right >= 0], left[right >= 0], right[right >= 0]
        _, pair = np.unique(left * names + right, return_inverse=True)
        _, name, size = np.unique(doc[at] * (pair.max(initial=0) + 1) + pair, return_inverse=True, return_counts=True)
        again = size[name] > 1
        alive, name, names, width = at[again], name[again], len(size), 2 * width
    np.add.at(covered, alive, 1)
    np.add.at(covered, alive + WINDOW, -1)
    inside = np.cumsum(covered[:-1]) > 0
    return np.bincount(doc[inside], minlength=len(count))


def _plain_hashes(w: Words) -> np.ndarray:
    """Hashes of the distinct words in lower case without ASCII punctuation at their edges; those of nothing are 0."""
    plain = pc.utf8_trim(pc.utf8_lower(w.distinct), characters=string.punctuation)
    return np.where(pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0, word_hashes(plain).view(np.int64), 0)


def _share(w: Words, words: np.ndarray) -> np.ndarray:
    """Share of each text's words that are in ``words``."""
    if not len(words) or not len(w.code):
        return np.zeros(len(w.count))
    return np.bincount(w.doc, np.isin(_plain_hashes(w), words)[w.code], len(w.count)) / np.maximum(w.count, 1)


def document_stats(texts: pa.Array, lexicon: np.ndarray = _NO_WORDS) -> dict[str, np.ndarray]:
    """The contract's counts and the trees' statistics of some texts. An empty text has zeros throughout."""
    w, n = words_of(texts), len(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    kinds = np.bincount(np.repeat(np.arange(n) * 16, size) + _CLASS_OF[data], minlength=n * 16).reshape(n, 16)
    of = {k: kinds[:, i + 1] for i, k in enumerate(_CLASSES)}
    dup = np.zeros(n, np.int64)
    for i in np.flatnonzero(of["newline"]):
        lines = [x for x in texts[int(i)].as_py().split("\n") if x.strip(" \t\n\v\f\r")]
        dup[i] = len(lines) - len(set(lines))
    pairs = np.unique(w.doc * (len(w.distinct) + 1) + w.code)
    distinct = np.bincount(pairs // (len(w.distinct) + 1), minlength=n)
    repeat = _repeated_words(w.code, w.doc, w.first, w.count, len(w.distinct))
    chars = size - of["continuation"] - of["space"] - of["newline"]
    words, total = np.maximum(w.count, 1), np.maximum(size, 1)
    stats = [np.log1p(w.count), chars / words, of["symbol"] / words, dup / (of["newline"] + 1), repeat / words, of["upper"] / total,
             of["digit"] / total, of["exclamation"] / words, of["stop"] / words, of["comma"] / words, distinct / words, of["newline"] / words,
             _share(w, lexicon)]
    return {"n_words": w.count, "word_chars": chars, "n_symbols": of["symbol"], "n_dup_lines": dup, "n_repeat_words": repeat,
            "features": np.stack(stats, 1)}


@dataclass
class Trees:
    """Complete trees of one depth as flat arrays: node i of tree t goes to 2i + 1, or 2i + 2 above the threshold."""
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    #: Hashes of the toxic words.
    lexicon: np.ndarray = field(default_factory=lambda: _NO_WORDS)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int], n_trees: int = 60, depth: int = 3, rate: float = 0.2,
              n_bins: int = 64, l2: float = 1.0) -> Trees | None:
    """Logistic boosting; None if there are not two classes to tell apart.

    A split on a constrained statistic is taken only if its sides' values have the right order, and bounds at their
    middle hold below it, so that no later split can undo the order.
    """
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    score, inner = np.full(len(y), base), 2**depth - 1
    out = Trees(np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.zeros((n_trees, inner + 1)), base)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            low, high = bounds[i]
            best = (1e-6, None, 0, 0.0, 0.0)
            g, h = grad[rows].sum(), hess[rows].sum()
            for f, c in enumerate(cuts):
                if not len(rows) or not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(c) + 1))[:-1]
                left, right = np.clip(gl / (hl + l2), low, high), np.clip((g - gl) / (h - hl + l2), low, high)
                gain = gl * left - (hl + l2) * left**2 / 2 + (g - gl) * right - (h - hl + l2) * right**2 / 2 - g * g / (h + l2) / 2
                gain = np.where((hl > 1e-3) & (h - hl > 1e-3) & (directions[f] * (right - left) >= 0), gain, -np.inf)
                if (k := int(gain.argmax())) >= 0 and gain[k] > best[0]:
                    best = (gain[k], f, k, left[k], right[k])
            bounds[2 * i + 1] = bounds[2 * i + 2] = (low, high)
            _, f, k, left, right = best
            if f is not None:
                out.feature[t, i], out.threshold[t, i] = f, cuts[f][k]
                middle = (left + right) / 2
                if directions[f]:
                    less, more = (low, middle), (middle, high)
                    bounds[2 * i + 1], bounds[2 * i + 2] = (less, more) if directions[f] > 0 else (more, less)
                node[rows] = 2 * i + 1 + (binned[rows, f] > k)
            else:
                node[rows] = 2 * i + 1
        for leaf in range(inner + 1):
            rows = node == inner + leaf
            low, high = bounds[inner + leaf]
            out.value[t, leaf] = rate * np.clip(grad[rows].sum() / (hess[rows].sum() + l2), low, high)
        score += out.value[t][node - inner]
    return out


def toxic_words(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Which words are toxic, by the documents of each kind that have them."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    return (toxic >= LEAST_TOXIC) & (odds >= ERRORS * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5)))


def _lexicons(rows: DataFrame) -> list[np.ndarray]:
    """Toxic words of all labelled documents, then of those outside each fold."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            w = words_of(texts)
            pairs = np.unique(np.stack([w.doc, _plain_hashes(w)[w.code] if len(w.code) else w.code]), axis=1)
            doc, word = pairs[:, pairs[1] != 0]
            yield pa.record_batch([batch.column("fold").take(pa.array(doc)), batch.column("toxic").take(pa.array(doc)), pa.array(word)], names=["fold", "toxic", "word"])

    size, counts = np.zeros((FOLDS, 2), np.int64), [[F.count(F.when((F.col("fold") == f) & (F.col("toxic") == t), 1)) for t in (1, 0)] for f in range(FOLDS)]
    for f, t, n in rows.groupBy("fold", "toxic").count().collect():
        size[f, 1 - t] = n
    if not size[:, 0].sum():
        return [_NO_WORDS] * (FOLDS + 1)
    toxic = F.count(F.when(F.col("toxic") == 1, 1))
    seen = (rows.select("fold", "toxic", "text").mapInArrow(words, "fold int, toxic int, word long").groupBy("word")
            .agg(toxic.alias("n"), *[c.alias(f"c{f}_{t}") for f, two in enumerate(counts) for t, c in enumerate(two)]).where(F.col("n") >= LEAST_TOXIC))
    total = sum((F.col(f"c{f}_1") for f in range(FOLDS)), F.lit(0))
    # common words go before the words are collected; what is left is ordered, so that any run has the same
    likely = seen.where(F.col("n") * int(size[:, 1].sum() + 1) > total * int(size[:, 0].sum() + 1))
    got = likely.orderBy(F.col("n").desc(), total, "word").limit(LEXICON).collect()
    if not got:
        return [_NO_WORDS] * (FOLDS + 1)
    word = np.array([r["word"] for r in got], np.int64)
    count = np.array([[[r[f"c{f}_{t}"] for t in (0, 1)] for f in range(FOLDS)] for r in got])
    out = []
    for without in (None, *range(FOLDS)):
        folds = [f for f in range(FOLDS) if f != without]
        c, n = count[:, folds].sum(1), size[folds].sum(0)
        out.append(np.sort(word[toxic_words(c[:, 0], c[:, 1], *n)]))
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees | None:
    """Trees from at most ``max_train`` labelled documents, chosen by hash of doc_id, so that any run has the same
    sample. Good are documents of quality 1 that are not labelled toxic. Rows without id or label are left out; no labels, or
    one class only, give None."""
    marked = labels.select("doc_id", F.col("quality").cast("double").alias("quality"), F.coalesce(column_or_null(labels, "toxic", "int"), F.lit(0)).alias("toxic"))
    chosen = (marked.where("doc_id is not null and (quality is not null or toxic = 1)")
              .withColumn("quality", F.when(F.col("toxic") == 1, 0.0).otherwise(F.col("quality")))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(max_train)
              .withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")))
    rows = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    lexicons = _lexicons(rows)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            x, w = document_stats(texts)["features"], words_of(texts)
            x[:, -1] = np.stack([_share(w, v) for v in lexicons[1:]])[batch.column("fold").to_numpy(), np.arange(len(x))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))],
                                  names=["doc_id", "quality", "x"])

    got = rows.select("doc_id", "quality", "fold", "text").mapInArrow(stats, "doc_id long, quality double, x array<double>").orderBy("doc_id", "x", "quality").collect()
    if not got:
        return None
    trees = fit_trees(np.array([r["x"] for r in got]), np.array([r["quality"] for r in got]), list(FEATURES.values()))
    return replace(trees, lexicon=lexicons[0]) if trees else None


def _verdict(trees: Trees | None, stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])
    good = trees.score(stats["features"]) >= 0 if trees else np.ones(len(failed), bool)
    return failed, ~failed & good


def quality_rules(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, the counts, ``base_failed`` and ``kept`` of every row. A null text has no words and fails; repeated rows
    are judged alike; other columns are ignored; without trees the fixed limits alone decide."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            stats = document_stats(texts, trees.lexicon if trees else _NO_WORDS)
            failed, kept = _verdict(trees, stats)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(stats[c], pa.int64()) for c in names], pa.array(failed), pa.array(kept)],
                                  names=["doc_id", *names, "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_quality(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield batch.filter(pa.array(_verdict(trees, document_stats(texts, trees.lexicon if trees else _NO_WORDS))[1]))

    return docs.mapInArrow(keep, docs.schema)


def op3_quality_trees(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
