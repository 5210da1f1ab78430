"""Languages of documents as mixtures of n-gram distributions.

Each learned language is a distribution over letter trigrams. A document's trigrams are drawn from a mixture of
languages, whose proportions expectation-maximisation estimates. The set of languages grows from the most likely one by
the language in whose direction the likelihood rises most, as long as the penalised likelihood rises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import chunks, mix

#: Hash values of trigrams, and the pseudo-count of each.
BUCKETS, PSEUDO = 1 << 16, 0.5
#: Labelled documents of a language that it is learned from, at most, and languages that a model has, at most.
MAX_TRAIN, MAX_LANGUAGES = 4_000, 1_000
#: Letters of a text that are looked at together; trigrams of overlapping letters count as a third of a draw each.
PIECE, OVERLAP = 1 << 20, 3
TOLERANCE, ROUNDS = 1e-3, 100


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _trigrams(text: str, lead: int = 0, trail: int = 0) -> np.ndarray:
    """Hashed trigrams around each letter but the first ``lead`` and last ``trail`` characters; everything between
    words is one boundary."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_is_letter()[code], code, 0).astype(np.uint64)
    code = np.concatenate([[np.uint64(0)], code, [np.uint64(0)]])
    code = code[np.append(True, (code[1:] != 0) | (code[:-1] != 0))]
    at = np.flatnonzero(code)
    at = at[lead and int(_is_letter()[ord(text[0])]):len(at) - (trail and int(_is_letter()[ord(text[-1])]))]
    if not len(at):
        return np.zeros(0, np.int64)
    return (mix((code[at - 1] << np.uint64(42)) | (code[at] << np.uint64(21)) | code[at + 1]) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash values of a text and how often each occurs; a long text is added up piece by piece, each with
    the characters beside it."""
    if len(text) <= PIECE:
        return np.unique(_trigrams(text), return_counts=True)
    total = np.zeros(BUCKETS, np.int64)
    for s in range(0, len(text), PIECE):
        lead, trail = int(s > 0), int(s + PIECE < len(text))
        total += np.bincount(_trigrams(text[s - lead:s + PIECE + trail], lead, trail), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch, texts in chunks(batches, "text"):
        yield batch, pc.utf8_lower(texts).to_pylist()


@dataclass(frozen=True)
class Languages:
    """Learned languages in code-point order and the logarithms of their trigram probabilities (BUCKETS x languages)."""
    names: list[str]
    log_p: np.ndarray

    def mixture(self, found: np.ndarray, count: np.ndarray) -> list[tuple[str, float]]:
        """The languages of a document and their proportions, largest first (ties: code-point order)."""
        log_p = self.log_p[found].astype(np.float64)
        n = count.sum()
        first = int(np.argmax(count @ log_p))
        ratio = np.exp(log_p - log_p[:, [first]])  # relative to the most likely language
        chosen, share, score = [first], np.ones(1), 0.0
        while len(chosen) < len(self.names):
            rise = (count / (ratio[:, chosen] @ share)) @ ratio / n
            rise[chosen] = 0
            new = int(np.argmax(rise))
            if rise[new] <= 1:
                break
            tried, gain = _proportions(ratio[:, chosen + [new]], count, np.append(share * 0.9, 0.1))
            penalised = gain / OVERLAP - 0.5 * len(chosen) * np.log(max(n / OVERLAP, 2))
            if penalised <= score:
                break
            chosen, share, score = chosen + [new], tried, penalised
        return [(self.names[chosen[k]], float(share[k])) for k in sorted(range(len(chosen)), key=lambda k: (-share[k], chosen[k]))]


def _proportions(ratio: np.ndarray, count: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture proportions by expectation-maximisation and the log-likelihood that they reach."""
    n = count.sum()
    for _ in range(ROUNDS):
        new = share * ((count / (ratio @ share)) @ ratio) / n
        done = np.abs(new - share).max() < TOLERANCE
        share = new
        if done:
            break
    return share / share.sum(), float(count @ np.log(ratio @ share))


def fit_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                  max_train: int = MAX_TRAIN) -> Languages:
    """Learn trigram distributions from about ``max_train`` documents of each language, all where it has fewer: those
    whose digest of the id lies in the language's share. Rows without language or text teach nothing. Counted in
    tasks, summed by Spark; the table that comes to the driver has at most BUCKETS numbers per language, for at most
    MAX_LANGUAGES languages."""
    spark = docs.sparkSession
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text).cast("binary"))).alias("id"))
    rows = dict(labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    names = sorted(rows)
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"the column {lang} has more than {MAX_LANGUAGES} languages")
    place = {name: k for k, name in enumerate(names)}
    shares = spark.createDataFrame([(name, max_train / n) for name, n in rows.items()], "lang string, share double")
    chance = F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    sample = labelled.join(F.broadcast(shares), "lang").where(chance < F.col("share"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch, texts in _texts(batches):
            for name, t in zip(batch.column(0).to_pylist(), texts):
                found, n = _counts(t)
                if name not in total:
                    total[name] = np.zeros(BUCKETS, np.int64)
                total[name][found] += n
        for name, n in total.items():
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([place[name]] * len(found), pa.int32()), pa.array(found, pa.int32()), pa.array(n[found])], ["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    total = np.full((BUCKETS, len(names)), PSEUDO)
    total[counted["gram"].to_numpy(), counted["lang"].to_numpy()] += counted["n"].to_numpy()
    return Languages(names, np.log(total / total.sum(0)).astype(np.float32))


def language_mixtures(docs: DataFrame, model: Languages, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of each row, ``languages`` and their ``proportions`` (largest first), ``lang_pred`` (the largest)
    and ``score`` (its proportion). Kept columns of these names are replaced.

    Null texts and texts without a letter, and all texts if no language was learned, have no languages, ``und`` as
    prediction and score 0. A text of any length is counted piece by piece. Rows stand for themselves: repeated rows
    are predicted alike, an empty table gives an empty result, and only the text counts for a prediction.
    """
    made = "languages array<string>, proportions array<double>, lang_pred string, score double"
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("languages", "proportions", "lang_pred", "score")]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most BUCKETS x MAX_LANGUAGES numbers
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))

    def predict(batches):
        languages = shared.value
        for batch, texts in _texts(batches):
            out = []
            for t in texts:
                found, count = _counts(t)
                out.append(languages.mixture(found, count) if len(found) and languages.names else [])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([[n for n, _ in m] for m in out], pa.list_(pa.string())),
                pa.array([[s for _, s in m] for m in out], pa.list_(pa.float64())),
                pa.array([m[0][0] if m else "und" for m in out], pa.string()), pa.array([m[0][1] if m else 0.0 for m in out], pa.float64()),
            ], ["row", "languages", "proportions", "lang_pred", "score"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(predict, f"row {kind}, {made}").select("row.*", "languages", "proportions", "lang_pred", "score")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text (null: empty) leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op11_language_mixture(spark, sf_dir: str) -> DataFrame:
    """All documents with languages learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    mixed = language_mixtures(docs, fit_languages(docs.where(~F.col("held_out"))), keep=["doc_id", "held_out"])
    return mixed.select("doc_id", "held_out", "lang_pred", "score", F.size("languages").alias("n_languages"))
