"""Benchmark decontamination by latent semantic retrieval.

Words are hashed once and written as a table that all later passes read. Texts are cut into blocks of 16 words, TF-IDF
vectors over hashed words, whose frequencies come from all documents. A randomised SVD of all blocks (one distributed
pass of the sketch A^T A W, finished by a small factorisation) gives the latent space. An item is looked for in
passages about as long as itself (8, 16, 32, ... words) at half stride. Passages near it in the latent space are
candidates, and a candidate counts when the longest common subsequence of words with the item, within a span
little longer than the item, and the item's answer, if it has one, confirm it. Items too short for that are looked up by
the hash of their words in a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, materialise, table
from .words import chunks, mix, slices, words_of

FEATURES = 1 << 14  # a power of two
BLOCK = 16
RANK, OVERSAMPLE = 48, 8
SEED = 7
#: Cosine from which a passage of so many words is a candidate; longer passages take the last. Short ones have more foreign
#: words beside a displaced item.
NEAR = {8: 0.28, 16: 0.28, 32: 0.36, 64: 0.42}
#: Share of an item's words that a common subsequence has to have.
OVERLAP = 0.6
#: Items of fewer words must occur whole, word after word.
SHORT = 8
#: Benchmark items that one pass over the documents takes; more items take more passes.
ITEMS_PER_PASS = 2_000
#: Features per row in which tasks hand on their parts of the sketch.
STRIP = 256
#: Punctuation at a word's edges that doesn't count.
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—"
_ANSWER = re.compile(r"(?i)(?:^|\s)(?:answer|a)\s*:")
_PIECE = 1 << 20
_WORDS = 1 << 12


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _normal_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of lower-cased words without edge punctuation; 0 where nothing is left."""
    words = pc.utf8_trim(pc.utf8_lower(distinct), characters=_EDGE)
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset: words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    size = np.diff(offsets)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0]: offsets[-1]]
    start = np.cumsum(size) - size
    out = np.zeros(len(size), np.uint64)
    for i in range(0, len(size), _WORDS):  # few enough to stay in the cache
        part, first = size[i: i + _WORDS], start[i: i + _WORDS]
        some, piece = part > 0, data[first[0]: first[-1] + part[-1]]
        if not some.any():
            continue
        within = np.arange(len(piece)) - np.repeat(first - first[0], part)
        value = _BYTES[piece]
        if part.max() > len(_POWERS):  # in such a word the powers start again, with other values
            far = np.flatnonzero(np.repeat(part > len(_POWERS), part))
            value[far] = mix(piece[far].astype(np.uint64) + np.uint64(1) + np.uint64(257) * (within[far] >> 16).astype(np.uint64))
        value *= _POWERS[within & 0xFFFF]
        out[i: i + _WORDS][some] = mix(np.add.reduceat(value, first[some] - first[0])) | np.uint64(1)
    return out


@dataclass
class Blocks:
    """Words of some texts: ``hash`` and ``feature`` of each, its ``block``, and of each block its first word and text."""
    hash: np.ndarray
    feature: np.ndarray
    block: np.ndarray
    start: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray
    size: int = BLOCK


def hashes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, end to end, and words per text."""
    w = words_of(texts)
    h = _normal_hashes(w.distinct)[w.code] if len(w.code) else np.zeros(0, np.uint64)
    real = h != 0
    return h[real], np.bincount(w.doc[real], minlength=len(texts))


def blocks_of(h: np.ndarray, count: np.ndarray, size: int = BLOCK, feature: np.ndarray | None = None) -> Blocks:
    """Blocks of ``size`` words; features are worked out where they are not given."""
    first, blocks = np.cumsum(count) - count, -(-count // size)
    doc = np.repeat(np.arange(len(count)), blocks)
    start = first[doc] + size * (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    block = np.repeat(np.arange(len(start)), np.diff(start, append=len(h)))
    if feature is None:
        feature = (mix(h) & np.uint64(FEATURES - 1)).astype(np.int64)
    return Blocks(h, feature, block, start, doc, first, count, size)


def word_table(docs: DataFrame) -> DataFrame:
    """doc_id, the text's digest and its words' 64-bit hashes, for every row with a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            for s in slices(texts, _PIECE):
                h, count = hashes_of(texts.slice(s.start, s.stop - s.start))
                offsets = np.concatenate([[0], np.cumsum(count) * 8]).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(h)])
                yield pa.record_batch([*batch.slice(s.start, s.stop - s.start).select(["doc_id", "digest"]).columns, words], names=["doc_id", "digest", "words"])

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), "text")
    return materialise(rows.mapInArrow(run, "doc_id long, digest string, words binary"), "words")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Blocks]]:
    for batch in batches:
        words = batch.column(batch.schema.get_field_index("words"))
        for s in slices(words, _PIECE):
            part = words.slice(s.start, s.stop - s.start)
            offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset: part.offset + len(part) + 1]
            data = part.buffers()[2]
            h = np.frombuffer(data, np.uint64, (offsets[-1] - offsets[0]) // 8, offsets[0]) if data and offsets[-1] > offsets[0] else np.zeros(0, np.uint64)
            yield batch.slice(s.start, s.stop - s.start), blocks_of(h, np.diff(offsets) // 8)


def block_frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """In how many blocks each feature occurs, and the blocks of all documents. Tasks hand on one count per feature."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = np.zeros(FEATURES + 1, np.int64), 0
        for _, b in _pieces(batches):
            rows = np.sort(_rows(b, b.feature, -1), axis=1)
            first = np.diff(rows, axis=1, prepend=-1) != 0
            got[:-1] += np.bincount(rows[first], minlength=FEATURES)
            got[-1] += len(b.start)
        seen = np.flatnonzero(got)
        yield pa.record_batch([pa.array(seen), pa.array(got[seen])], names=["feature", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    for f, n in words.select("words").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():
        out[f] = n
    return out[:-1], int(out[-1])


def _rows(b: Blocks, values: np.ndarray, empty) -> np.ndarray:
    """Values per word as one row per block."""
    out = np.full((len(b.start), b.size), empty, values.dtype)
    out[b.block, np.arange(len(values)) - b.start[b.block]] = values
    return out


def _block_sums(b: Blocks, weight: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per block, the sum of its words' weighted vectors, a thousand blocks at a time to stay in the cache."""
    feature, weight = _rows(b, b.feature, 0), _rows(b, weight, 0)
    out = np.zeros((len(feature), vectors.shape[1]), np.float32)
    for i in range(0, len(feature), 1024):
        part = out[i: i + 1024]
        for j in range(b.size):
            part += vectors[feature[i: i + 1024, j]] * weight[i: i + 1024, j, None]
    return out


def _weights(b: Blocks, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of each word occurrence, blocks scaled to length 1 (as if no word of a block repeated)."""
    w = idf[b.feature]
    norm = np.sqrt(np.add.reduceat(w * w, b.start)) if len(b.start) else np.zeros(0)
    return (w / np.maximum(norm, 1e-9)[b.block]).astype(np.float32)


def _directions() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((FEATURES, RANK + OVERSAMPLE)).astype(np.float32)


def latent_space(words: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Features x RANK, from words to latent coordinates scaled to equal variance, and the words' IDF; None without words.

    The randomised SVD needs A^T (A W) for the block matrix A and random directions W. Each task adds up its blocks'
    part; parts travel in strips of features and are added as they arrive, whatever their number. The driver gets the sum: FEATURES x 80 numbers.
    """
    df, n = block_frequencies(words)
    if not n:
        return None
    idf = np.log((n + 1) / (df + 1)).astype(np.float32)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = _directions()
        total = np.zeros((FEATURES, RANK + OVERSAMPLE), np.float32)
        for _, b in _pieces(batches):
            if not len(b.start):
                continue
            w = _weights(b, idf)
            y = _block_sums(b, w, random)
            order = np.argsort(b.feature.astype(np.uint16), kind="stable")
            f, block, w = b.feature[order], b.block[order], w[order, None]
            for i in range(0, len(f), 1024):  # few enough to stay in the cache
                part = f[i: i + 1024]
                at = np.flatnonzero(np.diff(part, prepend=-1))
                total[part[at]] += np.add.reduceat(y[block[i: i + 1024]] * w[i: i + 1024], at)
        if total.any():
            strips = [total[i: i + STRIP].tobytes() for i in range(0, FEATURES, STRIP)]
            yield pa.record_batch([pa.array(range(len(strips)), pa.int32()), pa.array(strips, pa.binary())], names=["strip", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for strip, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[strip] = sums.get(strip, 0) + np.frombuffer(part, np.float32).astype(np.float64)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["strip", "part"])

    parts = words.select("words").mapInArrow(sketch, "strip int, part binary").repartition("strip").mapInArrow(add, "strip int, part binary").collect()
    z = np.concatenate([np.frombuffer(r["part"]).reshape(STRIP, -1) for r in sorted(parts, key=lambda r: r["strip"])])
    q, _ = np.linalg.qr(z)
    small = (q.T @ z) @ np.linalg.pinv(q.T @ _directions().astype(np.float64))  # about Q^T A^T A Q
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    values, vectors = values[::-1][:RANK], vectors[:, ::-1][:, :RANK]
    scale = 1 / np.sqrt(np.maximum(values, values[0] * 1e-9))
    return (idf[:, None] * (q @ vectors) * scale).astype(np.float32), idf


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]


def benchmark_items(rows) -> list[Item]:
    """Items of (item_id, text[, answer]); an answer may also follow "Answer:" or "A:" in the text. Items without
    words are left out."""
    def hashes(text: str | None) -> list[int]:
        return [int(x) for x in hashes_of(pa.array([text or ""]))[0]]

    out = []
    for row in rows:
        question, *rest = _ANSWER.split(row["text"] or "", maxsplit=1)
        answer = row["answer"] if "answer" in row and row["answer"] else rest[0] if rest else None
        if words := hashes(question) or hashes(answer):
            out.append(Item(row["item_id"], words, hashes(answer) if answer else []))
    return out


def lcs(bits: dict[int, int], length: int, words: list[int]) -> int:
    """Longest common subsequence with an item, whose words' places are the bits of ``bits``."""
    row = (1 << length) - 1
    full = row
    for w in words:
        if m := bits.get(w):
            u = row & m
            row = (row + u) | (row - u)
            row &= full
    return length - row.bit_count()


def _contains(words: list[int], part: list[int]) -> bool:
    return any(words[i: i + len(part)] == part for i in range(len(words) - len(part) + 1))


class Matcher:
    """Confirms that a stretch of words has an item."""

    def __init__(self, items: list[Item], overlap: float):
        self.items, self.overlap = items, overlap
        self.bits: list[dict[int, int]] = []
        for item in items:
            bits: dict[int, int] = {}
            for i, w in enumerate(item.words):
                bits[w] = bits.get(w, 0) | 1 << i
            self.bits.append(bits)

    def best(self, i: int, words: list[int]) -> int:
        """Words of item i in the best common subsequence of a span; 0 if too few, or without the item's answer."""
        item, bits = self.items[i], self.bits[i]
        n = len(item.words)
        need = ceil(self.overlap * n)
        seen = set(words)
        if sum(m.bit_count() for w, m in bits.items() if w in seen) < need:
            return 0
        if item.answer and not _contains(words, item.answer):
            return 0
        if n < SHORT:
            return n if _contains(words, item.words) else 0
        span, most = ceil(1.25 * n), 0
        for at in range(0, max(1, len(words) - span + n // 8 + 1), max(1, n // 8)):
            most = max(most, lcs(bits, n, words[at: at + span]))
        return most if most >= need else 0


def passage_words(n: int) -> int:
    """Words of the passages in which an item of n words is looked for: the nearest power of two."""
    return 1 << max(3, round(log2(n)))


def _scanner(space: np.ndarray, idf: np.ndarray, items: list[Item], near: float | None, overlap: float):
    matcher = Matcher(items, overlap)
    by_half: dict[int, list[int]] = {}
    in_a_row: dict[int, list[int]] = {}
    for k, item in enumerate(items):
        n = len(item.words)
        (in_a_row.setdefault(n, []) if n < SHORT else by_half.setdefault(passage_words(n) // 2, [])).append(k)

    def targets(half: int) -> tuple[np.ndarray, ...]:
        """Items of one passage length, their latent directions, the number of each feature among those of the items' words
        (0: none of them), IDF of an item's words by that number, the least that a passage and half a passage to either side
        of it have where ``overlap`` of the words are there, and the cosine limit."""
        of = np.array(by_half[half])
        features = [(mix(np.array(items[k].words, np.uint64)) & np.uint64(FEATURES - 1)).astype(np.int64) for k in of.tolist()]
        known = np.unique(np.concatenate(features))
        number = np.zeros(FEATURES + 1, np.int64)
        number[known] = np.arange(1, len(known) + 1)
        target, weight, least = [], np.zeros((len(of), len(known) + 1), np.float32), []
        for row, feature in enumerate(features):
            target.append(space[feature].sum(0))
            weight[row, number[feature]] = idf[feature]
            least.append(np.sort(idf[feature])[: ceil(overlap * len(feature))].sum())
        target = np.stack(target)
        target /= np.maximum(np.linalg.norm(target, axis=1, keepdims=True), 1e-9)
        limit = near if near is not None else NEAR.get(2 * half, NEAR[max(NEAR)])
        return of, target, number, weight, 0.999 * np.array(least, np.float32), limit

    classes = {half: targets(half) for half in sorted(by_half)}

    def rows_of(h: np.ndarray) -> np.ndarray:
        return mix(h.cumsum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1, dtype=np.uint64)

    wanted = {n: (np.array(ks), rows_of(np.array([items[k].words for k in ks], np.uint64))) for n, ks in in_a_row.items()}

    def scan(b: Blocks) -> dict[tuple[int, int], int]:
        """(text, item): words of the item found."""
        out: dict[tuple[int, int], int] = {}
        if not len(b.start):
            return out

        def confirm(doc: int, k: int, start: int, end: int) -> None:
            n = len(items[k].words) + len(items[k].answer)
            if out.get((doc, k)) == len(items[k].words):
                return
            low, high = int(b.first[doc]), int(b.first[doc] + b.count[doc])
            end = max(end, start + 2 * BLOCK)
            if found := matcher.best(k, b.hash[max(low, start - n): min(high, end + n)].tolist()):
                out[doc, k] = max(found, out.get((doc, k), 0))

        for n, (ks, names) in wanted.items():
            if len(b.hash) < n:
                continue
            name = rows_of(np.lib.stride_tricks.sliding_window_view(b.hash, n))
            for at in np.flatnonzero(np.isin(name, names)).tolist():
                doc = int(b.doc[b.block[at]])
                for k in ks[names == name[at]].tolist():
                    confirm(doc, k, at, at + n)
        latent, finer = None, None
        for half, (of, target, number, weight, least, limit) in classes.items():
            c = blocks_of(b.hash, b.count, half, b.feature)
            if latent is None:
                latent = _block_sums(c, np.ones(len(c.feature), np.float32), space)
            else:
                latent = np.add.reduceat(latent, np.flatnonzero(np.diff(c.block[finer.start], prepend=-1)))
            finer = c
            numbers = np.concatenate([_rows(c, number[c.feature], 0), np.zeros((1, half), np.int64)]).T.copy()  # 0: no weight
            pair = np.flatnonzero(c.doc[1:] == c.doc[:-1])  # a passage is a block and the next one of its text
            after = np.full(len(c.start) + 1, len(c.start))
            before = after.copy()
            after[pair], before[pair + 1] = pair + 1, pair
            passage = latent.copy()
            passage[pair] += latent[pair + 1]
            passage /= np.maximum(np.linalg.norm(passage, axis=1, keepdims=True), 1e-9)
            for i in range(0, len(passage), 1 << 14):
                near_k, near_p = np.nonzero((passage[i: i + (1 << 14)] @ target.T >= limit).T)  # by item, whose few weights stay in the cache
                near_p += i
                held, edge = np.zeros(len(near_p), np.float32), np.searchsorted(near_k, np.arange(len(of) + 1)).tolist()
                for k in range(len(of)):
                    own = slice(edge[k], edge[k + 1])
                    p = near_p[own]
                    there = np.concatenate([before[p], p, after[p], after[after[p]]])
                    held[own] = weight[k].take(numbers.take(there, axis=1)).sum(0).reshape(4, -1).sum(0)
                shared = held >= least[near_k]
                for p, k in zip(near_p[shared].tolist(), of[near_k[shared]].tolist()):
                    confirm(int(c.doc[p]), k, int(c.start[p]), int(c.start[p]) + 2 * half)
        return out

    return scan


MATCHES = "doc_id long, digest string, item_id long, matched_words long, item_words long"


def _matches(docs: DataFrame, benchmark: DataFrame, near: float | None, overlap: float) -> DataFrame:
    """MATCHES of all rows, with one pass over the words for each block of items. The benchmark is the stated query set
    and comes to the driver row by row."""
    columns = ["item_id", "text", *[c for c in benchmark.columns if c == "answer"]]
    items = benchmark_items(r.asDict() for r in benchmark.select(*columns).orderBy("item_id", "text").toLocalIterator())
    out = docs.sparkSession.createDataFrame([], MATCHES)
    words = word_table(docs) if items else None
    space = latent_space(words) if items else None
    if space is None:
        return out
    for i in range(0, len(items), ITEMS_PER_PASS):
        some = items[i: i + ITEMS_PER_PASS]

        def run(batches: Iterator[pa.RecordBatch], items=some) -> Iterator[pa.RecordBatch]:
            scan = _scanner(*space, items, near, overlap)
            for batch, blocks in _pieces(batches):
                found = scan(blocks)
                at = pa.array([d for d, _ in found], pa.int64())
                yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at),
                                       pa.array([items[k].item_id for _, k in found], pa.int64()), pa.array(list(found.values()), pa.int64()),
                                       pa.array([len(items[k].words) for _, k in found], pa.int64())],
                                      names=["doc_id", "digest", "item_id", "matched_words", "item_words"])

        out = out.union(words.mapInArrow(run, MATCHES))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, near: float | None = None, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, matched_words, item_words): one row per document row and benchmark item found in it; documents
    without a finding have no row. Null and empty texts have no words and no finding; an empty table or benchmark gives
    an empty result; repeated rows are judged alike; other columns are ignored."""
    return _matches(docs, benchmark, near, overlap).drop("digest")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, near: float | None = None, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns. Equal texts are judged alike, so
    that rows leave by their text's digest, whatever their ids; rows without a text stay. The words of all texts are deleted
    once the digests are written."""
    found = _matches(docs, benchmark, near, overlap)
    gone = materialise(found.select("digest").distinct(), "contaminated")
    discard(found)
    return docs.join(few(gone), F.md5(docs["text"]) == gone["digest"], "left_anti")


def op9_latent_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
