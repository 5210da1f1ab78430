"""Spelling variants by blocked Gram matrices of letter counts.

One inserted or deleted letter changes one letter count by one, a replaced letter two of them. The squared distance of
the count vectors is therefore at most two for near words, and their lengths differ by at most one. Words of one length
are cut into cells by how many letters they have of each of a few letter classes, and cells into tiles. A tile is
multiplied with the words of its own cell and of the adjacent ones; a NumPy product gives all squared distances
of a block, and pairs at distance at most two are verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, table
from .words import chunks

#: Words of a tile, and visitors that are multiplied with it at a time.
TILE, VISITORS = 2048, 4096
#: Distinct runs that a task counts before it hands them on.
COUNTED = 200_000
#: Letters of pairs that are verified at a time, and of texts whose runs are listed at once.
LETTERS, LISTED = 1 << 24, 1 << 20


def _lists(text: str, run: re.Pattern) -> Iterator[list[str]]:
    """The runs of a text; of a very long one, some at a time."""
    if len(text) <= LISTED:
        yield run.findall(text)
        return
    found = run.finditer(text)
    while some := [m.group() for m in islice(found, LISTED // 16)]:
        yield some


def counted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, min_count: int = 5,
                 every: int | None = 199) -> DataFrame:
    """(word, n) of the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` in all texts, A-Z lower-cased, that have ``least``
    code points and occur ``min_count`` times.

    Where ``every`` divides the crc32 h of ``<doc_id>:<run>``, the run loses its code point h % length (None: never).
    Null texts have no runs, a null id is an empty one. Repeated rows count as often as they stand there. Runs are
    counted within a task before they are shuffled.
    """
    run = re.compile(f"[a-zÀ-ÿ]{{{max(least, 1)},}}")  # from the start of a run greedily: whole runs only

    def count(batches):
        total: Counter = Counter()
        for batch, texts in chunks(batches, "text"):
            ids = batch.column(0).cast(pa.string()).to_pylist()
            for i, t in zip(ids, pc.ascii_lower(texts).to_pylist()):
                start = zlib.crc32(f"{i or ''}:".encode())
                for some in _lists(t, run):
                    for word, n in Counter(some).items():
                        if every and (h := zlib.crc32(word.encode(), start)) % every == 0:
                            word = word[:h % len(word)] + word[h % len(word) + 1:]
                        total[word] += n
                    if len(total) > COUNTED:
                        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
                        total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    runs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return runs.where(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _classes(vocabulary: DataFrame, n_classes: int) -> list[str]:
    """The letters dealt to classes of about equal weight; an alphabet of at most 116 letters is collected."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count().collect()
    classes, weight = [""] * n_classes, [0] * n_classes
    for r in sorted(letters, key=lambda r: (-r["count"], r["letter"])):
        k = weight.index(min(weight))
        classes[k], weight[k] = classes[k] + r["letter"], weight[k] + r["count"]
    return [c for c in classes if c]


def _cell(counts: list[Column]) -> Column:
    return F.concat_ws(",", *counts)


def _adjacent(counts: list[Column]) -> Column:
    """Cells in which near words of a word can be, each pair of cells from one side: with one letter more, or with
    a letter of another class in place of one of an earlier class."""
    def moved(*steps):
        return _cell([c + sum(s for k, s in steps if k == i) for i, c in enumerate(counts)])
    k = len(counts)
    more = [moved((i, 1)) for i in range(k)]
    other = [F.when(counts[i] > 0, moved((i, -1), (j, 1))) for i in range(k) for j in range(i + 1, k)]
    return F.array_compact(F.array(*more, *other))


def _letters(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _profile(letters: np.ndarray, used: np.ndarray, kind) -> np.ndarray:
    """Letter counts of words of one length, over the letters ``used``."""
    n = len(letters)
    flat = letters.astype(np.int64) + np.arange(n)[:, None] * 256
    return np.bincount(flat.ravel(), minlength=n * 256).reshape(n, 256)[:, used].astype(kind)


def _close(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of pairs of rows of a and b whose letter counts are at a squared distance of one or two."""
    kind = np.float32 if a.shape[1] < 2000 else np.float64  # exact: integers below 2^24
    used = np.union1d(np.unique(a), np.unique(b))
    x = _profile(a, used, kind)
    x = np.hstack([x, -0.5 * (x * x).sum(1, keepdims=True), np.ones((len(x), 1), kind)])
    for start in range(0, len(b), VISITORS):
        y = _profile(b[start:start + VISITORS], used, kind)
        y = np.hstack([y, np.ones((len(y), 1), kind), -0.5 * (y * y).sum(1, keepdims=True)])
        gram = x @ y.T  # minus half the squared distance
        i, j = np.divmod(np.flatnonzero((gram >= -1) & (gram < 0)), len(y))
        yield i, j + start


def _verified(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows differ by one replaced letter, or by one that a has more."""
    out = []
    step = max(1, LETTERS // a.shape[1])
    for s in range(0, len(i), step):
        x, y = a[i[s:s + step]], b[j[s:s + step]]
        if a.shape[1] == b.shape[1]:
            out.append((x != y).sum(1) == 1)
        else:
            n = b.shape[1]
            front = np.logical_and.accumulate(x[:, :n] == y, axis=1).sum(1)
            back = np.logical_and.accumulate((x[:, 1:] == y)[:, ::-1], axis=1).sum(1)
            out.append(front + back >= n)
    return np.concatenate(out) if out else np.zeros(0, bool)


def _found(i, j, a: list[bytes], b: list[bytes], na: np.ndarray, nb: np.ndarray):
    """For each word of a that has a near word of b: (word, near words, largest n, its smallest word)."""
    order = sorted(set(j.tolist()), key=lambda k: b[k])
    rank = np.zeros(len(b), np.int64)
    rank[order] = np.arange(len(order))
    by = np.lexsort((rank[j], -nb[j], i))
    i, j = i[by], j[by]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    for at, end in zip(first, np.append(first[1:], len(i))):
        yield a[i[at]].decode("latin-1"), int(end - at), int(nb[j[at]]), b[j[at]].decode("latin-1")


def _near_in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, tile, visitor, word, n) sorted by the first three: a tile's words, then all that visit it, which are
    worked on batch by batch. Per word and batch one row of what was found."""
    names = ["word", "n_near", "best_n", "best_word"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    key, home, n_home, letters, out = None, [], [], None, []

    def pairs(visitors, n_visitors, among=False):
        ns, nv = np.array(n_home), np.array(n_visitors)
        for size in {len(w) for w in visitors}:
            at = np.flatnonzero([len(w) == size for w in visitors])
            others = [visitors[k] for k in at]
            block = letters if among else _letters(others)
            for i, j in _close(letters, block):
                if among:
                    i, j = i[i < j], j[i < j]
                real = _verified(letters, block, i, j)
                i, j = i[real], j[real]
                if len(i) and among:
                    yield from _found(np.append(i, j), np.append(j, i), home, home, ns, ns)
                elif len(i):
                    yield from _found(i, j, home, others, ns, nv[at])
                    yield from _found(j, i, others, home, nv[at], ns)

    for batch in batches:
        cells, tiles, visits, words, ns = (c.to_pylist() for c in batch.columns)
        words = [w.encode("latin-1") for w in words]
        edges = [0] + [k for k in range(1, len(cells)) if (cells[k], tiles[k], visits[k]) != (cells[k - 1], tiles[k - 1], visits[k - 1])] + [len(cells)]
        for s, e in zip(edges, edges[1:]):
            if s == e:
                continue
            if (cells[s], tiles[s]) != key:
                if key is not None and letters is None and len(home) > 1:
                    letters = _letters(home)
                    out.extend(pairs(home, n_home, among=True))
                key, home, n_home, letters = (cells[s], tiles[s]), [], [], None
            if not visits[s]:
                home, n_home = home + words[s:e], n_home + ns[s:e]
            elif home:
                if letters is None:
                    letters = _letters(home)
                    out.extend(pairs(home, n_home, among=True))
                out.extend(pairs(words[s:e], ns[s:e]))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
    if letters is None and len(home) > 1:
        letters = _letters(home)
        out.extend(pairs(home, n_home, among=True))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def near_words(vocabulary: DataFrame, n_words: int, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best_word) of the words with a word at one edit; best is the near word of largest n
    (ties: the smallest in code-point order). The vocabulary has distinct words of the Latin-1 alphabet.

    The number of letter classes follows the size of the vocabulary, so that cells keep to a size. A cell of any size
    is cut into tiles; every word visits every tile that can hold a near word, and no pair leaves a task unverified.
    """
    spark = vocabulary.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    classes = _classes(vocabulary, max(1, min(8, round(log(max(n_words, 2) / 300, 5)))))
    counts = [F.length("word") - F.length(F.translate("word", c, "")) for c in classes]
    rows = vocabulary.select("word", "n", F.array(*counts).alias("counts"))
    parts = [F.get("counts", F.lit(k)) for k in range(len(classes))]
    rows = rows.select("word", "n", _cell(parts).alias("cell"), _adjacent(parts).alias("adjacent"))
    tiles = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    rows = materialise(rows.join(tiles, "cell").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")), "spelling-words")
    cells = rows.select("cell", "tiles").distinct()
    at_home = rows.select("cell", "tile", F.lit(0).alias("visitor"), "word", "n")
    beside = rows.where("tile + 1 < tiles").select("cell", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile"), F.lit(1), "word", "n")
    away = (rows.select(F.explode("adjacent").alias("cell"), "word", "n").join(cells, "cell")
            .select("cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1), "word", "n"))
    dealt = at_home.union(beside).union(away).repartition(4 * n, "cell", "tile").sortWithinPartitions("cell", "tile", "visitor")
    found = dealt.mapInArrow(_near_in_tiles, "word string, n_near long, best_n long, best_word string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best_word")).alias("best"))
    out = materialise(best.select("word", "n_near", (-F.col("best.less")).alias("best_n"), "best.best_word"), "spelling-near")
    discard(rows)
    return out


def spelling_variants(vocabulary: DataFrame, ratio: int = 5) -> DataFrame:
    """One row per word of ``vocabulary`` (word, n): ``n_near``, its ``form`` (the near word of largest n, if that is at
    least ``ratio`` times the word's own; else null) with ``form_n``, and ``root``, the last of its forms.

    Words are distinct and of letters up to U+00FF. n grows by ``ratio`` from form to form, so that chains
    have a bounded number of steps and are followed by doubling, one join a time. An empty vocabulary gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms have to be more frequent than their variants")
    words = materialise(vocabulary.select("word", "n"), "vocabulary")
    n_words, most = words.agg(F.count(F.lit(1)), F.max("n")).first()
    near = near_words(words, n_words)
    formed = F.col("best_n") >= ratio * F.col("n")
    rows = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best_word")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(max(2.0, log(max(most or 1, 1), ratio) + 1)))):
        step = materialise(roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        roots = step
    discard(words)
    discard(near)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_gram(spark, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of all documents."""
    return spelling_variants(counted_runs(table(spark, sf_dir, "documents")))
