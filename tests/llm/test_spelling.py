"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from ragscope.llm import spelling
from ragscope.llm.spelling import counted_runs, spelling_variants

SCHEMA = "doc_id long, text string, n string, word int, cell string"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def edits(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def counts(rows, least=6, min_count=5):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= min_count}


def variants(words, ratio=5):
    form, n_near = {}, {}
    for w, n in words.items():
        near = [v for v in words if edits(w, v)]
        n_near[w] = len(near)
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], words.get(form[w])))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 10))) for _ in range(25)]
    pool = []
    for s in stems:
        k = rng.choice([3, 8, 40, 200])
        pool += [s] * k
        for _ in range(6):
            i = rng.randrange(len(s))
            pool += [rng.choice([s[:i] + s[i + 1:], s[:i] + rng.choice("abcdÿ") + s[i:], s[:i] + rng.choice("abcdé") + s[i + 1:]])] * rng.choice([1, 5, 6, 30])
    rng.shuffle(pool)
    rows = [(i, rng.choice([" ", "-", "\n", "1"]).join(w.upper() if rng.random() < 0.1 else w for w in pool[at:at + 50])) for i, at in enumerate(range(0, len(pool), 50))]
    return rows + rows[:3] + [(None, "abcdefgh " * 40), (7, None), (8, ""), (9, "× ÷ É"), (10, ("q" * 3000 + " ") * 6 + ("q" * 2999 + "r ") * 30)]


@pytest.mark.parametrize("tile", [3, 2048])
def test_variants_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (tile,))
    rows = texts(tile)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    words = counts(rows)
    vocabulary = counted_runs(df)
    assert {r["word"]: r["n"] for r in vocabulary.collect()} == words
    out = spelling_variants(vocabulary)
    assert sorted(map(tuple, out.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0]) == variants(words)


def test_many_classes(spark):
    """A vocabulary large enough for several letter classes and cells."""
    rng = random.Random(5)
    words = {}
    while len(words) < 3000:
        w = "".join(rng.choice("abcdefg") for _ in range(rng.randrange(6, 8)))
        words[w] = rng.choice([5, 25, 125, 700])
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    out = spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, out), key=lambda r: r[0]) == variants(words)


def test_empty(spark):
    assert spelling_variants(counted_runs(spark.createDataFrame([], SCHEMA))).collect() == []
