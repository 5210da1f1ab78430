"""The conversation trie against a brute-force trie."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from ragscope.llm.prefix_trie import ordered_turns, prefix_trie, rebuilt_turns

SCHEMA = "conv_id long, turn long, role string, text string, depth long, pos string"


def brute(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:]) if rebuild else tuple(ts)
    nodes = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    children = defaultdict(int)
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(members) - 1) * words
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest())
                  for p, m in nodes.items())


def result(spark, rows, width=3, rebuild=True):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)  # columns with clashing names
    turns = ordered_turns(df)
    turns, convs = rebuilt_turns(turns) if rebuild else (turns, turns.select("conv_id").distinct())
    return sorted(tuple(r) for r in prefix_trie(turns, convs, width).collect())


def rows_of(seed, n=90, most=11):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(300), n):
        for i in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([i, i, i, None, 2]), rng.choice(["user", "assistant", None, ""]),
                         rng.choice(["a", "a b", None, "", "c\td  e", "x y z"])))
    return rows + [(None, 1, "user", "lost")] + rows[:7]  # repeated rows are turns of their own


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_equals_brute_force(spark, rebuild):
    rows = rows_of(1 + rebuild)
    assert result(spark, rows, rebuild=rebuild) == brute(rows, rebuild)


def test_long_and_common_conversations(spark, monkeypatch):
    """A conversation with most of the rows, copies of it and of its beginning, and one without a turn of its own."""
    monkeypatch.setattr("ragscope.llm.prefix_trie.STRETCH", 4)  # many stretches of blocks
    long = [(i, "user" if i % 2 else "assistant", f"w{i % 5} " * (i % 3)) for i in range(60)]
    rows = [(c, *t) for c, n in ((40, 60), (60, 60), (80, 31), (100, 60), (7, 1)) for t in long[:n]]
    rows += [(c, 0, "user", "hello " * 5) for c in range(120, 180, 2)] + [(200, 0, "user", "very long " * 40_000)]
    assert result(spark, rows) == brute(rows)


def test_empty(spark):
    assert result(spark, []) == []
