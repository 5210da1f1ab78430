"""Secret scans with one combined automaton.

All rules' expressions are compiled together: to a nondeterministic automaton over bytes, by subset construction
to a deterministic one, minimised to a transition array. Documents are scanned in one pass over their
bytes, thousands of stretches in step: texts are cut after bytes from which every state goes back to the start, so
that no match is cut. Only documents where the automaton accepted a rule are looked at again, to place that rule's
leftmost, longest, non-overlapping matches with the rule's own automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import chunks


@dataclass(frozen=True)
class Rule:
    """A match is the longest head and the longest body after it; it is reported with a body of ``least`` bytes or more.
    ``scanned`` is the least body that the one-pass automaton asks for (counting costs states)."""
    kind: str
    head: str
    body: str
    least: int
    scanned: int = 1


#: The base rules in their order, then the further ones.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 6),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24, 24),
)
RULES = BASE + (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ", "[A-Za-z0-9_.-]", 10),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "", 0),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("stripe", "sk_live_", "[A-Za-z0-9]", 16),
)
#: Bytes of a stretch; it ends at the next byte after which the automaton starts anew.
STRETCH = 512


class _Nfa:
    """Thompson's construction over the parse tree of a regular expression on ASCII characters."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, at: int, fold: bool = False) -> int:
        """Put the expression behind state ``at``; the state behind it."""
        for op, arg in tree:
            at = getattr(self, "_" + str(op).lower())(arg, at, fold)
        return at

    def _move(self, chars, at: int, fold: bool) -> int:
        chars = {ord(y) for x in chars for y in ((chr(x).lower(), chr(x).upper()) if fold else chr(x))}
        self.moves[at].append((frozenset(chars), to := self.state()))
        return to

    def _literal(self, char, at, fold):
        return self._move([char], at, fold)

    def _in(self, parts, at, fold):
        return self._move([c for op, x in parts for c in ([x] if str(op) == "LITERAL" else range(x[0], x[1] + 1))], at, fold)

    def _subpattern(self, arg, at, fold):
        _, on, _, tree = arg
        return self.add(tree, at, fold or bool(on & 2))  # re.IGNORECASE

    def _branch(self, arg, at, fold):
        end = self.state()
        for tree in arg[1]:
            self.empty[at].append(start := self.state())
            self.empty[self.add(tree, start, fold)].append(end)
        return end

    def _max_repeat(self, arg, at, fold):
        least, most, tree = arg
        for _ in range(least):
            at = self.add(tree, at, fold)
        end = self.state()
        self.empty[at].append(end)
        if most == _parser.MAXREPEAT:
            self.empty[end].append(start := self.state())
            self.empty[self.add(tree, start, fold)].append(end)
            return end
        for _ in range(most - least):
            at = self.add(tree, at, fold)
            self.empty[at].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Automaton:
    """``go[state * 256 + byte]``, state 0 is the start; ``accepts[state]`` has a bit per rule; ``dead`` leads nowhere (-1: no
    such state)."""
    go: np.ndarray
    accepts: np.ndarray
    dead: int


def compile_rules(patterns: list[str], anywhere: bool) -> Automaton:
    """One minimal automaton for all patterns. anywhere: matches may begin at any byte."""
    nfa = _Nfa()
    start, ends = nfa.state(), []
    if anywhere:
        nfa.moves[start].append((frozenset(range(256)), start))
    for p in patterns:
        nfa.empty[start].append(first := nfa.state())
        ends.append(nfa.add(_parser.parse(p), first))
    sets = {m[0] for moves in nfa.moves for m in moves}
    kinds: dict[tuple, list[int]] = {}
    for b in range(256):
        kinds.setdefault(tuple(b in s for s in sets), []).append(b)
    order = {(first := nfa.closure([start])): 0}
    todo, rows = [first], []
    while len(rows) < len(todo):  # subset construction, one move per kind of byte
        states, row = todo[len(rows)], np.zeros(256, np.int32)
        for same in kinds.values():
            to = nfa.closure({t for s in states for chars, t in nfa.moves[s] if same[0] in chars})
            if to not in order:
                order[to] = len(todo)
                todo.append(to)
            row[same] = order[to]
        rows.append(row)
    go = np.stack(rows)
    accepts = np.array([sum(1 << i for i, e in enumerate(ends) if e in s) for s in todo], np.int64)
    part, reps = np.unique(accepts, return_inverse=True)[1], [b[0] for b in kinds.values()]
    while True:  # minimisation: split classes until all members move alike
        new = np.unique(np.column_stack([part, part[go[:, reps]]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    name = {int(part[0]): 0}
    for p in part.tolist():
        name.setdefault(p, len(name))
    part = np.array([name[p] for p in part.tolist()])
    small = np.zeros((len(name), 256), np.int32)
    small[part] = part[go]
    accept = np.zeros(len(name), np.int64)
    accept[part] = accepts
    dead = np.flatnonzero((small == np.arange(len(small))[:, None]).all(1) & (accept == 0))
    return Automaton(small.ravel(), accept, int(dead[0]) if len(dead) else -1)


@cache
def _combined(rules: tuple[Rule, ...]) -> Automaton:
    return compile_rules([r.head + (f"{r.body}{{{r.scanned}}}" if r.body else "") for r in rules], True)


@cache
def _single(pattern: str) -> tuple[list[list[int]], list[bool], int]:
    a = compile_rules([pattern], False)
    return a.go.reshape(-1, 256).tolist(), (a.accepts != 0).tolist(), a.dead


def accepted(texts: list[bytes], a: Automaton) -> np.ndarray:
    """Per text, a bit for each rule that matches somewhere, from one pass over all bytes."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    if not len(data):
        return np.zeros(len(texts), np.int64)
    anew = (a.go.reshape(-1, 256) == 0).all(0)
    cuts = np.flatnonzero(anew[data]) + 1
    wanted = np.searchsorted(cuts, np.arange(STRETCH, len(data), STRETCH))
    lanes = np.unique(np.concatenate([starts[starts < ends], cuts[wanted[wanted < len(cuts)]]]))
    lanes = lanes[lanes < len(data)]
    text = np.searchsorted(ends, lanes, side="right")
    size = np.diff(np.append(lanes, len(data)))
    order = np.argsort(-size, kind="stable")
    at, left, state, hit = lanes[order], -size[order], np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    for step in range(int(size.max())):
        n = int(np.searchsorted(left, -step))  # lanes longer than step
        state[:n] = a.go[state[:n] * 256 + data[at[:n] + step]]
        hit[:n] |= a.accepts[state[:n]]
    out = np.zeros(len(texts), np.int64)
    np.bitwise_or.at(out, text[order], hit)
    return out


def _longest(machine, data: bytes, at: int) -> int:
    """End of the longest match from ``at`` on, or -1."""
    go, accepts, dead = machine
    state, end = 0, at if accepts[0] else -1
    for i in range(at, len(data)):
        state = go[state][data[i]]
        if state == dead:
            break
        if accepts[state]:
            end = i + 1
    return end


def spans(data: bytes, rule: Rule) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping matches in bytes; those with too short a body use up their bytes, and are left out."""
    head, body = _single(rule.head), _single(f"{rule.body}+") if rule.body else None
    go, _, dead = _single(rule.head + rule.body)
    begins = bytes(b for b in range(256) if go[0][b] != dead)
    out, at = [], 0
    while at < len(data):
        if data[at] in begins and (middle := _longest(head, data, at)) >= 0:
            end = _longest(body, data, middle) if body else middle
            if end >= 0:
                if end - middle >= rule.least:
                    out.append((at, end))
                at = max(end, at + 1)
                continue
        at += 1
    return out


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ``found``: array of (kind, start, end) in code points, end exclusive, by start and then in
    the rules' order. Null and empty texts have none; repeated rows are scanned alike; other columns are ignored."""
    combined = docs.sparkSession.sparkContext.broadcast(_combined(rules))  # of the rules' size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch, texts in chunks(batches):
            data = texts.cast(pa.binary()).to_pylist()
            rows: list[list[dict]] = []
            for t, hit in zip(data, accepted(data, combined.value).tolist()):
                found = []
                if hit:
                    for i, rule in enumerate(rules):
                        if hit >> i & 1:
                            found += [(a, i, b) for a, b in spans(t, rule)]
                points = np.cumsum(np.frombuffer(t, np.uint8) & 0xC0 != 0x80) if found and not t.isascii() else None
                point = lambda x, points=points: x if points is None else int(points[x - 1]) if x else 0
                rows.append([{"kind": rules[i].kind, "start": point(a), "end": point(b)} for a, i, b in sorted(found)])
            yield pa.record_batch([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "found"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, found array<struct<kind string, start long, end long>>")


def op2_secret_automaton(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    base = F.filter("found", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *[of(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
