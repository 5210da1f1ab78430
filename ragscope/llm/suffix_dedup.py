"""Repeated byte strings by distributed prefix doubling.

Ranking every byte would sort all of the input in every round. Instead texts are cut into phrases at anchors: the place of the
least hash in each window of WINDOW places. Every window has one, so that no place is without an anchor near, and two
occurrences of a string have the same anchors inside. Spark ranks runs of two phrases, the shortest that are asked for, then in
each round sorts pairs of ranks at twice the offset and ranks the pairs; positions whose rank is unique drop out, and rounds
end when runs reach past the threshold or nothing is left.

Two overlapping ranked runs name any stretch of phrases, exactly like its bytes. A string has a first anchor c, that of its first
window, and a last one e, that of its last; places with the same c and e are a zone. All places of a zone are repeated if the
stretch of phrases around their strings is, that is, starts in two places. Only where that is not so, but the stretch from c to e
is repeated, are the strings themselves compared: those at the edges of a repeat, first in blocks by what all strings of a block
have in common and by all that they cover together, then one by one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, table
from .words import chunks, mix

#: Places of GRAM bytes, of which the least hash is an anchor.
WINDOW, GRAM = 128, 8
#: Places of a zone that are compared together before they are compared one by one.
BLOCK = 16
#: Rows of places that a task hands on at a time.
ROWS = 1 << 16
_BASE, _BACK = (np.uint64(b) for b in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_LOW = np.uint64(0xFFFFFFFF)


class Hashes:
    """Hashes of any stretch of a text from prefix sums."""
    _power = _back = np.ones(1, np.uint64)

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        n = len(data)
        power, back = Hashes._power, Hashes._back
        if n >= len(power):
            power, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), b)]), dtype=np.uint64) for b in (_BASE, _BACK))
            if n <= 1 << 20:  # shared by the texts of a task, but for very long ones
                Hashes._power, Hashes._back = power, back
        self.back = back
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self) -> np.ndarray:
        """The hash of each GRAM bytes."""
        n = len(self.sums) - GRAM
        return (self.sums[GRAM:] - self.sums[:-GRAM]) * self.back[:n]


def window_of(length: int) -> int:
    return min(WINDOW, (length - GRAM) // 3)


def anchors(h: Hashes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors in ascending order, and the first window of each."""
    value = h.grams()
    least, width, window = value & ~_LOW | np.arange(len(value), dtype=np.uint64), 1, window_of(length)  # ties: the first
    while 2 * width <= window:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if rest := window - width:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & _LOW).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], first


def cuts_of(anchor: np.ndarray, n: int) -> np.ndarray:
    """0, the anchors, and n."""
    return np.concatenate([[0] if anchor[0] else [], anchor, [n]]).astype(np.int64)


def zones(cuts: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Places [low, high) of each zone of a text, and its phrase stretches: [a, b) around all its strings, [c, e) inside each of them."""
    last, skip = int(cuts[-1]) - length + 1, len(cuts) - 1 - len(first)
    behind = length - GRAM + 1 - window_of(length)  # from a place to the last window of its string
    edge = np.unique(np.concatenate([[0], first, first - behind]))
    low = edge[(edge >= 0) & (edge < last)]
    high = np.append(low[1:], last)
    c, e = (np.searchsorted(first, x, side="right") - 1 + skip for x in (low, low + behind))
    return low, high, np.searchsorted(cuts, low, side="right") - 1, np.searchsorted(cuts, high - 1 + length, side="left"), c, e


def _level(m: np.ndarray) -> np.ndarray:
    """The floor of the binary logarithm."""
    return np.frexp(m.astype(float))[1].astype(np.int64) - 1


PARSED = "doc_id long, n long, class binary, sha string, names array<long>, cuts array<int>, first array<int>, used int"


def _parse(length: int):
    """Names of runs of two phrases, gaps between cuts and between first windows, and the levels (bits) at which zones have their
    names. A phrase has at most a window's bytes and zones ask for stretches of more, so for two phrases at least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch, texts in chunks(batches):
            out = defaultdict(list)
            for t in texts.cast(pa.binary()).to_pylist():
                names = cuts = first = None
                used = 0
                if len(t) >= length:
                    h = Hashes(t)
                    anchor, first = anchors(h, length)
                    cuts = cuts_of(anchor, len(t))
                    # a run is its bytes and its cut
                    names = mix(h.of(cuts[:-2], cuts[2:]) + (cuts[1:-1] - cuts[:-2]).astype(np.uint64)).view(np.int64)
                    _, _, a, b, c, e = zones(cuts, first, length)
                    used = int(np.bitwise_or.reduce(1 << _level(np.concatenate([b - a, e - c]))))
                    cuts, first = np.diff(cuts, prepend=0).astype(np.int32), np.diff(first, prepend=0).astype(np.int32)
                for k, v in zip(("n", "class", "sha", "names", "cuts", "first", "used"),
                                (len(t), xxhash.xxh3_128_digest(t), hashlib.sha256(t).hexdigest(), names, cuts, first, used)):
                    out[k].append(v)
            yield pa.record_batch([batch.column("doc_id"), pa.array(out["n"], pa.int64()), pa.array(out["class"], pa.binary()), pa.array(out["sha"], pa.string()),
                                   pa.array(out["names"], pa.list_(pa.int64())), pa.array(out["cuts"], pa.list_(pa.int32())),
                                   pa.array(out["first"], pa.list_(pa.int32())), pa.array(out["used"], pa.int32())],
                                  names=["doc_id", "n", "class", "sha", "names", "cuts", "first", "used"])
    return run


def doubled_ranks(runs: DataFrame) -> list[DataFrame]:
    """For each level from 1 on, a written table (uid, i, used, rank): equal rank for equal runs of 2^level phrases from phrase i on;
    unique runs are left out.

    runs: (uid, i, used, rank) with the names of runs of two phrases; a text goes on to the highest level of its bits ``used``. A
    round pairs each rank with the one as many phrases on as it covers, and ranks the pairs by the least position (as a hash)
    that has them. The pairs that repeat are written first, so that adaptive execution can split the rows of a hot one.
    """
    def repeated(rows: DataFrame, *key: str) -> DataFrame:
        groups = materialise(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), F.min(F.xxhash64("uid", "i")).alias("least"))
                             .where("members > 1").drop("members"), "rank-groups")
        out = materialise(rows.join(groups.hint("shuffle_hash"), list(key)).select("uid", "i", "used", F.col("least").alias("rank")), "ranks")
        discard(groups)
        return out

    out = [repeated(runs, "rank")]
    while True:
        level = len(out)
        here = out[-1].where(F.shiftright("used", level + 1) > 0)
        if here.isEmpty():
            return out
        there = here.select("uid", (F.col("i") - (1 << level)).alias("i"), F.col("rank").alias("next"))
        out.append(repeated(here.join(there, ["uid", "i"]), "rank", "next"))


def _zone_names(length: int):
    """Names of each zone's two stretches, where the inner one may be repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = batch.column("ranks")
            edge, flat = ranks.offsets.to_numpy(), ranks.values
            level, at, rank = (flat.field(f).to_numpy() for f in ("level", "i", "rank"))
            for row in range(batch.num_rows):
                cuts, first = (np.cumsum(batch.column(f)[row].values.to_numpy().astype(np.int64)) for f in ("cuts", "first"))
                low, high, a, b, c, e = zones(cuts, first, length)
                own = slice(edge[row], edge[row + 1])
                known = {}
                for one in np.unique(level[own]).tolist():
                    some = level[own] == one
                    known[one] = np.zeros(len(cuts), np.uint64), np.zeros(len(cuts), bool)
                    known[one][0][at[own][some]] = rank[own][some].view(np.uint64)
                    known[one][1][at[own][some]] = True

                def name(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    out, has, deep = np.zeros(len(x), np.uint64), np.zeros(len(x), bool), _level(y - x)
                    for one, (value, seen) in known.items():
                        z = np.flatnonzero(deep == one)
                        p, q = x[z], y[z] - (1 << one)
                        out[z] = mix(mix(value[p] ^ _BASE) * np.uint64(31) + value[q] + (y - x)[z].astype(np.uint64))
                        has[z] = seen[p] & seen[q]
                    return out.view(np.int64), has

                inside, may = name(c, e)
                whole, has = name(a, b)
                # zones of one name have the same places of equal stretches, so that one of them can stand for all
                whole = mix(whole.view(np.uint64) + (low - cuts[a]).astype(np.uint64) * _BASE + (high - low).astype(np.uint64)).view(np.int64)
                if may.any():
                    yield pa.record_batch([pa.array(np.full(may.sum(), batch.column("uid")[row].as_py())), *(pa.array(v[may]) for v in (a, low, high)),
                                           pa.array(cuts[c][may]), pa.array(whole[may], mask=~has[may]), pa.array(inside[may])],
                                          names=["uid", "a", "low", "high", "anchor", "whole", "inside"])
    return run


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    import zstandard
    open_ = zstandard.ZstdDecompressor()
    return (open_.decompress(t.as_py()) for t in batch.column("packed"))


def _strips(todo: list[dict]) -> tuple[np.ndarray, ...]:
    """Places [low, high) of each zone cut at every BLOCK places before its anchor, with the offsets of the block from the anchor."""
    at, low, high = [], [], []
    for z in todo:
        inner = np.arange(z["anchor"] - (z["anchor"] - z["low"]) // BLOCK * BLOCK + 1, z["high"], BLOCK)
        edge = np.concatenate([[z["low"]], inner, [z["high"]]])
        low.append(edge[:-1])
        high.append(edge[1:])
        # the last place of the block that holds the strip: told by the distance from the anchor alone
        at.append(z["anchor"] - (z["anchor"] - edge[:-1]) // BLOCK * BLOCK)
    return tuple(np.concatenate(v) for v in (at, low, high))


def _block_hashes(length: int):
    """Of each strip: the hash of what all strings of its block share, and of all that they cover (null beyond the text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, t, todo in zip(batch.column("uid").to_pylist(), _unpacked(batch), batch.column("todo").to_pylist()):
                end, low, high = _strips(todo)
                begin, n = end - BLOCK + 1, len(t)
                h = Hashes(t)
                inner = h.of(end, begin + length)
                fits = (begin >= 0) & (end + length <= n)
                # strips of one name have the same places of equal blocks, so that one of them can stand for all
                outer = mix(h.of(np.maximum(begin, 0), np.where(fits, end + length, n)) + ((low - begin) * BLOCK + high - low).astype(np.uint64))
                yield pa.record_batch([pa.array(np.full(len(low), uid)), *(pa.array(v) for v in (begin, low, high, inner.view(np.int64))),
                                       pa.array(outer.view(np.int64), mask=~fits)], names=["uid", "begin", "low", "high", "inner", "outer"])
    return run


def _place_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, t, todo in zip(batch.column("uid").to_pylist(), _unpacked(batch), batch.column("todo").to_pylist()):
                h, step = Hashes(t), ROWS // BLOCK
                for x in range(0, len(todo), step):
                    at = np.concatenate([np.arange(z["low"], z["high"]) for z in todo[x: x + step]])
                    yield pa.record_batch([pa.array(np.full(len(at), uid)), pa.array(at), pa.array(h.of(at, at + length).view(np.int64))],
                                          names=["uid", "place", "hash"])
    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for t, runs in zip(_unpacked(batch), batch.column("todo").to_pylist()):
                gone = np.zeros(len(t) + 1, np.int32)
                for r in runs:  # places [low, high), each the start of a repeated string
                    gone[r["low"]] += 1
                    gone[r["high"] - 1 + length] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                got.append((int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*got)) or [[], [], []]
            yield pa.record_batch([batch.column("class"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                  names=["class", "n_removed", "n_spans", "kept_sha256"])
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they travel: with their class, compressed."""
    import xxhash
    import zstandard
    for batch, texts in chunks(batches):
        texts, pack = texts.cast(pa.binary()).to_pylist(), zstandard.ZstdCompressor(level=1)
        yield pa.record_batch([batch.column("key"), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                               pa.array([pack.compress(t) for t in texts], pa.binary())], names=["key", "class", "packed"])


def _repeated(rows: DataFrame, name: str, *place: str) -> DataFrame:
    """Names that two different places have, with one of these places, as hashes. Written, so that joins can split a hot name."""
    return materialise(rows.where(F.col(name).isNotNull()).groupBy(name)
                       .agg(F.min(F.xxhash64(*place)).alias("one"), F.max(F.xxhash64(*place)).alias("other"))
                       .where("one <> other").select(name, "one"), "repeated")


def remove_repeats(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row, with every byte removed that a string of ``length``
    bytes (at least 16) covers which also starts elsewhere. Texts are UTF-8 bytes, nulls are empty; repeated rows are documents that
    repeat each other; texts shorter than ``length`` keep everything; an empty table gives an empty result; other columns
    are ignored. A text of any length is one row, with a few numbers for each of its phrases; a task holds one text's hashes at a time.

    Equal texts are one class, removed whole; one member stays to be compared with other texts. Stretches are compared by
    64-bit names, whole texts by 128 bits. Joins with names hash these, one row each and so even over partitions, in place of sorting
    all rows. Tables that are written on the way are deleted at the end.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-1)).alias("key")
    parsed = materialise(rows.mapInArrow(_parse(length), PARSED), "phrases")
    long = parsed.where(F.col("n") >= length)
    member = long.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("key"))
    classes = materialise(long.withColumn("key", key).join(member, ["class", "key"]).dropDuplicates(["class", "key"])
                          .select("class", "key", "copies", "n", "names", "cuts", "first", "used", F.monotonically_increasing_id().alias("uid")), "classes")

    levels = doubled_ranks(classes.select("uid", "used", F.posexplode("names").alias("i", "rank")))
    ranks = None
    for level, one in enumerate(levels, 1):
        one = one.where(F.shiftright("used", level).bitwiseAND(F.lit(1)) == 1).select("uid", F.lit(level).alias("level"), "i", "rank")
        ranks = one if ranks is None else ranks.union(one)
    found = ranks.groupBy("uid").agg(F.collect_list(F.struct("level", "i", "rank")).alias("ranks"))
    zone = materialise(classes.select("uid", "cuts", "first").join(found, "uid")
                       .mapInArrow(_zone_names(length), "uid long, a long, low long, high long, anchor long, whole long, inside long"), "zones")
    for one in levels:
        discard(one)

    twice = _repeated(zone, "whole", "uid", "a")
    judged = materialise(zone.join(twice.hint("shuffle_hash"), "whole", "left").withColumn("sure", F.col("one").isNotNull())
                         .withColumn("shown", ~F.col("sure") | (F.xxhash64("uid", "a") == F.col("one"))), "judged")
    discard(zone)
    open_ = materialise(judged.groupBy("inside").agg(F.sum(F.col("shown").cast("int")).alias("shown_members"), F.sum((~F.col("sure")).cast("int")).alias("open"))
                        .where("shown_members > 1 and open > 0").select("inside"), "open")

    def with_text(spans: DataFrame, *columns: str) -> DataFrame:
        """Spans of a text as a list, beside the text of one row of its class."""
        todo = classes.select("uid", "class", "key").join(spans.groupBy("uid").agg(F.collect_list(F.struct(*columns)).alias("todo")), "uid")
        return (rows.where(F.octet_length("text") >= length).select(key, "text").mapInArrow(_packed, "key long, class binary, packed binary")
                .join(todo, ["class", "key"]).dropDuplicates(["class", "key"]))

    blocks = materialise(with_text(judged.where("shown").join(open_.hint("shuffle_hash"), "inside"), "low", "high", "anchor")
                         .mapInArrow(_block_hashes(length), "uid long, begin long, low long, high long, inner long, outer long"), "blocks")
    cores, covers = _repeated(blocks, "inner", "uid", "begin"), _repeated(blocks, "outer", "uid", "begin")
    weighed = materialise(blocks.join(cores.select("inner").hint("shuffle_hash"), "inner")
                          .join(covers.select("outer", F.col("one").alias("first")).hint("shuffle_hash"), "outer", "left")
                          .withColumn("sure", F.col("first").isNotNull())
                          .withColumn("shown", ~F.col("sure") | (F.xxhash64("uid", "begin") == F.col("first"))), "weighed")
    single = materialise(weighed.where("not sure").select("inner").distinct(), "open")
    places = materialise(with_text(weighed.where("shown").join(single.hint("shuffle_hash"), "inner"), "low", "high")
                         .mapInArrow(_place_hashes(length), "uid long, place long, hash long"), "places")
    same = _repeated(places, "hash", "uid", "place")
    again = places.join(same.select("hash").hint("shuffle_hash"), "hash").select("uid", "place")
    runs = (judged.where("sure").select("uid", "low", "high").union(weighed.where("sure").select("uid", "low", "high"))
            .union(again.select("uid", F.col("place").alias("low"), (F.col("place") + 1).alias("high"))))
    copied = classes.where("copies > 1").select("class", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    cut = with_text(runs.join(classes.where("copies = 1").select("uid"), "uid"), "low", "high").mapInArrow(
        _cut(length), "class binary, n_removed long, n_spans long, kept_sha256 string")
    done = materialise(parsed.select("doc_id", "n", "class", "sha").join(copied.union(cut), "class", "left").select(
        "doc_id", F.col("n").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")), "repeats")
    for one in [parsed, classes, twice, judged, open_, blocks, cores, covers, weighed, single, places, same]:
        discard(one)
    return done


def op7_prefix_doubling(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
