"""Near-duplicates by circulant MinHash.

Two permutations give all coordinates of a signature: the first scatters a shingle over D places, the second, shifted
round by k places, ranks these for coordinate k. The shifted ranks of one place for all k stand next to each other in
one array, so that a shingle contributes one contiguous slice and a signature is the minimum of slices. Bands of
coordinates propose pairs, and every link is confirmed on the full shingle sets.

All pairs of a band's bucket are never emitted. Equal texts are one class from the start. First each class is
compared with the smallest class that it shares a bucket with. Then large groups are united: in two turns each class goes
into one block of one of its open buckets, and a spanning forest of the pairs there that look clearly similar is confirmed,
one pair per member at most. In buckets that still hold several components, all pairs across components are then
compared: the members of the largest component are sent to blocks of the others only, never to each other. First
sketches alone tell which members have a pair whose estimates leave the threshold possible; few do, and only these bring their
whole sets of shingle hashes to the block, where their pairs are counted and a forest of those that hold leaves it. The second
estimate is from the least shingles of hash bins, a sample of the union without repetition and so sharp for short texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, materialise, table
from .components import components
from .words import chunks, mix, word_hashes, words_of

PLACES = 1 << 20
#: At similarity 0.8, all 40 bands of 5 miss a pair with probability (1 - 0.8^5)^40 = 1.3e-7.
BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
#: Five standard deviations, sqrt(J (1 - J) / 200), below the threshold a pair is not confirmed any more.
SLACK = 0.14
#: Bins of the second estimate, which may lie as many standard deviations below the threshold.
BINS = 512
DEVIATIONS = 5
#: So far above the threshold a pair looks clearly similar.
CLEAR = 0.02
BLOCK = 256
#: Shingles of a block whose whole sets are held, 8 bytes each.
BLOCK_SHINGLES = 1 << 20
#: Turns in which large groups are united before whole buckets are compared.
TURNS = 2
#: Texts whose bins are held at a time, 2 KB each, however short the texts.
TEXTS = 2048
#: Shingles whose slices of ranks are held at a time.
SLICES = 1 << 14
#: Parts into which the copies of one text are dealt when they look up their representative.
SALTS = 16
SEED = 20_240_601


@cache
def _ranks() -> np.ndarray:
    """The second permutation, continued past its end so that shifts need no wrap-around."""
    ranks = np.random.default_rng(SEED).permutation(PLACES).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:COORDINATES]]), COORDINATES)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of the distinct k-word shingles of each lower-cased text, in text order. A text of fewer words
    has its whole sequence as one; a text without words has none."""
    low = pa.array([t.lower() for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())  # bytes: A-Z only
    w = words_of(low)
    if not len(w.code):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, end = word_hashes(w.distinct)[w.code], np.repeat(w.first + w.count, w.count)
    at = np.arange(len(h))
    starts = (at + k <= end) | (at == np.repeat(w.first, w.count)) & (np.repeat(w.count, w.count) < k)
    at = at[starts]
    value = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(k):
        there = at + j < end[at]
        value = np.where(there, mix(value * np.uint64(31) + h[np.minimum(at + j, len(h) - 1)]), value)
    doc = w.doc[at]
    _, first = np.unique(mix(value + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    first.sort()
    return doc[first], value[first]


def signatures(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of the texts that have shingles, one row each, and the shingles per text (of n)."""
    count = np.bincount(doc, minlength=n)
    place = (mix(value ^ np.uint64(SEED)) >> np.uint64(44)).astype(np.int64)  # the first permutation: 20 bits
    start = np.flatnonzero(np.diff(doc, prepend=-1))
    out = np.full((len(start), COORDINATES), PLACES, np.uint32)
    ranks, at = _ranks(), 0
    row = np.cumsum(np.diff(doc, prepend=-1) > 0) - 1
    for at in range(0, len(place), SLICES):  # 13 MB of slices at a time; a text may go on in the next part
        part = row[at: at + SLICES]
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        least = np.minimum.reduceat(ranks[place[at: at + SLICES]], edges, axis=0)
        out[part[edges]] = np.minimum(out[part[edges]], least)
    return out, count


def bins(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Seven bits of the least shingle hash in each bin, with the eighth set, or 0 for an empty bin; a row for each text with shingles."""
    h = mix(value ^ np.uint64(SEED + 1))
    row = np.cumsum(np.diff(doc, prepend=-1) > 0) - 1
    least = np.full((row[-1] + 1 if len(row) else 0) * BINS, 0xFFFFFFFF, np.uint32)
    np.minimum.at(least, row * BINS + (h >> np.uint64(55)).astype(np.int64), (h & np.uint64(0x7FFFFFFF)).astype(np.uint32))
    return np.where(least < 1 << 31, least & 127 | 128, 0).astype(np.uint8).reshape(-1, BINS)


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; keys of different bands differ."""
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(31) + sig[:, r::ROWS].astype(np.uint64))
    return key


FEATURES = "doc_id long, class binary, n long, bands array<long>, sig binary"


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch, texts in chunks(batches, rows=TEXTS):
            doc, value = shingles(texts, k)
            sig, count = signatures(doc, value, len(texts))
            has = count > 0
            classes = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) if x else None
                       for t, x in zip(texts.cast(pa.binary()).to_pylist(), has.tolist())]
            short = np.concatenate([(sig & 255).astype(np.uint8), bins(doc, value)], 1)
            keys, low, at = iter(bands(sig).view(np.int64)), iter(short), has.tolist()
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(classes, pa.binary()), pa.array(count, pa.int64()),
                pa.array([next(keys) if x else None for x in at], pa.list_(pa.int64())),
                pa.array([next(low).tobytes() if x else None for x in at], pa.binary())],
                names=["doc_id", "class", "n", "bands", "sig"])
    return run


def shingle_set(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    w = text.lower().split()
    return set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else {tuple(w)} if w else set()


def _sets(k: int):
    """The sorted shingle hashes of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, rows=TEXTS):
            doc, value = shingles(texts, k)
            parts = np.split(value[np.lexsort((value, doc))], np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])
            yield pa.record_batch([batch.column("rep"), pa.array([p.tobytes() for p in parts], pa.binary())], names=["rep", "set"])
    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, set())
        for batch in batches:
            found = []
            for i in range(batch.num_rows):  # rows come sorted by a
                if (a := batch.column(0)[i].as_py()) != last[0]:
                    last = a, shingle_set(batch.column(2)[i].as_py(), k)
                other = shingle_set(batch.column(3)[i].as_py(), k)
                both = len(last[1] & other)
                if both and 100 * both >= percent * (len(last[1]) + len(other) - both):
                    found.append(i)
            yield batch.select([0, 1]).take(pa.array(found, pa.int64()))
    return run


def _forest(label: np.ndarray, pairs: Iterator[tuple[int, int]], holds: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """The pairs that hold and unite two trees of a forest over the labels; a pair within a tree is not looked at."""
    node = np.unique(label, return_inverse=True)[1].tolist()
    parent = list(range(len(node)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in pairs:
        if (a := root(node[i])) != (b := root(node[j])) and holds(i, j):
            parent[b] = a
            yield i, j


MEMBER = "bucket long, c1 int, c2 int, block int, rep long, label long, n long"


def _across(percent: int, step: str):
    """A forest that links the components of one block, or of two blocks of a bucket.

    clear: by pairs that look clearly similar. similar: by pairs that are similar on their whole sets; a pair is looked at in
    the first bucket that it shares. possible: no forest, but the members of all pairs that ``similar`` would look at.
    """
    clear = step == "clear"
    need = (percent / 100 + (CLEAR if clear else -SLACK)) * COORDINATES

    def possible(n1: int, n2: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether bins let two texts reach the threshold t. At t the union has U = (n1 + n2) / (1 + t) shingles, and of a
        sample of E of them without repetition the share in both varies by t (1 - t) (U - E) / (E (U - 1))."""
        t = percent / 100
        some = ((two | one) != 0).sum(1)
        union = np.maximum((n1 + n2) / (1 + t), some)
        spread = np.sqrt(t * (1 - t) * (union - some + 1) / (some * union))
        return ((two == one) & (two != 0)).sum(1) >= (t - DEVIATIONS * spread) * some

    def pairs(bucket, c1, c2, block, label, n, sig, least, keys) -> Iterator[tuple[int, int]]:
        band = int((keys[0] == bucket).argmax())
        left = np.flatnonzero(block == c1)
        right = left if c1 == c2 else np.flatnonzero(block == c2)
        for i in left:
            j = right[(label[right] != label[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            if c1 == c2:
                j = j[j > i]
            if len(j):
                j = j[(sig[j] == sig[i]).sum(1) >= need]
            if len(j) and not clear:
                j = j[possible(n[i], n[j], least[i], least[j])]
            if len(j) and not clear:
                j = j[(keys[j] == keys[i]).argmax(1) == band]
            yield from ((int(i), int(x)) for x in j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows):
            block, ids, label, n = (np.array([r[i] for r in rows]) for i in (3, 4, 5, 6))
            data = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(len(rows), -1)
            sig, least, keys = data[:, :COORDINATES], data[:, COORDINATES:], np.stack([r[-1] for r in rows])
            sets = [np.frombuffer(r[8], np.uint64) for r in rows] if step == "similar" else []

            def similar(i: int, j: int) -> bool:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

            looks = pairs(*rows[0][:3], block, label, n, sig, least, keys)
            if step == "possible":
                seen = list({rows[x][:7]: 0 for pair in looks for x in pair})
                return pa.record_batch([pa.array([r[i] for r in seen], pa.int32() if 1 <= i <= 3 else pa.int64()) for i in range(7)],
                                       names=[c.split()[0] for c in MEMBER.split(", ")])
            found = [(int(ids[i]), int(ids[j])) for i, j in _forest(label, looks, (lambda i, j: True) if clear else similar)]
            return pa.record_batch([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:  # rows come sorted by bucket and blocks
            keys = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
            for row in zip(*[c.to_pylist() for c in batch.drop_columns("bands").columns], keys):
                if held and held[0][:3] != row[:3]:
                    yield emit(held)
                    held = []
                held.append(row)
        if held:
            yield emit(held)
    return run


def _first_of_equal(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Of buckets with the same members the one of the first band. A pair is looked at in the first bucket that it shares, so
    the others have nothing to add. Buckets with an id of several texts all stay, as its texts are not told apart here."""
    several = reps.groupBy("rep").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    named = members.join(several, "rep", "left").groupBy("bucket").agg(
        F.min("band").alias("band"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("name"),
        F.max(F.when(F.col("texts") > 1, F.col("bucket"))).alias("own"))
    return named.groupBy("size", "name", "own").agg(F.min_by("bucket", "band").alias("bucket")).select("bucket")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``n_shingles``, ``component_id`` (smallest doc_id reached over links) and ``kept`` for every row.

    Texts are lower-cased (A-Z) and cut at ASCII white space; texts without words, nulls included, are linked with
    nothing. Rows with a null id are linked with nothing, have a null component and are kept. Rows of one id are one
    node: with equal texts they get the same result, with different texts they are linked through their id. An empty table gives
    an empty result. Other columns are ignored. A text of any length is one row of its shingles' bounded sketch; its whole
    set is built where a pair is confirmed. ``docs`` is read for the sketches, and again where texts are looked up. Tables that are
    written on the way are deleted when nothing reads them any more.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    per = materialise(rows.mapInArrow(_features(k), FEATURES), "minhash")
    counts = materialise(per.select("doc_id", "n"), "counts")  # all that is left of the sketches at the end
    classes = (per.where("class is not null and doc_id is not null").groupBy("class")
               .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    # The copies of one text may be any share of all rows: each looks up its representative in one of several parts.
    parts = classes.where("copies > 1").select("class", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    of_doc = materialise(per.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(parts, ["class", "part"])
                         .where("doc_id <> rep").select("rep", "doc_id").distinct(), "classes")

    def representatives(chosen: DataFrame, *columns: str) -> DataFrame:
        """Of each class that is chosen, columns of one row of its representative."""
        return materialise(per.select("class", "doc_id", *columns).join(chosen.select("class", F.col("rep").alias("doc_id")), ["class", "doc_id"])
                           .dropDuplicates(["class", "doc_id"]).drop("class").withColumnRenamed("doc_id", "rep"), "representatives")

    reps = representatives(classes, "n", "bands")
    keyed = reps.select("rep", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = (keyed.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("members"))
              .where("lo.rep < hi").select("bucket", F.col("lo.rep").alias("a"), F.col("lo.n").alias("na"), "members"))
    everyone = materialise(keyed.join(shared, "bucket"), "buckets")
    members = materialise(everyone.join(_first_of_equal(everyone, reps), "bucket").drop("band"), "members")
    sigs = representatives(classes.join(members.select("rep").distinct(), "rep"), "sig", "bands")  # the sketches that are compared
    for df in [per, reps, everyone]:
        discard(df)

    def texts_of(ids: DataFrame) -> DataFrame:
        """rep, text of the distinct texts of some ids. Few ids go to the texts, so that the other texts are not shuffled."""
        ids = materialise(ids.distinct(), "ids")
        texts = materialise(rows.join(few(ids), F.col("doc_id") == F.col("rep"))
                            .select("rep", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("copy"))
                            .dropDuplicates(["rep", "copy"]).drop("copy"), "candidates")
        discard(ids)
        return texts

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "pairs")
        texts = texts_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")))
        left, right = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
        found = materialise(pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
                            .mapInArrow(_confirm(k, percent), "a long, b long"), "links")
        discard(pairs)
        discard(texts)
        return found

    fits = F.lit(100) * F.least("n", "na") >= F.lit(percent) * F.greatest("n", "na")
    stars = members.where((F.col("rep") != F.col("a")) & fits).groupBy(F.col("rep").alias("b")).agg(F.min("a").alias("a"))
    links = confirm(stars)
    made = [counts, of_doc, members, sigs, links]

    def labelled() -> DataFrame:
        """Members of buckets with the component that they belong to so far."""
        labels = materialise(components(links), "labels")
        made.append(labels)
        return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))

    def compared(blocks: DataFrame, step: str, out: str) -> DataFrame:
        return (blocks.repartition("bucket", "c1", "c2").sortWithinPartitions("bucket", "c1", "c2")
                .mapInArrow(_across(percent, step), out))

    def linked(blocks: DataFrame, step: str) -> DataFrame:
        made.append(confirm(compared(blocks, step, "a long, b long").distinct()))
        return links.union(made[-1])

    block = ["bucket", "c1", "c2", "block", "rep", "label", "n", "sig"]
    for turn in range(TURNS):
        rows_of = labelled()
        mixed = rows_of.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
        # the largest bucket of a member, then the first in an order that all members share
        order = F.struct(F.col("members") if turn == 0 else F.xxhash64("bucket", F.lit(turn)), "bucket")
        chosen = (rows_of.join(mixed, "bucket").groupBy("rep").agg(F.max_by(F.struct("bucket", "members", "label", "n"), order).alias("it")).select("rep", "it.*"))
        dealt = F.pmod(F.xxhash64("rep", "bucket", F.lit(turn)), F.ceil(F.col("members") / BLOCK)).cast("int")
        links = linked(chosen.join(sigs, "rep").withColumns({"block": dealt, "c1": dealt, "c2": dealt}).select(*block, "bands"), "clear")

    rows_of = labelled()
    largest = F.struct("members", "label")
    sizes = (rows_of.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n")).groupBy("bucket")
             .agg(F.max_by("label", largest).alias("main"), F.max("members").alias("m1"), F.max_by("n", largest).alias("n1"),
                  F.sum("members").alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels")).where("labels > 1"))
    parts = lambda m, n: F.ceil(F.greatest(m / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.select("bucket", "main", parts(F.col("m1"), F.col("n1")).alias("big"), parts(F.col("m") - F.col("m1"), F.col("all") - F.col("n1")).alias("small"))
    inside, key, end = F.col("label") == F.col("main"), F.xxhash64("rep"), F.col("big") + F.col("small") - 1
    open_ = (rows_of.drop("members").join(sizes, "bucket")
             .withColumn("block", F.when(inside, F.pmod(key, "big")).otherwise(F.col("big") + F.pmod(key, "small")).cast("int"))
             .withColumn("first", F.when(inside, F.col("big")).otherwise(0)))
    possible = materialise(compared(open_.join(sigs, "rep").withColumn("other", F.explode(F.sequence("first", end)))
                                    .withColumns({"c1": F.least("block", "other"), "c2": F.greatest("block", "other")})
                                    .select(*block, "bands"), "possible", MEMBER), "possible")
    texts = texts_of(possible.select("rep"))
    sets = materialise(texts.select("rep", F.col("text").cast("string").alias("text")).mapInArrow(_sets(k), "rep long, set binary"), "sets")
    discard(texts)
    links = linked(possible.join(sigs, "rep").join(sets, "rep").select(*block, "set", "bands"), "similar")
    made += [possible, sets]
    final = components(links.union(of_doc))
    done = materialise(counts.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates")
    for df in [*made, final]:
        discard(df)
    return done


def op6_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
