"""Sharding by histogram sort.

Rows are put into ``n_shards`` contiguous key ranges of nearly equal bytes. The bytes below a set of
candidate boundaries ("probes") are counted exactly over all partitions; each round keeps, for every
wanted splitter, the tightest pair of probes around its target and puts new probes between them, until
the splitter meets the tolerance. Only then do the rows move, once.

The driver holds the probes and their counts: a few numbers per splitter, never rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import long_array, materialise, table

#: Keys and row numbers are joined to one integer; a boundary is such an integer.
_SPAN = 1 << 63


def _split(bound: int) -> tuple[int, int]:
    return bound // _SPAN - _SPAN, bound % _SPAN


def _pieces_below(key: Column, seq: Column, bounds: Sequence[int]) -> Column:
    """How many of the sorted ``bounds`` are at or below the row: a binary search over literal arrays."""
    size = 1 << len(bounds).bit_length()
    parts = [_split(b) for b in bounds] + [(_SPAN - 1, _SPAN - 1)] * (size - 1 - len(bounds))
    keys, seqs = long_array([p[0] for p in parts]), long_array([p[1] for p in parts])
    steps = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())])

    def step(at: Column, width: Column) -> Column:
        there = at + width - 1
        k, s = F.get(keys, there), F.get(seqs, there)
        return F.when((k < key) | ((k == key) & (s <= seq)), at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0), step) if len(bounds) else F.lit(0)


def _counts(rows: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each probe; one number pair per probe reaches the driver."""
    got = {r[0]: (r[1], r[2]) for r in
           rows.groupBy(_pieces_below(F.col("k"), F.col("seq"), probes).alias("piece"))
               .agg(F.sum("size"), F.count(F.lit(1))).collect()}
    out, b, n = [], 0, 0
    for i in range(len(probes)):
        b, n = b + got.get(i, (0, 0))[0], n + got.get(i, (0, 0))[1]
        out.append((b, n))
    return out


def find_splitters(rows: DataFrame, n: int, tolerance: float, probes_per_round: int = 16,
                   exact_every: int = 1, loose: float = 0.25) -> tuple[list[int], list[int], int]:
    """``n - 1`` splitters over rows (k, seq, size); returns them, the rows below each, and all rows.

    Every ``exact_every``-th splitter is refined to ``tolerance`` x the bytes between two of these;
    the others, which only bound the work of a task, to ``loose`` x the bytes of one piece. A splitter
    is also final when one row is left between its probes.
    """
    low, high, total, count = rows.agg(F.min(F.struct("k", "seq")), F.max(F.struct("k", "seq")),
                                       F.sum("size"), F.count(F.lit(1))).first()
    if not count:
        return [], [], 0
    join = lambda x: (x["k"] + _SPAN) * _SPAN + x["seq"]
    known = {join(low): (0, 0), join(high) + 1: (total, count)}
    ideal = total / n
    done: dict[int, int] = {}
    while len(done) < n - 1:
        at = sorted(known)
        sums = [known[k][0] for k in at]
        probes: set[int] = set()
        for j in range(1, n):
            if j in done:
                continue
            want = total * j / n
            hi = min(max(bisect_left(sums, want), 1), len(at) - 1)
            lo = hi - 1
            best = min((lo, hi), key=lambda i: abs(sums[i] - want))
            within = tolerance * ideal * exact_every if j % exact_every == 0 else loose * ideal
            if abs(sums[best] - want) <= within or known[at[hi]][1] - known[at[lo]][1] <= 1 or at[hi] - at[lo] <= 1:
                done[j] = at[best]
            else:
                width = at[hi] - at[lo]
                probes |= {at[lo] + width * i // (probes_per_round + 1) for i in range(1, probes_per_round + 1)}
        probes -= set(known)
        if probes:
            known |= dict(zip(sorted(probes), _counts(rows, sorted(probes))))
    splitters = [done[j] for j in range(1, n)]
    return splitters, [known[s][1] for s in splitters], count


def histogram_shards(rows: DataFrame, key: str, size: Column, carry: Sequence[str] | None = None, n_shards: int = 8,
                     tolerance: float = 1e-3, rows_per_piece: int = 1_000_000) -> DataFrame:
    """Columns ``carry`` (default: all) of every row, with ``shard`` (0 to n_shards - 1) and ``slot``
    (gapless from 0 within its shard, in key order).

    ``key`` is any integer column; nulls come first, and rows of one key are ordered by their place in the
    input, so that a hot key is split like any other. ``size`` counts a row's bytes (null: 0). Shard sizes
    differ from the ideal by at most ``tolerance`` x the ideal or half a row on each side. More shards than
    rows leave shards empty; an empty input gives an empty result. Columns of ``rows`` named shard or slot
    are replaced.

    Shards are cut further into pieces of about ``rows_per_piece`` rows, whose number follows the input;
    a task sorts one piece, and slots continue from the exact counts of the histogram. Only the carried
    columns, the key and the size are written once to the shared folder, then read narrowly each round.
    """
    carry = [c for c in (rows.columns if carry is None else carry) if c not in ("shard", "slot")]
    stored = materialise(rows.select(
        F.coalesce(F.col(key).cast("long"), F.lit(-_SPAN)).alias("k"), F.monotonically_increasing_id().alias("seq"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("size"), F.struct(*carry).alias("row")), "shards")
    n = max(1, -(-stored.count() // (n_shards * rows_per_piece)))
    splitters, below, _ = find_splitters(stored.select("k", "seq", "size"), n_shards * n, tolerance, exact_every=n)
    first = [0, *below]
    offsets = [b - first[i // n * n] for i, b in enumerate(first)]
    piece = _pieces_below(F.col("k"), F.col("seq"), splitters)
    order = Window.partitionBy("piece").orderBy("k", "seq")
    return (stored.withColumn("piece", piece)
            .withColumn("slot", F.row_number().over(order) - 1 + F.get(long_array(offsets), F.col("piece")))
            .select("row.*", (F.col("piece") / n).cast("int").alias("shard"), F.col("slot").cast("long")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order within each file."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def op1_histogram_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 byte-balanced doc_id ranges; size is UTF-8 bytes plus 1 (null text: 1)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return histogram_shards(docs, "doc_id", F.col("size")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
