"""Conversation prefix trie by Spark SQL ROLLUP over positional columns.

The turns of a conversation are laid out as blocks of positional turn-id columns. A block is keyed by the node at
which the block before it ends (the digest of all turns up to there), so one ROLLUP over (block, key, t1 ... tW) counts
the prefixes of every length at once: grouping_id tells the depth. Conversations of any length only have more blocks.

Sums over subtrees come from a second ROLLUP, in which each conversation carries what it adds to the nodes above it.
A node belongs to its smallest member. A conversation owns the nodes from some depth on or none at all, and the turns
above that depth are shared with a smaller conversation: they are its saved turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, n_words, table

#: Turn-id columns of a block, and blocks of one conversation that one window goes through.
WIDTH, STRETCH = 8, 4096
#: Hexadecimal digits of the digest in a turn id; the words of the turn's text follow.
DIGEST = 32


def turn_id(role, text) -> Column:
    """128-bit digest of role and text (null: empty), followed by the number of words of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    return F.concat(F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary")), n_words(text).cast("string"))


def ordered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv_id, pos, turn_id) with positions from 1 by turn, null first, ties by role and text. Rows without a
    conversation's id are in no conversation.

    One range sort of all rows; a conversation's place in each partition and the rows it has in earlier ones give the
    positions, so that a conversation with a third of all rows fills as many tasks as it has partitions.
    """
    spark = turns.sparkSession
    keys = ("conv_id", "turn", "role", "text")
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        *[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))])
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *keys, "row")
    placed = materialise(dealt.sortWithinPartitions(*keys, "row").select(
        "conv_id", turn_id("role", "text").alias("turn_id"), F.monotonically_increasing_id().alias("place")), "turns")
    part = F.shiftright("place", 33)
    runs = placed.groupBy("conv_id", part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", (F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("zero"))
    return placed.withColumn("part", part).join(runs, ["conv_id", "part"]).select(
        "conv_id", (F.col("place") - F.col("zero") + 1).alias("pos"), "turn_id")


def _hashes(pos: Column, turn: Column) -> list[Column]:
    """Two 64-bit hashes of a turn at its place; the exclusive or over a prefix's turns stands for the prefix."""
    return [F.when(turn.isNotNull(), F.xxhash64(F.lit(salt), pos, turn)).otherwise(F.lit(0).cast("long")) for salt in ("a", "b")]


def _words(turn: Column) -> Column:
    return F.coalesce(F.substring(turn, DIGEST + 1, 20).cast("long"), F.lit(0).cast("long"))


def _xor(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else columns[0].bitwiseXOR(_xor(columns[1:]))


def _blocks(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """One row per conversation and block: t1 ... tW, ``reach`` (turns in the block, one more if others follow), and
    the digest (k1, k2) and words of all earlier blocks. A conversation without turns has an empty first block."""
    at = F.col("pos") - 1
    h1, h2 = _hashes(F.col("pos"), F.col("turn_id"))
    cells = turns.select("conv_id", F.floor(at / width).cast("long").alias("block"), (at % width + 1).cast("int").alias("i"),
                         "turn_id", h1.alias("h1"), h2.alias("h2"), _words(F.col("turn_id")).alias("words"))
    nothing = [F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")]
    more = cells.where("i = 1 AND block > 0").select("conv_id", F.col("block") - 1, F.lit(width + 1), *nothing)
    empty = convs.select("conv_id", F.lit(0).cast("long"), F.lit(0), *nothing)
    wide = cells.union(more).union(empty).groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("i") == i, F.col("turn_id"))).alias(f"t{i}") for i in range(1, width + 1)],
        F.max("i").alias("reach"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.sum("words").alias("words"))
    wide = materialise(wide.withColumn("stretch", F.floor(F.col("block") / STRETCH).cast("long")), "trie-wide")
    sums = [(F.bit_xor, "h1", "k1"), (F.bit_xor, "h2", "k2"), (F.sum, "words", "above")]
    zero = F.lit(0).cast("long")
    # Only conversations of more than STRETCH blocks have a later stretch, and so rows to join.
    whole = wide.join(wide.where(F.col("stretch") > 0).select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id", "stretch").agg(
        *[f(c).alias(c) for f, c, _ in sums])
    across = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("conv_id", "stretch", *[f(c).over(across).alias(f"{a}_far") for f, c, a in sums])
    within = Window.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    near = wide.select("*", *[F.coalesce(f(c).over(within), zero).alias(f"{a}_near") for f, c, a in sums]).join(before, ["conv_id", "stretch"], "left")
    both = {a: (F.col(f"{a}_near"), F.coalesce(F.col(f"{a}_far"), zero)) for _, _, a in sums}
    keyed = materialise(near.select("conv_id", "block", *[f"t{i}" for i in range(1, width + 1)], "reach", "h1", "h2", "words",
                                    *[(x + y if a == "above" else x.bitwiseXOR(y)).alias(a) for a, (x, y) in both.items()]), "trie-blocks")
    discard(wide)
    return keyed


def _rollup(wide: DataFrame, width: int, measures: str) -> DataFrame:
    """The nodes: ``depth``, the digest of the path (p1, p2) and of the parent's (q1, q2), ``above`` (words of the
    turns before the last), ``words`` (of the last), and the measures, from one ROLLUP over all blocks."""
    ts = [f"t{i}" for i in range(1, width + 1)]
    rolled = wide.sparkSession.sql(
        f"SELECT block, k1, k2, above AS earlier, {', '.join(ts)}, {width} - bit_count(grouping_id()) AS d, {measures} "
        f"FROM {{wide}} GROUP BY block, k1, k2, above, ROLLUP({', '.join(ts)})", wide=wide)
    last = F.coalesce(*[F.col(t) for t in reversed(ts)])
    # A prefix of length d has a turn in column d; the empty one stands in the first block, elsewhere it is the node before.
    there = F.when(F.col("d") == 0, F.col("block") == 0).otherwise(F.element_at(F.array(*ts), F.greatest(F.col("d"), F.lit(1))).isNotNull())
    depth = F.col("block") * width + F.col("d")
    path = [[F.col(k)] + [_hashes(F.col("block") * width + i, F.col(t))[j] for i, t in enumerate(ts, 1)] for j, k in enumerate(("k1", "k2"))]
    words = F.when(F.col("d") > 0, _words(last)).otherwise(F.lit(0).cast("long"))
    own = _hashes(depth, F.when(F.col("d") > 0, last))
    listed = sum((_words(F.col(t)) for t in ts), F.col("earlier"))
    return (rolled.where(there).withColumns({"depth": depth, "p1": _xor(path[0]), "p2": _xor(path[1]), "words": words, "above": listed - words})
            .withColumns({"q1": F.col("p1").bitwiseXOR(own[0]), "q2": F.col("p2").bitwiseXOR(own[1])})
            .drop("block", "k1", "k2", "earlier", *ts))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (p1, p2, depth, conv_id) to one comma-joined piece per path and batch."""
    for batch in batches:
        if not len(batch):
            continue
        key = [batch.column(i) for i in range(3)]
        new = [True] + pc.or_(pc.or_(*[pc.not_equal(k[1:], k[:-1]) for k in key[:2]]), pc.not_equal(key[2][1:], key[2][:-1])).to_pylist()
        first = [i for i, x in enumerate(new) if x]
        ids = batch.column(3).cast(pa.string()).to_pylist()
        joined = [",".join(ids[a:b]) for a, b in zip(first, first[1:] + [len(ids)])]
        at = pa.array(first)
        yield pa.RecordBatch.from_arrays([*[k.take(at) for k in key], batch.column(3).take(at), pa.array(joined, pa.string())],
                                         ["p1", "p2", "depth", "first", "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by path and first id to the SHA-256 of each path's list, piece after piece."""
    key, sha = None, None
    names = ["p1", "p2", "depth", "ends_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for *now, piece in zip(*columns, batch.column(4).to_pylist()):
            if now != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = now, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*key, sha.hexdigest()), kinds)], names)


def ends_digest(convs: DataFrame) -> DataFrame:
    """(p1, p2, depth, ends_sha256) from conversations (p1, p2, depth, conv_id): the SHA-256 of the ids that end at a
    path, ascending and comma-joined. The ids of a path that holds any share of all conversations are sorted and joined
    in pieces in as many tasks as they fill; one task only runs the digest over the pieces."""
    n = max(int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ("p1", "p2", "depth", "conv_id")
    pieces = convs.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(
        _joined, "p1 long, p2 long, depth long, first long, piece string")
    return pieces.repartition(n, "p1", "p2", "depth").sortWithinPartitions("p1", "p2", "depth", "first").mapInArrow(
        _digests, "p1 long, p2 long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of conversations: one row per distinct sequence of first turns.

    ``turns`` are (conv_id, pos, turn_id) with positions from 1 without gaps (see ``ordered_turns``), ``convs`` the
    distinct conv_ids, those without turns included. Returned per node: conv_id (its smallest member), depth (0: the
    root, without text), parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes in its
    subtree, itself included), saved_tokens (over its subtree, the members but one times the words of a node's last
    turn) and ends_sha256. (conv_id, depth) is the key; the last turn of a node is turn ``depth`` of its conv_id.

    Paths are compared by 128 bits of their turns' digests. A conversation may be of any length, have no turns, or be
    repeated any number of times; texts only enter by digest and word count, so their length does not matter. Without
    conversations there are no nodes, not even a root.
    """
    wide = _blocks(turns, convs, width)
    members = materialise(_rollup(wide, width, "min(conv_id) AS conv_id, max(reach) AS reach"), "trie-owners")
    owners = members.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.min_by("above", "depth").alias("saved"),
        F.max(F.when(F.col("reach") <= F.col("d"), 1).otherwise(0)).cast("long").alias("leaf"))
    totals = wide.groupBy("conv_id").agg(F.sum("words").alias("all"), F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2"),
                                         F.max(F.col("block") * width + F.least("reach", F.lit(width))).alias("depth"))
    share = materialise(totals.join(owners, "conv_id", "left").select(
        "conv_id", "p1", "p2", "depth", F.coalesce("saved", "all").alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "top"), "trie-share")
    discard(members)
    nodes = materialise(_rollup(
        wide.join(share.select("conv_id", "saved", "leaf", "top"), "conv_id"), width,
        "count(*) AS n_convs, min(conv_id) AS conv_id, sum(leaf) AS n_leaves, sum(saved) AS saved, min_by(struct(saved, top), conv_id) AS own"), "trie-nodes")
    discard(wide)
    nodes = nodes.withColumn("saved_tokens", F.col("saved") - F.col("own.saved") - (F.col("n_convs") - 1) * F.col("above"))
    # Below its top an owner's nodes have parents of its own; tops look theirs up, but for those under the root.
    root = nodes.where("depth = 0").select("conv_id").first()
    above = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    tops = nodes.where("own.top = depth AND depth > 1").select("conv_id", "depth", "q1", "q2").join(
        above.where("depth > 1"), ["q1", "q2", "depth"]).select("conv_id", "depth", "parent")
    placed = nodes.join(tops, ["conv_id", "depth"], "left").withColumn("parent_conv_id", F.when(
        F.col("depth") == 1, F.lit(root and root[0]).cast("long")).when(F.col("depth") > 1, F.coalesce("parent", "conv_id")))
    placed = materialise(placed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_leaves", "saved_tokens", "p1", "p2"), "trie-placed")
    children = placed.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    return (placed.join(children, ["conv_id", "depth"], "left").join(ends_digest(share), ["p1", "p2", "depth"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))


def rebuilt_turns(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conv_ids) of conversations that open with the first h turns of their family's first conversation,
    h = crc32(conv_id) % ``most``, followed by their own turns after the first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    opening = turns.where(f"conv_id % {family} = 0 AND pos < {most}").groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn_id"))).alias("opening"))
    convs = materialise(turns.select("conv_id").distinct().select("conv_id", base, h.cast("int").alias("h")).join(opening, "base", "left").select(
        "conv_id", F.slice(F.coalesce("opening", F.array().cast(opening.schema["opening"].dataType)), F.lit(1), F.col("h")).alias("opening"),
        "h"), "rebuilt-convs")
    first = convs.select("conv_id", F.explode("opening").alias("t")).select("conv_id", "t.pos", "t.turn_id")
    short = convs.where("size(opening) < h").select("conv_id", (F.col("h") - F.size("opening")).alias("less"))
    own = turns.where(F.col("pos") > h).join(short, "conv_id", "left").select(
        "conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "turn_id")
    return first.union(own), convs.select("conv_id")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(*rebuilt_turns(ordered_turns(table(spark, sf_dir, "conversations"))))


#: crc32 bit by bit over the decimal digits of c; reversed polynomial 0xEDB88320.
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ord(s)::BIGINT)), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)")

OP13_SQL = rf"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS turns FROM o GROUP BY conv_id),
c AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, {_CRC} % 4 AS h FROM own),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
      FROM c LEFT JOIN own b ON b.conv_id = c.base),
w AS (SELECT conv_id, turns, len(turns) AS n FROM r),
p AS (SELECT conv_id, n, d AS depth, turns[1:d] AS path FROM w, (SELECT unnest(range(0, (SELECT max(n) FROM w) + 1)) AS d) WHERE d <= n),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
                 coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends,
                 CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) END AS words
          FROM p GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, path)),
up AS (SELECT a AS depth, path[1:a] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
       FROM full_nodes, (SELECT unnest(range(0, (SELECT max(n) FROM w) + 1)) AS a) WHERE a <= depth GROUP BY 1, 2)
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children,
       up.n_leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN up ON up.depth = f.depth AND up.path = f.path
LEFT JOIN nodes q ON q.depth = f.depth - 1 AND q.path = f.path[1:f.depth - 1]
"""
