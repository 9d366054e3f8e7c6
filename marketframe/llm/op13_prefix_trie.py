"""Conversation prefix trie in balanced parentheses.

Conversations that start alike share nodes; a node is the sequence of the first d turns.  A turn is known by a 128-bit
hash of role and text, a node by its depth and the exclusive or of its turns' hashes, each mixed with its depth.  That
runs over a conversation in bands of ``BAND`` turns, so a conversation of any length is spread over tasks and is never one value.

Nodes with the same members form a chain, named by (smallest member, number of members).  Only chains make the tree:
a path has at most as many chains as conversations that leave it or end on it.  The paths to the childless chains, sorted, are cut into
shards; a shard writes its part of the tree as parentheses, one pair per chain.  ``Parens`` finds the close of every open
with minima of the excess in blocks and a tree over them (range min-max); the stretch from open to close is the chain's
subtree, in which ranks of ``()`` count the childless nodes and a cumulative array adds up what sharing saves.
Chains on the way to several shards (shared spines) stand in each of them; their figures are summed, and what a
chain saves itself is counted on one of its paths only.

Defined cases: turns are ordered by turn (null first), rows that repeat a turn by role and a hash of the text, each a turn of its
own; null role or text is empty; rows without conv_id belong to no conversation and have no node; an empty table gives no
node, not even a root; columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.llm import words
from marketframe.operators import series
from marketframe.operators.landing import land

FAMILY = 20
MOST_LENT = 4
BAND = 1024
SHARD_CHAINS = 1 << 18
_KEY = ["depth", "x", "y"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, a, b, words): every turn's place, hashes and number of words; the texts stay behind.

    Rows are cut into ranges, numbered in their range and moved on by the sizes of the ranges before, so that a
    conversation of any length, or one turn that repeats, is spread."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = ["turn", "role", "a", "b"]
    ranged = land(rows.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()))
    return series.running(ranged, ["conv_id"], ["range"], order, {"idx": F.lit(1)}, inclusive=False).select("conv_id", "idx", "a", "b", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id), and their rebuilt turns (conv_id, depth, a, b, words): the first turns of the family's
    first conversation, then the own turns after as many."""
    convs = land(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_LENT))
    plan = convs.select("conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")) \
        .join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("held")), "base", "left") \
        .select("conv_id", "base", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("lent"))
    plan = land(plan)
    lenders = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("idx") < MOST_LENT - 1)).withColumnRenamed("conv_id", "base")
    lent = lenders.join(plan, "base").where("idx < h").select("conv_id", (F.col("idx") + 1).alias("depth"), "a", "b", "words")
    own = turns.join(plan, "conv_id").where("idx >= h").select("conv_id", (F.col("idx") - F.col("h") + F.col("lent") + 1).alias("depth"), "a", "b", "words")
    return plan.select("conv_id"), lent.union(own)


def with_node_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, px, py, words): each turn with the key of its node and of the node above."""
    rows = land(turns.select("conv_id", "depth", F.shiftright("depth", BAND.bit_length() - 1).alias("band"),
                             F.xxhash64("depth", "a", "b").alias("hx"), F.xxhash64("b", "depth", "a").alias("hy"), "words"))
    earlier = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "band").agg(F.bit_xor("hx").alias("tx"), F.bit_xor("hy").alias("ty")).select(
        "conv_id", "band", *[F.coalesce(F.bit_xor(f"t{c}").over(earlier), F.lit(0).cast("long")).alias(f"b{c}") for c in "xy"])
    so_far = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = rows.join(before, ["conv_id", "band"]).select(
        "conv_id", "depth", "words", "hx", "hy", *[F.col(f"b{c}").bitwiseXOR(F.bit_xor(f"h{c}").over(so_far)).alias(c) for c in "xy"])
    return keyed.select("conv_id", *_KEY, *[F.col(c).bitwiseXOR(F.col(f"h{c}")).alias(f"p{c}") for c in "xy"], "words")


class Parens:
    """Balanced parentheses with the excess after every place, its minima in blocks and in a tree over the blocks."""

    BLOCK = 64
    STEP = 1 << 12

    def __init__(self, opens: np.ndarray):
        self.opens = opens.astype(bool)
        self.excess = np.cumsum(np.where(self.opens, 1, -1)).astype(np.int32)
        most = np.iinfo(np.int32).max
        full = np.full(max(1, -(-len(opens) // self.BLOCK)) * self.BLOCK, most, np.int32)
        full[:len(opens)] = self.excess
        self.blocks = full.reshape(-1, self.BLOCK)
        self.low = [self.blocks.min(axis=1)]
        while len(self.low[-1]) > 1:
            row = np.append(self.low[-1], most) if len(self.low[-1]) % 2 else self.low[-1]
            self.low[-1] = row
            self.low.append(row.reshape(-1, 2).min(axis=1))
        pair = np.zeros(len(opens), np.int64)
        pair[:-1] = self.opens[:-1] & ~self.opens[1:]
        self.pairs = np.concatenate([[0], np.cumsum(pair)])

    def leaves(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Number of ``()`` from an open to its close, by the difference of their ranks."""
        return self.pairs[close] - self.pairs[at]

    def findclose(self, at: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(self._findclose(at[i:i + self.STEP]) for i in range(0, len(at), self.STEP))])

    def _findclose(self, at: np.ndarray) -> np.ndarray:
        """The first place after ``at`` whose excess is one less: in its own block, else in the next block to the right
        whose minimum is as low, found by climbing the tree and coming down again."""
        target = self.excess[at] - 1
        block, out = at // self.BLOCK, np.full(len(at), -1, np.int64)
        hit = (self.blocks[block] <= target[:, None]) & (np.arange(self.BLOCK) > (at % self.BLOCK)[:, None])
        here = hit.any(axis=1)
        out[here] = at[here] - at[here] % self.BLOCK + hit[here].argmax(axis=1)
        open_ = np.flatnonzero(~here)
        node, turned = block[open_], np.full(len(open_), -1)
        for level, low in enumerate(self.low[:-1]):
            climbing = turned < 0
            beside = np.minimum(node + 1, len(low) - 1)
            turn = climbing & (node % 2 == 0) & (low[beside] <= target[open_])
            turned[turn], node = level, np.where(turn, node + 1, np.where(climbing, node // 2, node))
        for level in range(len(self.low) - 1, 0, -1):
            down = turned >= level
            left = np.where(down, 2 * node, 0)
            node = np.where(down, np.where(self.low[level - 1][left] <= target[open_], left, left + 1), node)
        rest = self.blocks[node] <= target[open_][:, None]
        out[open_] = node * self.BLOCK + rest.argmax(axis=1)
        return out


_FIGURES = pa.schema([("m", pa.int64()), ("n", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parentheses of one shard's sorted paths, and what each chain's subtree holds in it."""
    last: list[int] = []
    opens, m, n, own, stack = [], [], [], [], []
    for batch in words.slices(batches):
        for path, counts, saved in zip(*(c.to_pylist() for c in batch.columns)):
            shared = 0
            while shared < min(len(path), len(last)) and path[shared] == last[shared]:
                shared += 1
            for level in range(shared):
                own[stack[level]] += saved[level]
            opens.append(np.repeat(np.array([0, 1], np.uint8), [len(last) - shared, len(path) - shared]))
            stack[shared:] = range(len(m), len(m) + len(path) - shared)
            m += path[shared:]
            n += counts[shared:]
            own += saved[shared:]
            last = path
    if not m:
        return
    tree = Parens(np.concatenate([*opens, np.zeros(len(last), np.uint8)]))
    at = np.flatnonzero(tree.opens)
    close = tree.findclose(at)
    gained = np.zeros(len(tree.opens) + 1, np.int64)
    gained[at + 1] = own
    gained = np.cumsum(gained)
    for i in range(0, len(at), 1 << 16):
        part = slice(i, i + (1 << 16))
        yield words.batch_of(_FIGURES, m[part], n[part], tree.leaves(at[part], close[part]), gained[close[part]] - gained[at[part]])


def subtree_figures(paths: DataFrame, shard_chains: int = SHARD_CHAINS) -> DataFrame:
    """(m, n, leaves, saved) of every chain for ``paths`` (ms, ns, own): the smallest members, the numbers of members and what to
    count, of the chains on the way to each childless one."""
    size = paths.agg(F.sum(F.size("ms"))).first()[0] or 0
    shards = paths.repartitionByRange(max(1, ceil(size / shard_chains)), "ms").sortWithinPartitions("ms")
    return shards.mapInArrow(_shard, "m long, n long, leaves long, saved long").groupBy("m", "n") \
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


_PIECE = pa.schema([("m", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])
_HASH = pa.schema([("m", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m, depth, ids = (c.to_numpy() for c in batch.columns)
        if not len(m):
            continue
        cuts = np.concatenate([[0], np.flatnonzero((m[1:] != m[:-1]) | (depth[1:] != depth[:-1])) + 1, [len(m)]])
        named = list(map(str, ids.tolist()))
        yield words.batch_of(_PIECE, m[cuts[:-1]], depth[cuts[:-1]], ids[cuts[:-1]], [",".join(named[i:j]) for i, j in zip(cuts, cuts[1:])])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    for batch in batches:
        out = []
        for m, depth, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if (m, depth) == key:
                state.update(b"," + piece.encode())
                continue
            if key:
                out.append((*key, state.hexdigest()))
            key, state = (m, depth), hashlib.sha256(piece.encode())
        if out:
            yield words.batch_of(_HASH, *zip(*out))
    if key:
        yield words.batch_of(_HASH, *zip(*[(*key, state.hexdigest())]))


def end_hashes(ends: DataFrame) -> DataFrame:
    """(m, depth, ends_sha256) for ``ends`` (m, depth, conv_id).  Ids are joined to pieces in their ranges, and the pieces of a
    node pass one hash in order, as a stream."""
    pieces = ends.repartitionByRange("m", "depth", "conv_id").sortWithinPartitions("m", "depth", "conv_id") \
        .mapInArrow(_pieces, "m long, depth long, first long, piece string")
    return pieces.repartition("m", "depth").sortWithinPartitions("m", "depth", "first").select("m", "depth", "piece") \
        .mapInArrow(_digests, "m long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_chains: int = SHARD_CHAINS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    convs, turns = rebuilt(land(turns_of(conversations)))
    keyed = land(with_node_keys(turns))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("m"), F.count("*").alias("n")).where("n > 0") \
        .select(*[zero.alias(c) for c in _KEY], "m", "n", zero.alias("words"), F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"))
    nodes = land(keyed.groupBy(*_KEY).agg(F.min("conv_id").alias("m"), F.count("*").alias("n"), F.min("words").alias("words"),
                                          F.min("px").alias("px"), F.min("py").alias("py")).union(root))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("m").alias("pm"), F.col("n").alias("pn"))
    placed = land(nodes.join(above, ["depth", "px", "py"], "left").select(*_KEY, "m", "n", "words", "pm", "pn"))
    children = placed.where("pm IS NOT NULL").groupBy(F.col("pm").alias("m"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    known = land(placed.join(children, ["m", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))
                 .withColumn("top", F.col("pn").isNull() | (F.col("pn") != F.col("n"))))
    saves = (F.col("n") - 1) * F.col("words")

    # the way from the root to every childless chain, as the chains that begin on it
    leaf = known.where("n_children = 0").select(F.col("m").alias("conv_id"))
    starts = keyed.select("conv_id", *_KEY).union(leaf.select("conv_id", *[zero.alias(c) for c in _KEY])) \
        .join(leaf, "conv_id", "left_semi").join(known.where("top").select(*_KEY, "m", "n"), _KEY).select("conv_id", "depth", "m", "n")
    starts = land(starts)
    chains = known.groupBy("m", "n").agg(F.sum(saves).alias("own")) \
        .join(starts.groupBy("m", "n").agg(F.min("conv_id").alias("owner")), ["m", "n"])
    step = F.struct("depth", "m", "n", F.when(F.col("conv_id") == F.col("owner"), F.col("own")).otherwise(zero).alias("own"))
    paths = starts.join(chains, ["m", "n"]).groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("p")) \
        .select(F.col("p.m").alias("ms"), F.col("p.n").alias("ns"), F.col("p.own").alias("own"))
    figures = subtree_figures(land(paths), shard_chains)

    last = keyed.groupBy("conv_id").agg(F.max(F.struct("depth", "x", "y")).alias("k")).select("conv_id", "k.*")
    last = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in _KEY])
    ends = end_hashes(last.join(known.select(*_KEY, "m"), _KEY).select("m", "depth", "conv_id"))

    # a chain's node has below it what the chain has, less what the chain's nodes above it save
    so_far = series.running(known.withColumn("band", F.shiftright("depth", BAND.bit_length() - 1)), ["m", "n"], ["band"], ["depth"], {"passed": saves}, inclusive=False)
    return so_far.join(figures, ["m", "n"]).join(ends, ["m", "depth"], "left").select(
        F.col("m").alias("conv_id"), "depth", F.col("pm").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("passed")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES: dict[str, str] = {}
