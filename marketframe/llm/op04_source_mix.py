"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A document's size is its number of words.  Every source's documents are put in the order of a hash; a running sum of
sizes turns that order into a stream of words, and a block is the documents that start in the same
``BLOCK_WORDS`` words of it.  A source gives whole passes over its stream and, in a last one, the blocks up to
its target, the last document cut there; so each source's block quota is exact.  The quotas of all
sources are split over the output shards by a tree: at each node the left half's share of every source is a
multivariate-hypergeometric draw, seeded by the node, so that any task can follow the tree by itself and shards
get disjoint ranges of each source's permuted blocks.  Inside a shard, rows are ordered by a hash.

Target sizes: sources in code point order, null last, weigh 1, 2, 3, repeating, and share the size of the
whole; no target exceeds ``MOST_PASSES`` times its source, and the excess goes to the others by weight.

Bounds: the plan of the mix (one small row per source) is made on the driver for at most ``MAX_SOURCES`` sources; more
raise an error.  Defined cases: null text has size 0; a document of size 0 is never taken; rows that repeat a
doc_id or a whole row are taken one by one; an empty table gives an empty mix; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, gcd, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.operators.landing import land

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
BLOCK_WORDS = 4096
SHARD_WORDS = 1_000_000
MAX_SOURCES = 100_000
ROWS_PER_BUCKET = 1024
SEED = 20
_SPACE = "\\x20\\x09-\\x0D"


def target_sizes(sizes: list[int], weights: list[float], most: float = MOST_PASSES) -> list[float]:
    """Shares of the whole by weight, none above ``most`` times its size."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in over)
        free -= set(over)
    return targets


def split(quotas: np.ndarray, low: int, high: int, shards: int, seed: int) -> tuple[int, np.ndarray]:
    """The middle shard of a node that covers shards [low, high) and the left half's share of every quota."""
    middle, total = (low + high) // 2, int(quotas.sum())
    left = total * (middle - low) // (high - low)
    draw = np.random.default_rng([seed, shards, low, high])
    return middle, draw.multivariate_hypergeometric(quotas, left, method="marginals")


def leaves(source: np.ndarray, rank: np.ndarray, quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """The shard of each (source, rank of its draw)."""
    out = np.zeros(len(source), np.int64)
    todo = [(np.arange(len(source)), rank.astype(np.int64), quotas.astype(np.int64), 0, shards)]
    while todo:
        rows, ranks, counts, low, high = todo.pop()
        if high - low == 1:
            out[rows] = low
            continue
        middle, left = split(counts, low, high, shards, seed)
        goes_left = ranks < left[source[rows]]
        if goes_left.any():
            todo.append((rows[goes_left], ranks[goes_left], left, low, middle))
        if not goes_left.all():
            right = ~goes_left
            todo.append((rows[right], ranks[right] - left[source[rows[right]]], counts - left, middle, high))
    return out


def permuted(block: np.ndarray, n: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """A permutation of the blocks 0 .. n-1 (n below 2^31) of a pass."""
    return (block * factor + shift) % n


def _factor(n: int, draw: np.random.Generator) -> tuple[int, int]:
    """A multiplier without a common divisor with n, and a shift."""
    while n > 1:
        factor = int(draw.integers(1, n))
        if gcd(factor, n) == 1:
            return factor, int(draw.integers(n))
    return 1, 0


def sized(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, source, _size (the number of words), _h (the hash that orders a source) and, if wanted, the whole row
    as _row, in which no name can clash."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), *([F.struct(*docs.columns).alias("_row")] if carry else []),
                       F.coalesce(F.regexp_count("text", F.lit(f"[^{_SPACE}]+")), F.lit(0)).cast("long").alias("_size"),
                       F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(SEED)).alias("_h"))


class Plan:
    """Per source: size, target, whole passes, words of the last pass, blocks, and the draws of all sources."""

    def __init__(self, rows: DataFrame, weights=WEIGHTS, block_words=BLOCK_WORDS, shard_words=SHARD_WORDS, seed=SEED):
        found = rows.groupBy("source").agg(F.sum("_size").alias("size"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        self.sources = [r["source"] for r in found]
        self.rows = sum(r["rows"] for r in found)
        self.sizes = [r["size"] for r in found]
        self.targets = target_sizes(self.sizes, [weights[i % len(weights)] for i in range(len(found))])
        self.passes = [int(round(t)) // s if s else 0 for t, s in zip(self.targets, self.sizes)]
        self.rest = [int(round(t)) - p * s for t, p, s in zip(self.targets, self.passes, self.sizes)]
        self.block_words, self.seed = block_words, seed
        self.blocks = [ceil(s / block_words) for s in self.sizes]
        self.last = [ceil(r / block_words) for r in self.rest]
        self.quotas = np.array([p * b + q for p, b, q in zip(self.passes, self.blocks, self.last)], np.int64)
        self.shards = max(1, ceil(sum(self.sizes) / shard_words))
        draw = np.random.default_rng(seed)
        self.whole = np.array([_factor(n, draw) for n in self.blocks] or [(1, 0)], np.int64)
        self.part = np.array([_factor(n, draw) for n in self.last] or [(1, 0)], np.int64)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, s, n, t, p, r) for i, (s, n, t, p, r) in enumerate(zip(self.sources, self.sizes, self.targets, self.passes, self.rest))],
            "_source int, source string, source_size long, target double, _passes int, _rest long")


def positioned(rows: DataFrame, plan: Plan) -> DataFrame:
    """``rows`` with their source's plan and _start, the words of the source before the document.  Sums are taken by
    ranges of the hash in two levels, so that a window holds about ``ROWS_PER_BUCKET`` rows of a source of any size."""
    fine_bits = max(2, ceil(log2(max(1, plan.rows / ROWS_PER_BUCKET))) + 1)
    fine, coarse = F.shiftrightunsigned("_h", 64 - fine_bits), F.shiftrightunsigned("_h", 64 - fine_bits // 2)
    small = land(plan.table(rows.sparkSession))  # a table of known size, which Spark then sends to the rows if it is small
    rows = rows.withColumn("_fine", fine).withColumn("_coarse", coarse) \
        .join(small.withColumnRenamed("source", "_name"), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    by_fine = land(rows.groupBy("_source", "_coarse", "_fine").agg(F.sum("_size").alias("n")))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    by_coarse = by_fine.groupBy("_source", "_coarse").agg(F.sum("n").alias("n")) \
        .select("_source", "_coarse", F.coalesce(F.sum("n").over(before("_source", "_coarse")), F.lit(0)).alias("at_coarse"))
    offsets = by_fine.withColumn("at_fine", F.coalesce(F.sum("n").over(before("_source", "_coarse", "_fine")), F.lit(0))) \
        .join(by_coarse, ["_source", "_coarse"]).select("_source", "_coarse", "_fine", (F.col("at_fine") + F.col("at_coarse")).alias("_base"))
    inside = Window.partitionBy("_source", "_coarse", "_fine").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(offsets, ["_source", "_coarse", "_fine"]) \
        .withColumn("_start", F.col("_base") + F.col("_in")).drop("_in", "_base", "_fine", "_coarse", "_h")


def _shards(plan: Plan):
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            source, start, passes, turn = (c.to_numpy().astype(np.int64) for c in batch)
            blocks, last = np.array(plan.blocks, np.int64)[source], np.array(plan.last, np.int64)[source]
            block, whole = start // plan.block_words, turn < passes
            n = np.where(whole, blocks, np.maximum(last, 1))
            factor = np.where(whole[:, None], plan.whole[source], plan.part[source])
            rank = turn * blocks + permuted(block, n, factor[:, 0], factor[:, 1])
            yield pd.Series(leaves(source, rank, plan.quotas, plan.shards, plan.seed))

    return F.pandas_udf(run, "long")


def mixed(placed: DataFrame, plan: Plan) -> DataFrame:
    """The rows of the mix: one per document and pass, with pass, words (those it takes, from the document's
    start), shard and place (its order in the shard)."""
    left = F.least(F.col("_size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_start")))
    turns = placed.where("_size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("_passes")))) \
        .withColumn("words", F.when(F.col("pass") < F.col("_passes"), F.col("_size")).otherwise(left)).where("words > 0")
    # only four numbers of a row go to Python; its text stays where it is
    return turns.withColumn("shard", _shards(plan)("_source", "_start", "_passes", "pass")).withColumn("place", F.xxhash64("_source", "_start", "pass", F.lit(plan.seed)))


def in_order(mix: DataFrame) -> DataFrame:
    """Each shard in one partition and in its local order, ready to be written."""
    return mix.repartition("shard").sortWithinPartitions("shard", "place")


def first_words(text, n):
    """The first n words of a text, one space between them."""
    return F.array_join(F.slice(F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != ""), 1, n), " ")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = land(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    plan = Plan(rows)
    placed = land(positioned(rows, plan))
    # a document is in the mix at most four times: whole in each of up to three passes, and once in part
    takes = mixed(placed.drop("source"), plan).groupBy("_source", "_start").agg(
        F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("pass", "shard", "place"))).alias("takes"))
    sizable = F.when(F.col("_size") > 0, F.col("_start"))
    none = F.expr("CAST(array() AS array<bigint>)")
    return placed.withColumn("_at", sizable).join(takes.withColumnRenamed("_start", "_at"), ["_source", "_at"], "left") \
        .select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                F.coalesce("takes.shard", none).alias("shards"), F.coalesce("takes.place", none).alias("places"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: one row per pass, the document at the end of a source's last pass cut to its first words."""
    rows = sized(docs, carry=True)
    plan = Plan(rows)
    mix = in_order(mixed(positioned(rows, plan).drop("source", "doc_id"), plan))
    whole = F.col("_row.text")
    text = F.when(F.col("words") < F.col("_size"), first_words(whole, F.col("words").cast("int"))).otherwise(whole)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return mix.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


QUERIES = {"op4_source_mix": op4_source_mix}
ORACLES: dict[str, str] = {}
