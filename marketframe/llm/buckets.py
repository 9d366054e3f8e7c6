"""Candidate pairs from hash buckets, and connected components, for buckets and components of any size.

A bucket is never gathered.  Each task first replaces the members of a bucket that it holds by one of them (the
centre) and gives the others out as edges to it, so that a bucket of any size sends one row per task
through the shuffle; there the centres are joined to the smallest.  The edges of a bucket connect all its
members.  After they are checked, only buckets whose members still lie in different components are looked at
again, in tiles of bounded size and for pairs across components only, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.words import batch_of, mix
from marketframe.operators.landing import land

TILE = 1024
_SALTS = (0, 0x5DEECE66D1234567, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51, 0x6C8E9CF570932BD5)
PART_SHIFT, EDGES = 52, 128
PACKED = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
PACKED_TYPE = "part int, keys binary, a binary, b binary"
POSTING = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys and ids, the smallest id of each key, and whether a row is that one."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys, ids, ids[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))] if len(keys) else ids, first


def postings(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """What one slice of rows sends: (key, centre, null) per bucket and (key, centre, member) for the others."""
    keys, ids, centre, first = stars(keys.astype(np.int64), ids.astype(np.int64))
    keep = first | (centre != ids)
    return batch_of(POSTING, keys[keep], centre[keep], pa.array(ids[keep], mask=first[keep]))


def join_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, centre = None, None
    for batch in batches:
        linked = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        done = batch.filter(pa.array(linked))
        if done.num_rows:
            yield done
        rest = batch.filter(pa.array(~linked))
        keys, ids = rest.column(0).to_numpy(), rest.column(1).to_numpy()
        if not len(keys):
            continue
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        start = ids[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
        if key is not None and keys[0] == key:
            start = np.where(keys == key, centre, start)
        key, centre = keys[-1], start[-1]
        keep = start != ids
        if keep.any():
            yield batch_of(POSTING, keys[keep], start[keep], ids[keep])


def candidate_edges(posted: DataFrame, join=join_centres) -> DataFrame:
    """Edges (key, a, b) that connect the members of every bucket; ``posted`` comes from ``postings``."""
    route = F.when(F.col("b").isNull(), F.col("key")).otherwise(F.xxhash64("b"))
    return posted.repartition(route).sortWithinPartitions("key", "a").mapInArrow(join, "key long, a long, b long")


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values: the numbers between one cut and the next."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 8).astype(np.int32)), pa.py_buffer(values)])


def packed(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """``postings`` with the numbers of many rows in one, so that Spark moves and sorts few: part, the centres of the
    buckets in this part of the keys, and b null; or edges, dealt to any part.  Parts keep the order of the keys."""
    order = np.argsort(keys)
    keys, ids = keys[order].astype(np.int64), ids[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    own = keys[starts]
    centre = np.minimum.reduceat(ids, starts) if len(keys) else ids
    to = np.repeat(centre, np.diff(np.append(starts, len(keys))))
    edge = to != ids
    part = own >> PART_SHIFT
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(own)]]) if len(own) else np.zeros(1, np.int64)
    a, b, k = to[edge], ids[edge], keys[edge]
    ends = np.append(np.arange(0, len(a), EDGES), len(a))
    dealt = mix(b[ends[:-1]].astype(np.uint64)).astype(np.int64) >> PART_SHIFT
    none = pa.nulls(len(cuts) - 1, pa.binary())
    both = zip((pa.array(part[cuts[:-1]], pa.int32()), _blobs(own, cuts), _blobs(centre, cuts), none),
               (pa.array(dealt, pa.int32()), _blobs(k, ends), _blobs(a, ends), _blobs(b, ends)))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in both], schema=PACKED)


def _numbers(blobs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.int64)


def _join_packed(first_wanted):
    def settled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, ids = (np.concatenate([_numbers(x.column(c)) for x in held]) for c in (1, 2))
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        own, centre = keys[starts], np.minimum.reduceat(ids, starts)
        to = np.repeat(centre, np.diff(np.append(starts, len(keys))))
        edge, wanted = to != ids, first_wanted(own)
        linked = np.concatenate([np.ones(edge.sum(), bool), np.zeros(wanted.sum(), bool)])
        return batch_of(POSTING, np.concatenate([keys[edge], own[wanted]]), np.concatenate([to[edge], centre[wanted]]),
                        pa.array(np.concatenate([ids[edge], centre[wanted]]), mask=~linked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            done = batch.filter(batch.column(3).is_valid())
            if done.num_rows:
                yield batch_of(POSTING, *(_numbers(done.column(c)) for c in (1, 2, 3)))
            rest = batch.filter(batch.column(3).is_null())
            if not rest.num_rows:
                continue
            parts = rest.column(0).to_numpy()
            last = int(np.searchsorted(parts, parts[-1]))
            if held and (last or parts[-1] != at):  # all before the last part is whole
                held, rest = [*held, rest.slice(0, last)], rest.slice(last)
                yield settled(held)
                held = []
            elif last:
                yield settled([rest.slice(0, last)])
                rest = rest.slice(last)
            held.append(rest)
            at = parts[-1]
        if held:
            yield settled(held)

    return run


def packed_edges(posted: DataFrame, first_wanted) -> DataFrame:
    """``candidate_edges`` of what ``packed`` gives, and (key, first member, null) of the buckets whose keys
    ``first_wanted`` chooses.  A task holds one of 4,096 parts of the keys at a time, and the rows of one batch."""
    return posted.repartition("part").sortWithinPartitions("part").mapInArrow(_join_packed(first_wanted), "key long, a long, b long")


def pairs_of(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is its smallest id.

    Each round sends every node to the smallest of its neighbours in an order that changes by round and
    contracts the graph, so that rounds grow with the logarithm of the longest path."""
    edges = land(pairs_of(links))
    label, turn = None, 0
    while not edges.isEmpty():
        salt = F.lit(_SALTS[turn % len(_SALTS)]) + F.lit(turn // len(_SALTS))
        ranked: Column = F.col("b").bitwiseXOR(salt)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = land(both.groupBy(F.col("a").alias("v")).agg(F.min(ranked).alias("p"))
                      .select("v", F.least("p", F.col("v").bitwiseXOR(salt)).bitwiseXOR(salt).alias("p")))
        edges = land(pairs_of(edges.join(parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
                              .join(parent.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
                              .select(F.col("pa").alias("a"), F.col("pb").alias("b"))))
        if label is None:
            label = parent
        else:
            step = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            label = land(label.join(step, "p", "left").select("v", F.coalesce("q", "p").alias("p")))
        turn += 1
    if label is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    smallest = label.groupBy("p").agg(F.min("v").alias("component"))
    return land(label.join(smallest, "p").select(F.col("v").alias("id"), "component"))


def groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first ``by`` columns, each whole, from sorted batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = [table.column(c).to_numpy() for c in range(by)]
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        for start, end in zip(cuts, cuts[1:]):
            yield table.slice(start, end - start)
        held = table.slice(cuts[-1]).combine_chunks()
    if held is not None:
        yield held


def _tiles(link_tile):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in groups(batches, 3):
            key, i, j, part, ids, labels = (tile.column(c).to_numpy() for c in range(6))
            parent = {c: c for c in labels.tolist()}

            def root(c):
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            inside = i[0] == j[0]
            found = []
            linked = link_tile(int(key[0]), tile.slice(0).drop_columns(tile.column_names[:6]))
            for x in range(len(ids)):
                y = np.arange(x + 1, len(ids))
                y = y[(labels[y] != labels[x]) & (inside | (part[y] != part[x]))]
                for other, holds in linked(x, y) if y.size else ():
                    one, two = root(labels[x]), root(labels[other])
                    if one != two and holds():
                        parent[max(one, two)] = min(one, two)
                        found.append((ids[x], ids[other]))
            if found:
                yield batch_of(schema, *zip(*found))

    return run


def _tiled(members: DataFrame, tile: int) -> DataFrame:
    """(key, i, j, t, id, c): the members of each bucket dealt to pairs of tiles (i, j); t is a member's own tile.  A
    component with more than ``tile`` members has tiles of its own, which are not paired with each other; the
    other members share tiles."""
    sizes = members.groupBy("key", "c").agg(F.count("*").alias("n"))
    large = F.when(F.col("n") > tile, F.struct("c", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    buckets = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list(large).alias("large"),
                                       F.ceil(F.coalesce(F.sum(F.when(F.col("n") <= tile, F.col("n"))), F.lit(0)) / tile).cast("int").alias("shared"))
    none = F.expr("CAST(array() AS array<bigint>)")
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))
    own = F.filter("large", lambda x: x["c"] == F.col("c"))
    others = F.flatten(F.transform("large", lambda x: F.when(x["c"] == F.col("c"), none).otherwise(
        F.transform(numbers(x["tiles"]), lambda t: F.xxhash64(x["c"], t)))))
    shared = F.transform(numbers(F.col("shared")), lambda t: F.xxhash64(F.lit("shared"), t))
    slot = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    return (members.join(buckets.where("n > 2"), "key")
            .withColumn("t", F.when(F.size(own) > 0, F.xxhash64(F.col("c"), slot(own[0]["tiles"]))).otherwise(F.xxhash64(F.lit("shared"), slot(F.col("shared")))))
            .withColumn("u", F.explode(F.concat(others, shared)))
            .select("key", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", "id", "c"))


def open_links(edges: DataFrame, label: DataFrame, payload, link_tile, tile: int = TILE) -> DataFrame:
    """Links between different components of a bucket after its edges were checked; of several links that join
    the same components in a tile, the first.

    ``payload(ids)`` gives what a check needs: id and further columns.  ``link_tile(key, table of these columns)``
    returns a function that, for a row and the rows to compare it with, yields those that may be linked, each with
    a function that tells whether it is."""
    ends = edges.join(label.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left") \
        .join(label.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left") \
        .select("key", "a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    ends = land(ends)
    unsettled = land(ends.where("ca <> cb").select("key").distinct())
    both = ends.join(unsettled, "key", "left_semi")
    members = land(both.select("key", F.col("a").alias("id"), F.col("ca").alias("c")).union(both.select("key", "b", "cb")).distinct())
    tiled = land(_tiled(members, tile))
    carried = land(payload(tiled.select("id").distinct()))
    rows = tiled.join(carried, "id").select("key", "i", "j", "t", "id", "c", *(c for c in carried.columns if c != "id"))
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_tiles(link_tile), "a long, b long").distinct()


def linked_components(edges: DataFrame, links_among, payload, link_tile) -> DataFrame:
    """(id, component) of every id with a true link among the pairs of a bucketing.  ``links_among(pairs)`` keeps
    the true links of a frame of pairs (a, b); for the other arguments see ``open_links``."""
    edges = land(edges)
    links = land(links_among(pairs_of(edges)))
    label = components(links)
    more = land(open_links(edges, label, payload, link_tile))
    if more.isEmpty():
        return label
    step = components(more.join(label.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
                      .join(label.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
                      .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    step = step.select(F.col("id").alias("c"), F.col("component").alias("whole"))
    joined = label.withColumnRenamed("component", "c").join(step, "c", "left").select("id", F.coalesce("whole", "c").alias("component"))
    alone = step.select(F.col("c").alias("id"), F.col("whole").alias("component")).join(label, "id", "left_anti")
    return land(joined.union(alone))
