"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Equal vectors of a label form a class, and one of each class is indexed.  On a sample, rotations are learned that
turn centred unit vectors into balanced binary codes with little quantisation error (iterative quantisation:
sign the rotated sample, then take the rotation that fits the signs best, again and again).  Every vector's
code of ``ROTATIONS`` x dimension bits is cut into ``TABLES`` substrings.  Vectors that agree in a substring, that is
all pairs within a Hamming distance of ``TABLES`` - 1 and most beyond, meet in a bucket of that table and are
ranked by the cosine of their original vectors in double precision.  A pair counts in the first table in which
it meets.  Large buckets are cut into tiles; a tile gives counts and one edge per vector, never its pairs.

Bounds: rotations are learned on at most ``SAMPLE`` vectors, the first in the order of a hash.  Every vector is
indexed.  Recall against all pairs is measured in the tests.

Defined cases: a vector that is null, empty, zero or holds a null or a non-finite component, or whose label is
null, links with nothing; vectors of different lengths do not link; rows that repeat a vec_id are vectors of
their own; a row without vec_id has its copies' component, or a null one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import buckets, words
from marketframe.operators.landing import land

THRESHOLD = 0.98
TABLES = 12
ROTATIONS = 2
ROUNDS = 40
SAMPLE = 20_000
TILE = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay.  A power of two brings the largest component near 1 first, so that no
    finite row's squares vanish or overflow, and all others keep their bits."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0.0))
    scaled = np.ldexp(vectors, -exponent)
    norm = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / np.where(norm > 0, norm, 1)


class Codes:
    """Centre and learned rotations; ``substrings`` gives a code cut into tables."""

    def __init__(self, sample: np.ndarray, tables: int = TABLES, rotations: int = ROTATIONS, rounds: int = ROUNDS, seed: int = 6):
        at = unit(sample)
        self.centre = at.mean(axis=0)
        at = at - self.centre
        draw = np.random.default_rng(seed)
        found = []
        for _ in range(rotations):
            rotation, _ = np.linalg.qr(draw.normal(size=(at.shape[1],) * 2))
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(at @ rotation >= 0, 1.0, -1.0).T @ at)
                rotation = (u @ v).T
            found.append(rotation)
        self.rotations = np.concatenate(found, axis=1)
        self.cuts = np.linspace(0, self.rotations.shape[1], tables + 1).astype(int)

    def substrings(self, vectors: np.ndarray) -> np.ndarray:
        d = len(self.centre)
        fit = np.zeros((len(vectors), d))
        fit[:, :min(d, vectors.shape[1])] = vectors[:, :d]
        bits = (unit(fit) - self.centre) @ self.rotations >= 0
        out = np.empty((len(vectors), len(self.cuts) - 1), np.uint32)
        for t, (low, high) in enumerate(zip(self.cuts, self.cuts[1:])):
            out[:, t] = bits[:, low:high] @ (1 << np.arange(high - low, dtype=np.uint64)).astype(np.uint32)
        return out


def learned(vectors: DataFrame, sample: int = SAMPLE) -> Codes | None:
    """Codes from a bounded sample of ``vectors`` (v)."""
    found = vectors.select("v").orderBy(F.xxhash64("v")).limit(sample).toArrow().column(0).combine_chunks()
    if not len(found):
        return None
    lengths = found.value_lengths().to_numpy()
    usual = int(np.bincount(lengths).argmax())
    return Codes(found.filter(pa.array(lengths == usual)).flatten().to_numpy().astype(np.float64).reshape(-1, usual))


POSTED = "key long, tab int, id long, n long, subs binary, v binary"


def _post(codes: Codes, kind: str):
    schema = pa.schema([("key", pa.int64()), ("tab", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("subs", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, words.SLICE_BYTES // 4):
            vectors = [np.array(v.as_py(), kind) for v in batch.column(3)]
            by_length: dict[int, list[int]] = {}
            for row, v in enumerate(vectors):
                by_length.setdefault(len(v), []).append(row)
            labels = [xxhash.xxh64_intdigest(x) for x in batch.column(2).to_pylist()]
            for length, rows in by_length.items():
                subs = codes.substrings(np.stack([vectors[r] for r in rows]).astype(np.float64))
                tables = subs.shape[1]
                base = np.array([labels[r] for r in rows], np.uint64)[:, None] + np.uint64(length)
                keys = words.mix(words.mix(base + np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ subs.astype(np.uint64))
                take = np.repeat(rows, tables)
                yield words.batch_of(schema, keys.ravel().astype(np.int64), np.tile(np.arange(tables), len(rows)), batch.column(0).to_numpy()[take],
                                     batch.column(1).to_numpy()[take], [p for s in subs for p in [s.tobytes()] * tables],
                                     [p for r in rows for p in [vectors[r].tobytes()] * tables])

    return run


def _rank(threshold: float, kind: str):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in buckets.groups(batches, 3):
            n = tile.num_rows
            if n < 2:
                continue
            part, table, ids, copies = (tile.column(c).to_numpy() for c in (3, 4, 5, 6))
            vectors = np.frombuffer(b"".join(tile.column(8).to_pylist()), kind).reshape(n, -1).astype(np.float64)
            near = unit(vectors)
            linked = near @ near.T >= threshold
            linked[np.arange(n), np.arange(n)] = False
            if tile.column(1)[0] != tile.column(2)[0]:
                linked &= part[:, None] != part[None, :]
            x, y = np.nonzero(linked)
            if not len(x):
                continue
            subs = np.frombuffer(b"".join(tile.column(7).to_pylist()), np.uint32).reshape(n, -1)
            first = (subs[x] == subs[y]).argmax(axis=1) == table[0]
            x, y = x[first], y[first]
            links = np.bincount(x, copies[y], n).astype(np.int64)
            root = np.arange(n)
            while True:
                low = root.copy()
                np.minimum.at(low, x, root[y])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            some = np.flatnonzero(links)
            if len(some):
                yield words.batch_of(schema, ids[some], links[some], ids[root[some]])

    return run


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, tile: int = TILE, vector: str = "embedding") -> DataFrame:
    """One row per row of ``rows`` (vec_id, label, embedding): vec_id, n_links, component_id, kept."""
    kind = "<f4" if rows.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    classes = land(rows.where(sound).groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    codes = learned(classes, sample)
    if codes is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    posted = land(classes.where("id IS NOT NULL").select("id", "n", "label", "v").mapInArrow(_post(codes, kind), POSTED))
    large = land(posted.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > tile)
                 .select("key", F.ceil(F.col("m") / tile).cast("int").alias("tiles")))
    tiled = (posted.join(large, "key", "left").withColumn("t", F.coalesce(F.pmod(F.xxhash64("id"), F.col("tiles")), F.lit(0)).cast("int"))
             .withColumn("u", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles") - 1, F.lit(0)))))
             .select("key", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", "tab", "id", "n", "subs", "v"))
    found = land(tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_rank(threshold, kind), "id long, links long, root long"))
    label = buckets.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_class = classes.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(label, "id", "left")         .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    named = rows.withColumn("of", F.when(sound, F.col("label")))
    mine = per_class.select(F.col("label").alias("of"), "v", "links", "component")
    return named.join(mine, ["of", "v"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
ORACLES: dict[str, str] = {}
