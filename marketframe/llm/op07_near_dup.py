"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets form a class; one of each class is hashed.  Bands of its min-hash signature
give candidate pairs.  A pair's signatures are compared in batches, and after each batch the pair is dropped if
the posterior probability that its similarity reaches the threshold, given the matches so far and a uniform
prior, is below ``miss``.  Survivors are checked exactly on their full shingle sets.

Defined cases: a text that is null, empty or white space has no shingles and links with nothing; a text with
fewer than ``k`` words is one shingle; rows that repeat a doc_id are one document for links and each get a
row; a row without doc_id is kept, with a null component; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import buckets, words
from marketframe.operators.landing import land

BANDS, ROWS = 32, 6
BATCH = 32
MISS = 1e-5


def _signatures(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, factors = words.WordHash(), words.multipliers(BANDS * ROWS)
        for batch in words.slices(batches):
            ids, texts = batch.column(0), batch.column(1)
            sequences = [words.hashes(words.ascii_words(t.as_py()), cache) for t in texts]
            values, starts = words.distinct(*words.shingles(sequences, k))
            counts = np.diff(starts)
            full = np.flatnonzero(counts)
            sig, sets = [None] * len(counts), [None] * len(counts)
            if full.size:
                at = np.append(starts[:-1][full], starts[-1])
                hashed = words.min_hashes(values, at, factors)
                one = np.add.reduceat(words.mix(values ^ np.uint64(0x1234567)), at[:-1])
                two = np.add.reduceat(words.mix(values ^ np.uint64(0x89ABCDEF)), at[:-1])
                for row, i in enumerate(full):
                    sig[i] = hashed[row].tobytes()
                    sets[i] = int(counts[i]).to_bytes(8) + one[row].tobytes() + two[row].tobytes()
            yield batch_of(schema, ids, counts, sets, sig)

    batch_of = words.batch_of
    return run


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches):
        ids = batch.column(0).to_numpy()
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(ids), -1)
        keys = words.band_keys(sig, BANDS)
        yield buckets.postings(keys.ravel(), np.repeat(ids, BANDS))


def least_matches(n: int, percent: int, miss: float) -> int:
    """Fewest of n matches at which the posterior probability of a similarity of at least ``percent`` % is
    not below ``miss``: with a uniform prior it is the chance of at most m successes in n + 1 draws."""
    t, below = percent / 100, 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def _prune(percent: int, miss: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    need = [(n, least_matches(n, percent, miss)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            left, matched = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for n, least in need:
                matched = matched + (one[left, n - BATCH:n] == two[left, n - BATCH:n]).sum(axis=1)
                stay = matched >= least
                left, matched = left[stay], matched[stay]
            yield batch.select([0, 1]).take(pa.array(left)).cast(schema)

    return run


def _set(text: str | None, k: int) -> set:
    w = words.ascii_words(text)
    return set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)} if w else set()


def _confirm(k: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = _set(x.as_py(), k), _set(y.as_py(), k)
                both = len(one & two)
                keep.append(100 * both >= percent * (len(one) + len(two) - both) > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_())).cast(schema)

    return run


def _tile(k: int, percent: int, miss: float):
    need = [(n, least_matches(n, percent, miss)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def link_tile(key: int, table: pa.Table):
        """Pairs that share an earlier band are left to that band's bucket."""
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(table.num_rows, -1)
        keys = words.band_keys(sig, BANDS)
        earlier = keys[:, :int(np.argmax((keys.view(np.int64) == key).all(axis=0)))]
        texts, sets = table.column("text"), {}

        def set_of(x: int) -> set:
            if x not in sets:
                sets[x] = _set(texts[x].as_py(), k)
            return sets[x]

        def holds(x: int, y: int) -> bool:
            one, two = set_of(x), set_of(y)
            both = len(one & two)
            return 100 * both >= percent * (len(one) + len(two) - both)

        def linked(x: int, y: np.ndarray):
            y = y[~(earlier[y] == earlier[x]).any(axis=1)]
            matched = np.zeros(len(y), np.int64)
            for n, least in need:
                matched = matched + (sig[y, n - BATCH:n] == sig[x, n - BATCH:n]).sum(axis=1)
                y, matched = y[matched >= least], matched[matched >= least]
            return [(int(z), lambda z=int(z): holds(x, z)) for z in y[np.argsort(-matched, kind="stable")]]

        return linked

    return link_tile


def _side(table: DataFrame, end: str, value: str) -> DataFrame:
    return table.select(F.col("doc_id").alias(end), F.col(value).alias(f"{value}_{end}"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = land(docs.mapInArrow(_signatures(k), "doc_id long, n_shingles long, set_id binary, sig binary"))
    named = signed.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    classes = land(named.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")))
    sigs = land(named.join(classes.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.first("sig").alias("sig")))
    edges = buckets.candidate_edges(sigs.mapInArrow(_post, "key long, a long, b long"))
    texts = docs.where("doc_id IS NOT NULL")

    def links_among(pairs: DataFrame) -> DataFrame:
        likely = pairs.join(_side(sigs, "a", "sig"), "a").join(_side(sigs, "b", "sig"), "b").select("a", "b", "sig_a", "sig_b") \
            .mapInArrow(_prune(percent, miss), "a long, b long")
        return land(likely).join(_side(texts, "a", "text"), "a").join(_side(texts, "b", "text"), "b") \
            .select("a", "b", "text_a", "text_b").mapInArrow(_confirm(k, percent), "a long, b long").distinct()

    def payload(ids: DataFrame) -> DataFrame:
        named_ids = ids.withColumnRenamed("id", "doc_id").hint("merge")
        return sigs.join(named_ids, "doc_id", "left_semi").join(texts.join(named_ids, "doc_id", "left_semi"), "doc_id") \
            .select(F.col("doc_id").alias("id"), "sig", "text").dropDuplicates(["id"])

    linked = buckets.linked_components(edges, links_among, payload, _tile(k, percent, miss))
    links = linked.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    members = named.join(classes.withColumnRenamed("doc_id", "a"), "set_id").select("a", F.col("doc_id").alias("b"))
    label = buckets.components(links.union(members)).select(F.col("id").alias("doc_id"), "component")
    return (signed.select("doc_id", "n_shingles").join(label, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, judged on five-word shingles."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


QUERIES = {"op7_near_dup": op7_near_dup}
ORACLES: dict[str, str] = {}
