"""Spelling variants: words that differ by one edit, each sent to its most frequent neighbour.

Words are counted over whole texts.  To find all pairs that differ by one inserted, deleted or replaced code point,
each letter is hashed to one of a few symbols, so that a word becomes a reduced word.  Words one edit apart have
reduced words that are equal or one edit apart.  Hence the one-edit neighbourhood of every reduced word is generated and
joined to the reduced words of the vocabulary, and what meets is verified on the original strings.  Each pair is generated from
one side only: a replaced symbol from the smaller reduced word, a deleted one from the longer word (an insertion is the
same pair read from the other end), and nothing is lost.

A reduced word is known by a polynomial hash over its symbols, from which the hash of every edit follows in one step, so
that a word of L letters gives about L * SYMBOLS / 2 rows of 24 bytes and no strings, however long it is.  Rows that
meet are dropped at once where the parities of their letters differ in more than two bits, which one edit cannot do.
All joins are of tables as long as the vocabulary or a multiple of it, and Spark judges them by compressed files and without
the rows that a neighbourhood makes; so they are merge joins by hint, and no table goes to the driver, whatever its size.

Defined cases: null text has no words; a null doc_id counts as an empty one; repeated rows count again; a word without
near words is its own root; no words give an empty table; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import words
from marketframe.operators.landing import land

LETTER = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MISPRINT = 199
SYMBOLS = 8
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Symbol of every code point that a run can hold.
_SYMBOL = np.array([crc32(chr(c).encode()) % SYMBOLS for c in range(256)], np.uint64)
_KEYS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("letters", pa.int64())])


def misprinted(doc_id: Column, run: Column) -> Column:
    """The run without one of its code points where the hash of (doc_id, run) says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % MISPRINT == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n, id): the words of all texts with their counts; ``id`` is a hash of the word."""
    # a shorter run cannot become a word; few runs hold capitals, and only these are translated
    long_run = f"{LETTER}{{{least_length},}}"
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(long_run), F.lit(0))).alias("run")) \
        .select("doc_id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    return (runs.select(misprinted(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
            .select("word", "n", F.xxhash64("word").alias("id")))


def _keys(spread: bool):
    """Hash of each reduced word, or the hashes of its neighbourhood, with the word's id and letter parities."""
    base, inverse = np.uint64(_BASE), np.uint64(_INVERSE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, (1 << 18) if spread else (1 << 21)):
            if not batch.num_rows:
                continue
            texts = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            ids = batch.column(1).to_numpy()
            codes = np.frombuffer(b"".join(texts), np.uint8)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            starts = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(texts)), lengths)
            bits = np.bitwise_xor.reduceat(np.uint64(1) << (codes.astype(np.uint64) % np.uint64(61)), starts)
            symbol = _SYMBOL[codes]
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), base)]), dtype=np.uint64)
            place = powers[np.arange(len(codes)) - starts[owner]]
            term = (symbol + np.uint64(1)) * place
            total = np.add.reduceat(term, starts)
            if not spread:
                yield words.batch_of(_KEYS, words.mix(total).astype(np.int64), ids, bits.astype(np.int64))
                continue
            before = np.cumsum(term, dtype=np.uint64) - term
            before -= before[starts][owner]
            after = total[owner] - before - term
            found = [(owner, before + after * inverse)]
            for s in range(1, SYMBOLS):
                less = np.flatnonzero(symbol < s)
                found.append((owner[less], total[owner[less]] + (np.uint64(s) - symbol[less]) * place[less]))
            who, keys = np.concatenate([f[0] for f in found]), words.mix(np.concatenate([f[1] for f in found]))
            order = np.lexsort((keys, who))
            who, keys = who[order], keys[order]
            new = np.ones(len(who), bool)
            new[1:] = (who[1:] != who[:-1]) | (keys[1:] != keys[:-1])
            who, keys = who[new], keys[new]
            yield words.batch_of(_KEYS, keys.astype(np.int64), ids[who], bits[who].astype(np.int64))

    return run


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(one, two, n_one, n_two): every unordered pair of words that differ by exactly one edit."""
    plain = vocab.select("word", "id")
    own = land(plain.mapInArrow(_keys(False), "key long, id long, letters long"))
    spread = plain.mapInArrow(_keys(True), "key long, id long, letters long")
    other = own.select("key", F.col("id").alias("two"), F.col("letters").alias("others"))
    close = F.bit_count(F.col("letters").bitwiseXOR(F.col("others"))) <= 2
    met = spread.join(other.hint("merge"), "key").where(close & (F.col("id") != F.col("two"))).select(F.col("id").alias("one"), "two") \
        .union(own.join(other.hint("merge"), "key").where(close & (F.col("id") < F.col("two"))).select(F.col("id").alias("one"), "two"))
    side = lambda c: vocab.select(F.col("id").alias(c), F.col("word").alias(f"w_{c}"), F.col("n").alias(f"n_{c}")).hint("merge")
    return met.join(side("one"), "one").join(side("two"), "two").where(F.levenshtein("w_one", "w_two", 1) == 1) \
        .select(F.col("w_one").alias("one"), F.col("w_two").alias("two"), "n_one", "n_two")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): forms followed to the last, in rounds that double the steps.  A form is
    ``RATIO`` times as frequent as its word, so that chains have at most as many steps as the logarithm of the largest count."""
    at = land(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = land(at.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def spelling_forms(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    vocab = land(vocabulary(docs))
    pairs = near_pairs(vocab)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("one").alias("word"), F.col("two").alias("other"), F.col("n_two").alias("m")),
        F.struct(F.col("two").alias("word"), F.col("one").alias("other"), F.col("n_one").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    strong = -F.col("best.m") >= RATIO * F.col("n")
    known = land(vocab.select("word", "n").join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n")))
    last = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_spelling_forms": op12_spelling_forms}
ORACLES: dict[str, str] = {}
