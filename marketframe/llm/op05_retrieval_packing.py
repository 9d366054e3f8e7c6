"""Lexical retrieval packing: windows of a seed document and its nearest unused neighbours by BM25.

Documents are dealt to shards of about ``SHARD_BYTES`` bytes by the last of their words in code point order, so that
texts with the same words tend to meet; a shard that would grow too large (one word may hold a third of all
rows) is split by a hash of the row.  Each shard is tokenised and indexed by itself: an inverted index over
token ids with BM25 weights.  A window starts with what is left of the document that was cut last, or with the
next unused document; the unused neighbours of that seed follow in order of score, then the next unused documents.
A document is cut where its window ends, so that only the last window of a shard is not full; that one is
cut into powers of two, which need no padding.

Defined cases: a null text is empty and gives the end id alone; rows that repeat a doc_id are packed one by
one; a row without doc_id is packed like any other; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, islice
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import words
from marketframe.llm.buckets import groups
from marketframe.operators.landing import land

WINDOW = 2048
END_ID = 1
SHARD_BYTES = 2_000_000
BINS = 1 << 20
K1, B = 1.2, 0.75
SEQUENCE_BITS = 24
CACHED = 350_000


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Tokens:
    """Token ids of texts as little-endian 32-bit numbers.

    Texts of ASCII and Latin-1 letters are taken apart at spaces, across which no token reaches; each of their distinct
    stretches is looked up once, a new one by its words, and the ids of ``CACHED`` stretches are remembered.  Any other
    text is encoded as a whole."""

    # Fixed value: the tokenizer's pattern, for lower-case text of the characters below.
    WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^\sa-z0-9\xDF-\xF6\xF8-\xFF]+")
    PLAIN = re.compile(r"[\x20-\x7E\n\t\r\xC0-\xFF]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.model = Tokenizer.from_file(path)
        self.merges = self.model.model
        self.mapped = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.known, self.flat, self.bounds = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, found: list[str]) -> dict[str, bytes]:
        """Ids of single words; of the tokenizer's steps before the merges only the byte mapping changes them."""
        each = [[token.id for token in self.merges.tokenize(x if x.isascii() else self.mapped(x)[0][0])] for x in found]
        raw, cuts = np.array(list(chain.from_iterable(each)), "<u4").tobytes(), [0, *accumulate(map(len, each))]
        return {x: raw[4 * a:4 * b] for x, a, b in zip(found, cuts, cuts[1:])}

    def _new(self, found: list[str]) -> dict[str, bytes]:
        """Ids of several stretches, by their words."""
        parts = [[x] if x.isalpha() else self.WORD.findall(x) for x in found]
        new = self._words(list(set(chain.from_iterable(parts))))
        return {x: new[own[0]] if len(own) == 1 else b"".join([new[p] for p in own]) for x, own in zip(found, parts)}

    def _stretches(self, found: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct stretches: all ids, and where those of each stretch start and end."""
        at = pc.index_in(found, value_set=self.known)
        new = found.filter(at.is_null())
        ids = list(self._new(pc.binary_join(pa.ListArray.from_arrays([0, len(new)], new), " ")[0].as_py().split(" ")).values()) if len(new) else []
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
        at = at.to_numpy(zero_copy_only=False)
        none = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
        at = np.where(none, len(self.known) - 1 + np.cumsum(none), at).astype(np.int64)
        kept = min(len(ids), CACHED - len(self.known))
        if kept > 0:
            self.known = pa.concat_arrays([self.known, new[:kept]])
            self.bounds = bounds[:len(self.known) + 1]
            self.flat = flat[:self.bounds[-1]].copy()
        return flat, bounds[at], bounds[at + 1]

    def of(self, texts: list[str | None]) -> list[bytes]:
        plain = [n for n, text in enumerate(texts) if text and "<|" not in text and self.PLAIN.fullmatch(text)]
        out = [b""] * len(texts)
        for n in set(range(len(texts))).difference(plain):
            out[n] = self._whole(texts[n]) if texts[n] else b""
        if plain:
            split = pc.ascii_split_whitespace(pa.array([texts[n].lower() for n in plain], pa.string()))
            coded = split.flatten().dictionary_encode()
            codes = coded.indices.to_numpy()
            flat, starts, ends = self._stretches(coded.dictionary)
            sizes = (ends - starts)[codes]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            raw = flat[np.repeat(starts[codes] - bounds[:-1], sizes) + np.arange(bounds[-1])].tobytes()
            cuts = (4 * bounds[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]).tolist()
            for n, a, b in zip(plain, cuts, cuts[1:]):
                out[n] = raw[a:b]
        return out


@cache
def tokens_of(path: str) -> Tokens:
    """One for each worker process, so that tasks share what it remembers."""
    return Tokens(path)


class Index:
    """Inverted BM25 index over the token ids of a shard's documents."""

    def __init__(self, docs: list[np.ndarray]):
        lengths = np.array([len(d) for d in docs], np.float64)
        each = [np.unique(d, return_counts=True) for d in docs]
        term = np.concatenate([t for t, _ in each])
        count = np.concatenate([c for _, c in each]).astype(np.float64)
        doc = np.repeat(np.arange(len(docs)), [len(t) for t, _ in each])
        order = np.argsort(term, kind="stable")
        self.terms, self.starts, sizes = np.unique(term[order], return_index=True, return_counts=True)
        self.ends = self.starts + sizes
        idf = np.log1p((len(docs) - sizes + 0.5) / (sizes + 0.5))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1))
        self.doc = doc[order]
        self.weight = np.repeat(idf, sizes) * (count * (K1 + 1) / (count + norm[doc]))[order]
        self.own = np.split(np.searchsorted(self.terms, term), np.cumsum([len(t) for t, _ in each])[:-1])
        self.n = len(docs)

    def keep(self, docs: np.ndarray) -> None:
        """Only these documents (a mask) may be found from now on; any may still be a seed."""
        kept = docs[self.doc]
        before = np.concatenate([[0], np.cumsum(kept)])
        self.starts, self.ends = before[self.starts], before[self.ends]
        self.doc, self.weight = self.doc[kept], self.weight[kept]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first."""
        at = self.own[seed]
        parts = [slice(s, e) for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist())]
        score = np.bincount(np.concatenate([self.doc[p] for p in parts]), np.concatenate([self.weight[p] for p in parts]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def fill(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    index = Index(docs)
    unused = np.ones(len(docs), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    following, sequence, cut, kept = 0, 0, None, len(docs)
    while True:
        offset, seed, ahead = 0, None, iter(())
        while offset < window:
            if cut:
                doc, start = cut
                cut = None
            else:
                doc = next((d for d in ahead if unused[d]), None)
                if doc is None:
                    while following < len(docs) and not unused[following]:
                        following += 1
                    if following == len(docs):
                        break
                    doc = following
                start, unused[doc] = 0, False
            length = min(len(docs[doc]) - start, window - offset)
            pieces.append((doc, start, length, sequence, offset))
            offset += length
            if start + length < len(docs[doc]):
                cut = (doc, start + length)
            elif seed is None and offset < window:
                seed = doc
                left = int(unused.sum())
                if left < kept * 7 // 8:
                    index.keep(unused)
                    kept = left
                ahead = iter(index.neighbours(seed, unused).tolist())
        if not offset:
            return pieces
        if offset < window:
            last = [p for p in pieces if p[3] == sequence]
            return pieces[:len(pieces) - len(last)] + in_powers(last, offset, sequence)
        sequence += 1


def in_powers(pieces: list[tuple[int, int, int, int, int]], total: int, sequence: int) -> list[tuple[int, int, int, int, int]]:
    """The pieces of one window of ``total`` tokens dealt to sequences whose lengths are powers of two."""
    out, done = [], 0
    bounds = []
    while done < total:
        size = 1 << ((total - done).bit_length() - 1)
        bounds.append((done, done + size))
        done += size
    for n, (low, high) in enumerate(bounds):
        for doc, start, length, _, offset in pieces:
            a, b = max(low, offset), min(high, offset + length)
            if a < b:
                out.append((doc, start + a - offset, b - a, sequence + n, a - low))
    return out


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack(path: str):
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = tokens_of(path), np.array([END_ID], "<u4").tobytes()
        for shard in groups(words.slices(batches), 1):
            first = int(shard.column(0)[0].as_py()) << SEQUENCE_BITS
            ids = shard.column("doc_id").to_pylist()
            docs = [np.frombuffer(x + end, "<u4") for x in tokens.of(shard.column("text").to_pylist())]
            found = fill(docs)
            for at in range(0, len(found), 4096):
                part = found[at:at + 4096]
                yield words.batch_of(schema, [ids[d] for d, *_ in part], [p[1] for p in part], [p[2] for p in part], [len(docs[p[0]]) for p in part],
                                     [first + p[3] for p in part], [p[4] for p in part], [docs[p[0]][p[1]:p[1] + p[2]].tobytes() for p in part])

    return run


def sharded(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, row, doc_id, text); ``row`` orders a shard."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    last = F.array_max(F.split(F.coalesce("text", F.lit("")), " "))
    rows = rows.withColumn("bin", F.pmod(F.xxhash64(last), F.lit(BINS)))
    sizes = land(rows.groupBy("bin").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")))
    n = min(BINS, max(1, ceil((sizes.agg(F.sum("size")).first()[0] or 0) / shard_bytes)))
    bucket = F.floor(F.col("bin") * n / BINS)
    large = land(sizes.groupBy(bucket.alias("bucket")).agg(F.sum("size").alias("size")).where(F.col("size") > 2 * shard_bytes)
                 .select("bucket", F.ceil(F.col("size") / shard_bytes).alias("parts")))
    keyed = rows.withColumn("bucket", bucket).withColumn("row", F.xxhash64("doc_id", "text"))
    part = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0))
    return keyed.join(large, "bucket", "left").select((F.col("bucket") + part * n).alias("shard"), "row", "doc_id", "text")


def pack(docs: DataFrame, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned
    32-bit token ids).  ``path`` names the tokenizer's file."""
    return sharded(docs, shard_bytes).repartition("shard").sortWithinPartitions("shard", "row", "doc_id") \
        .mapInArrow(_pack(path or tokenizer_path()), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents, piece by piece, with their token ids."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


QUERIES = {"op5_retrieval_packing": op5_retrieval_packing}
ORACLES: dict[str, str] = {}
