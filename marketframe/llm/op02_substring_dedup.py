"""Substring dedup by paragraph MinHash banding.

A paragraph is a line, cut further after the end of a sentence, so that a passage that was pasted into the
middle of another text falls into the same paragraphs there.  Paragraphs of ``MIN_WORDS`` words and more are
hashed as sets of word shingles; bands tuned for the wanted recall give colliding paragraphs; pairs are
checked by the exact Jaccard similarity of their shingles; of each connected component the first paragraph
(smallest doc_id, then position) stays.  Equal paragraphs (equal 62-bit hashes of their words) are one class before
banding: bands, pairs and checks are those of classes, so that a passage costs one paragraph however often it is copied.
A shorter paragraph is compared together with its neighbours: the fewest
paragraphs from it ahead, and the fewest up to it, that have ``MIN_WORDS`` words form a run, and equal runs are one
component, so that a passage of short lines goes like any other, up to its edges.  A shorter paragraph between two
removed longer ones goes with them.  Scripts without spaces count two characters as a word.

Defined cases: null and empty texts have no paragraphs and come back as they are; text that stays is never
changed; rows that repeat a doc_id are versions of one document: equal texts are cut alike, and of different ones
a paragraph that has the same place in both is no copy; rows without doc_id are not compared and stay whole; columns
besides ``doc_id`` and ``text`` are ignored; a doc_id of 2^39 and more and a text of 2^23 compared paragraphs raise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain, islice
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import buckets, words
from marketframe.operators.landing import land, release

MIN_WORDS = 8
ROWS = 2
RECALL = 0.9999
POSITION_BITS = 24
RUN, PARAGRAPH, BAND = 0, 1, 2  # lowest two bits of a bucket's key
POSTED = 1 << 20
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
#: What a byte counts in the hash of a word: white space nothing.
_VALUE = np.where(np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]), 0, np.arange(1, 257)).astype(np.uint64)
#: Begins with one set of characters, which a search skips to.
_END = re.compile(r"[.!?…。！？\n](?:(?<!\n)[.!?…。！？]*[\"'”’)\]]*\s+|(?<=[。！？])[.!?…。！？]*[\"'”’)\]」』】）]*\s*|(?<=\n)\s*)")
# Thai, Lao, Myanmar, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")


def tuned_bands(percent: int, recall: float, rows: int = ROWS) -> int:
    """Fewest bands of ``rows`` values with which a pair at the threshold collides with probability ``recall``."""
    return ceil(log(1 - recall) / log(1 - (percent / 100) ** rows))


def paragraphs(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each paragraph; together they are the whole text."""
    cuts = [0, *[m.end() for m in _END.finditer(text or "")]]
    if cuts[-1] < len(text or ""):
        cuts.append(len(text))
    return list(zip(cuts, cuts[1:]))


def words_of(text: str) -> tuple[list[bytes], int]:
    """The words of a paragraph, with each character of a script without spaces as one, and how many they count for."""
    characters = 0
    if not text.isascii():
        text, characters = _UNSPACED.subn(r" \g<0> ", text)
    found = words.ascii_words(text)
    return found, len(found) - characters // 2


def pieces(sizes: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """First and last (exclusive) paragraph of all that is compared, and its number: each paragraph of ``min_words``
    words and more by itself, its number its place; and the runs of as many words that start or end with a shorter
    one, numbered by ``run_at``."""
    found, n = [], len(sizes)
    total = [0, *accumulate(sizes)]
    forward = backward = 0
    for i, size in enumerate(sizes):
        while forward <= n and total[forward] < total[i] + min_words:
            forward += 1
        while backward < i and total[backward + 1] <= total[i + 1] - min_words:
            backward += 1
        if size >= min_words:
            found.append((i, i + 1, i))
            continue
        if size and forward <= n:
            found.append((i, forward, 2 * i))
        if size and total[i + 1] >= min_words and not (sizes[backward] and total[i] < total[backward] + min_words):
            found.append((backward, i + 1, 2 * i + 1))
    return found


def run_at(number: int, size_of, n: int, min_words: int) -> tuple[int, int] | None:
    """The run with this number in a document of ``n`` paragraphs: an even number's half is the paragraph from which
    it goes ahead, an odd one's the paragraph up to which it goes; a run that is both is numbered by its start."""
    i, size = number >> 1, 0
    if i >= n:
        return None
    if number & 1:
        first = i + 1
        while size < min_words and first:
            first -= 1
            size += size_of(first)
        return (first, i + 1) if size >= min_words else None
    end = i
    while size < min_words and end < n:
        size += size_of(end)
        end += 1
    return (i, end) if size >= min_words else None


def runs_at(numbers: np.ndarray, total: np.ndarray, begin: np.ndarray, end: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``run_at`` of many numbers at once: ``total`` has the words before each paragraph of several texts and before the
    end, ``begin`` and ``end`` the paragraphs of each number's text.  What is no run is empty."""
    at = begin + (numbers >> 1)
    known = at < end
    at = np.where(known, at, 0)
    first = np.where(numbers & 1, np.searchsorted(total, total[at + 1] - min_words, "right") - 1, at)
    last = np.where(numbers & 1, at + 1, np.searchsorted(total, total[at] + min_words))
    known &= (first >= begin) & (last <= end)
    return np.where(known, first, 0), np.where(known, last, 0)


def _name(doc_id: int, position: int) -> int:
    if position >> POSITION_BITS or abs(doc_id) >> (63 - POSITION_BITS):
        raise ValueError(f"paragraph {position} of document {doc_id} has no 64-bit name")
    return (doc_id << POSITION_BITS) + position


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


def word_hashes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words of ``text`` (bytes) that start there; white space counts nothing."""
    out = np.empty(len(starts), np.uint64)
    ends = np.append(starts, len(text))
    powers = _powers(_BASE, int(np.diff(ends).max(initial=0)))
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(text), CHUNK)), len(starts)))
    for i, j in zip(cuts, cuts[1:]):
        own = text[ends[i]:ends[j]]
        place = np.arange(len(own)) - np.repeat(ends[i:j] - ends[i], np.diff(ends[i:j + 1]))
        out[i:j] = np.add.reduceat(_VALUE[own] * powers[place], ends[i:j] - ends[i])
    return words.mix(out)


def _between(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each first to its end, one after the other."""
    n = end - first
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


class Read:
    """The paragraphs of several texts, one after the other.

    ``hashes`` has their words', ``words`` the place of each paragraph's first word there and the end, ``sizes`` what its words
    count for, ``total`` the sums of these before each paragraph and the end, ``keys`` the key of its class."""

    def __init__(self, texts: list[str], spans: list[list[tuple[int, int]]]):
        parts, lengths, unspaced = [], [], []
        for text, own in zip(texts, spans):
            if text.isascii():
                parts.append(text.encode())
                lengths += [end - start for start, end in own]
                continue
            cut = [text[start:end] for start, end in own]
            if _UNSPACED.search(text):
                for i, x in enumerate(cut):
                    cut[i], characters = _UNSPACED.subn(r" \g<0> ", x)
                    unspaced.append((len(lengths) + i, characters))
            cut = [x.encode("utf-8", "surrogatepass") for x in cut]
            parts += cut
            lengths += map(len, cut)
        text = np.frombuffer(b"".join(parts).lower(), np.uint8)
        lengths = np.array(lengths, np.int64)
        begin = np.cumsum(lengths) - lengths
        black = _VALUE[text] > 0
        start = black.copy()
        start[1:] &= ~black[:-1]
        start[begin] = black[begin]
        starts = np.flatnonzero(start)
        self.hashes = word_hashes(text, starts)
        self.words = np.searchsorted(starts, np.append(begin, len(text)))
        n = np.diff(self.words)
        self.sizes = n.copy()
        for i, characters in unspaced:
            self.sizes[i] -= characters // 2
        self.total = np.concatenate([[0], np.cumsum(self.sizes)])
        full = n > 0
        place = np.arange(len(self.hashes)) - np.repeat(self.words[:-1], n)
        digests = np.zeros(len(n), np.uint64)
        if full.any():
            sums = np.add.reduceat(words.mix(self.hashes + (place + 1).astype(np.uint64) * np.uint64(_BASE)), self.words[:-1][full])
            digests[full] = words.mix(sums + n[full].astype(np.uint64))
        self.keys = digests.astype(np.int64) & ~3 | PARAGRAPH
        self._rank = np.concatenate([[0], np.cumsum(full)])
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digests * _powers(_BASE, len(n))[self._rank[:-1]], dtype=np.uint64)])
        self._back = _powers(pow(_BASE, -1, 1 << 64), len(n))

    def classes(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Keys of the classes of equal paragraphs or runs, from the digests of their paragraphs with words."""
        runs = words.mix((self._sums[end] - self._sums[first]) * self._back[self._rank[first]])
        single = end - first == 1
        keys = runs.astype(np.int64) & ~3 | RUN
        keys[single] = self.keys[first[single]]
        return keys


def _names(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    for bad in np.flatnonzero((places >> POSITION_BITS != 0) | (np.abs(ids) >> (63 - POSITION_BITS) != 0))[:1]:
        _name(int(ids[bad]), int(places[bad]))
    return (ids << POSITION_BITS) + places


def _post(k: int, bands: int, min_words: int):
    """Postings: the name of each paragraph and run under the key of its class, and each class of paragraphs under the
    keys of its bands, once for as long as the task remembers it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, posted = words.multipliers(bands * ROWS, seed=29), set()
        for batch in words.slices(batches):
            if len(posted) > POSTED:
                posted.clear()
            texts = [x or "" for x in batch.column(1).to_pylist()]
            spans = [paragraphs(x) for x in texts]
            read, at, found, counts = Read(texts, spans), 0, [], []
            sizes = read.sizes.tolist()
            for own in spans:
                found.append(pieces(sizes[at:at + len(own)], min_words))
                at += len(own)
            counts = np.array([len(x) for x in found], np.int64)
            first, end, number = np.fromiter(chain.from_iterable(chain.from_iterable(found)), np.int64, 3 * int(counts.sum())).reshape(-1, 3).T
            if not len(first):
                continue
            before = np.cumsum([0, *map(len, spans)])[:-1]
            first, end = first + np.repeat(before, counts), end + np.repeat(before, counts)
            keys, names = read.classes(first, end), _names(np.repeat(batch.column(0).to_numpy(), counts), number)
            single = np.flatnonzero(end - first == 1)
            classes, at = np.unique(keys[single], return_index=True)
            new = np.fromiter((x not in posted for x in classes.tolist()), bool, len(classes))
            classes, at = classes[new], first[single[at[new]]]
            posted.update(classes.tolist())
            own = read.words[at], read.words[at + 1]
            values, starts = words.flat_shingles(read.hashes[_between(*own)], own[1] - own[0], k)
            banded = words.band_keys(words.min_hashes(values, starts, factors), bands).ravel() & ~np.uint64(3) | np.uint64(BAND)
            yield buckets.packed(np.concatenate([keys, banded.astype(np.int64)]), np.concatenate([names, np.repeat(classes, bands)]))

    return run


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Of which buckets the first member is wanted: of the classes of paragraphs."""
    return keys & 3 == PARAGRAPH


def _fetch():
    schema = pa.schema([("id", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            asked = zip(*(x.to_pylist() for x in batch.column(1).flatten().flatten()))
            keys, found = [], []
            for text, k in zip(batch.column(0).to_pylist(), batch.column(1).value_lengths().to_pylist()):
                spans = paragraphs(text)
                for position, key in islice(asked, k):
                    if position < len(spans):
                        keys.append(key)
                        found.append(text[slice(*spans[position])])
            read = Read(found, [[(0, len(x))] for x in found])
            same = np.flatnonzero((read.keys == np.array(keys, np.int64)) & (np.diff(read.words) > 0)).tolist()  # else of another text with the doc_id
            yield words.batch_of(schema, [keys[i] for i in same], [b" ".join(words_of(found[i])[0]) for i in same])

    return run


def _set(text: bytes, k: int) -> set:
    w = text.split()
    return set(zip(*(w[j:] for j in range(k))))


def _alike(one: set, two: set, percent: int) -> bool:
    both = len(one & two)
    return 100 * both >= percent * (len(one) + len(two) - both)


def _tile(k: int, percent: int):
    def link_tile(key: int, table: pa.Table):
        texts, sets = table.column("words").to_pylist(), {}

        def set_of(x: int) -> set:
            if x not in sets:
                sets[x] = _set(texts[x], k)
            return sets[x]

        return lambda x, y: ((z, lambda: _alike(set_of(x), set_of(z), percent)) for z in y.tolist())

    return link_tile


def _similar(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keep.append(x == y or _alike(_set(x, k), _set(y, k), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _side(table: DataFrame, end: str) -> DataFrame:
    return table.select(F.col("id").alias(end), F.col("words").alias(f"words_{end}"))


def repeated_paragraphs(docs: DataFrame, k: int = 5, percent: int = 80, recall: float = RECALL, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, name, component) of every paragraph or run that is similar to another one, the first of a component
    included; key is its class, a name holds the doc_id and, in its lowest 24 bits, its number in ``pieces``.  Names in
    rows that repeat a doc_id may come again."""
    bands = tuned_bands(percent, recall)
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = land(buckets.packed_edges(docs.mapInArrow(_post(k, bands, min_words), buckets.PACKED_TYPE), _firsts))
    kind = F.col("key").bitwiseAND(3)
    edges = found.where(kind == BAND)
    firsts = found.where((kind == PARAGRAPH) & F.col("b").isNull()).select(F.col("key").alias("id"), F.col("a").alias("name"))
    needed = land(firsts.join(edges.select(F.explode(F.array("a", "b")).alias("id")), "id", "left_semi"))
    wanted = (needed
              .groupBy(_doc_of("name").alias("doc_id")).agg(F.collect_list(F.struct(_place_of("name").alias("position"), "id")).alias("wanted")))
    fetched = land(docs.join(wanted, "doc_id").select("text", "wanted").mapInArrow(_fetch(), "id long, words binary").dropDuplicates(["id"]))

    def links_among(pairs: DataFrame) -> DataFrame:
        return pairs.join(_side(fetched, "a"), "a").join(_side(fetched, "b"), "b").select("a", "b", "words_a", "words_b") \
            .mapInArrow(_similar(k, percent), "a long, b long")

    label = buckets.linked_components(edges, links_among, lambda ids: fetched.join(ids, "id"), _tile(k, percent)) \
        .select(F.col("id").alias("key"), F.col("component").alias("whole"))
    copies = found.where((kind != BAND) & F.col("b").isNotNull())  # every member but the class's first is a b, the first an a
    linked = needed.select("id", "name").join(label.select(F.col("key").alias("id")), "id", "left_semi")
    classes = land(copies.select("key", "a").union(linked).groupBy("key").agg(F.min("a").alias("first")).join(label, "key", "left")
                   .select("key", "first", F.coalesce("whole", "key").alias("whole")))
    first = classes.groupBy("whole").agg(F.min("first").alias("component"))
    classes_of = land(classes.join(first, "whole").select("key", "first", "component"))
    out = land(copies.select("key", F.col("b").alias("name")).join(classes_of.select("key", "component"), "key").union(classes_of))
    release(found, needed, fetched, classes, classes_of)
    return out


def _doc_of(name: str):
    return F.shiftright(name, POSITION_BITS)


def _place_of(name: str):
    return F.col(name).bitwiseAND((1 << POSITION_BITS) - 1).cast("int")


def _covered(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` are from a first to its end."""
    some = end > first
    return np.cumsum(np.bincount(first[some], minlength=n + 1) - np.bincount(end[some], minlength=n + 1))[:n] > 0


def _gone(read: Read, begin: np.ndarray, counts: np.ndarray, key: np.ndarray, number: np.ndarray, stays: np.ndarray, min_words: int) -> np.ndarray:
    """Which paragraphs go.  ``begin`` has the first paragraph of each text and the end, ``counts`` the wanted ones of each
    text, with key, number and, of a component that stays in this text, the number that stays, or -1."""
    n, low, high = len(read.sizes), np.repeat(begin[:-1], counts), np.repeat(begin[1:], counts)

    def places(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, end = runs_at(numbers, read.total, low, high, min_words)
        at = low + numbers
        single, known = key & 3 != RUN, at < high
        return np.where(single, np.where(known, at, 0), first), np.where(single, np.where(known, at + 1, 0), end)

    if not n:
        return np.zeros(0, bool)
    first, end = places(number)
    same = (end > first) & (read.classes(first, end) == key)  # else of another text with the doc_id
    a, b = places(np.maximum(stays, 0))
    there = (stays >= 0) & (b > a)
    a, b = np.where(there, a, end), np.where(there, b, end)  # may overlap
    gone = _covered(n, np.concatenate([first[same], np.maximum(first, b)[same]]), np.concatenate([np.minimum(end, a)[same], end[same]]))
    long = np.flatnonzero(read.sizes >= min_words)
    text = np.searchsorted(begin, long, "right")
    p, q = long[:-1], long[1:]
    both = gone[p] & gone[q] & (text[:-1] == text[1:])
    return gone | _covered(n, p[both], q[both])


def _cut(min_words: int):
    schema = pa.schema([("row", pa.int64()), ("n_paragraphs", pa.int32()), ("n_removed", pa.int32()),
                        ("removed", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            key, number, stays = batch.column(2).flatten().flatten()
            counts = batch.column(2).value_lengths().fill_null(0).to_numpy()
            texts = batch.column(1).to_pylist()
            spans = [paragraphs(x) for x in texts]
            removed, starts, lengths = np.zeros(len(texts), np.int32), [], []
            some = np.flatnonzero(counts)
            begin = np.cumsum([0, *(len(spans[i]) for i in some.tolist())])
            read = Read([texts[i] or "" for i in some.tolist()], [spans[i] for i in some.tolist()])
            gone = _gone(read, begin, counts[some], key.to_numpy(), number.to_numpy().astype(np.int64), stays.fill_null(-1).to_numpy().astype(np.int64), min_words)
            for i, p, q in zip(some.tolist(), begin.tolist(), begin[1:].tolist()):
                text, keep, after = texts[i] or "", [], 0
                own = np.flatnonzero(gone[p:q]).tolist()
                for x in own:
                    start, end = spans[i][x]
                    starts.append(start)
                    lengths.append(end - start)
                    keep.append(text[after:start])
                    after = end
                texts[i] = "".join([*keep, text[after:]])
                removed[i] = len(own)
            ends = np.concatenate([[0], np.cumsum(removed)])
            gone = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())], fields=list(schema.field("removed").type.value_type))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in spans], pa.int32()), pa.array(removed),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), gone, type=schema.field("removed").type), pa.array(texts, pa.string())], schema=schema)

    return run


FOUND = ["n_paragraphs", "n_removed", "removed", "removed_of", "shares_with"]


def _cut_rows(docs: DataFrame, **how) -> DataFrame:
    """_row (all columns but the text), the text that stays, and the columns ``FOUND``."""
    min_words = how.get("min_words", MIN_WORDS)
    label = repeated_paragraphs(docs, **how)
    removed = F.col("name") != F.col("component")
    per_doc = label.groupBy(_doc_of("name").alias("_doc")).agg(
        F.collect_list(F.when(removed, F.struct("key", _place_of("name").alias("number"), F.when(_doc_of("name") == _doc_of("component"), _place_of("component")).alias("stays")))).alias("_positions"),
        F.array_sort(F.collect_set(F.when(removed, _doc_of("component")))).alias("removed_of"),
        F.array_sort(F.collect_set(_doc_of("component"))).alias("shares_with"))
    rows = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("_row"), F.col("doc_id").cast("long").alias("_id"), "text")
    none = F.array().cast("array<bigint>")
    joined = rows.join(per_doc, F.col("_id") == F.col("_doc"), "left").select(
        F.struct("_row", F.coalesce("removed_of", none).alias("removed_of"), F.coalesce("shares_with", none).alias("shares_with")).alias("_rest"), "text", "_positions")
    kind = joined.schema["_rest"].dataType.simpleString()
    return joined.mapInArrow(_carry(_cut(min_words)), f"_rest {kind}, n_paragraphs int, n_removed int, removed array<struct<start:int,length:int>>, text string") \
        .select("_rest._row", "text", "n_paragraphs", "n_removed", "removed", "_rest.removed_of", "_rest.shares_with")


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the text that stays, and n_paragraphs, n_removed, removed (start and length of each removed
    paragraph in code points), removed_of (doc_ids whose paragraphs stay in their place) and shares_with
    (doc_ids of the first paragraphs of all components that the document has part in); these take the place of
    columns of the same names."""
    return _cut_rows(docs, **how).select(*(F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c not in FOUND), *FOUND)


def _carry(cut):
    """Run ``cut`` on (row, text, positions) and put the first column of the input back in the row's place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            if batch.num_rows:
                rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(1), batch.column(2)], ["row", "text", "positions"])
                done = pa.Table.from_batches(list(cut(iter([rows]))))
                for part in done.add_column(0, "_rest", batch.column(0)).drop_columns(["row"]).combine_chunks().to_batches():
                    yield part

    return run


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = without_repeats(docs)
    return cut.select("doc_id", "n_paragraphs", "n_removed", "removed", "removed_of", "shares_with",
                      F.length("text").cast("long").alias("n_chars_left"), F.col("text").alias("text_left"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without paragraphs that repeat earlier ones; a document of which nothing is left goes."""
    cut = _cut_rows(docs).where("n_removed = 0 OR trim(text) <> ''")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES: dict[str, str] = {}
