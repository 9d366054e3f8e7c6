"""Words, shingles and min-hash values as numpy arrays; runs inside tasks, on a slice of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20
CACHED_WORDS = 1 << 18


class WordHash(dict):
    """64-bit hash of a word, remembered; forgets everything when it holds ``CACHED_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(word_hashes: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of several word sequences, one after the other, and where each sequence
    starts (one more entry at the end).  A sequence of 1 to k-1 words is one shingle; an empty one has none."""
    lengths = np.array([len(h) for h in word_hashes], np.int64)
    return flat_shingles(np.concatenate([*word_hashes, np.zeros(0, np.uint64)]).astype(np.uint64), lengths, k)


def flat_shingles(flat: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of sequences that are given one after the other with their lengths."""
    counts = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(starts[-1], np.uint64)
    word_starts = np.cumsum(lengths) - lengths
    if flat.size >= k:
        rolled = np.zeros(flat.size - k + 1, np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + flat[j:flat.size - k + 1 + j]
        long = np.flatnonzero(lengths >= k)
        if long.size:
            n = counts[long]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(starts[:-1][long], n) + within] = rolled[np.repeat(word_starts[long], n) + within]
    for i in np.flatnonzero((lengths > 0) & (lengths < k)):
        value = int(lengths[i])
        for h in flat[word_starts[i]:word_starts[i] + lengths[i]].tolist():
            value = (value * 0xD6E8FEB86659FD93 + h) & 0xFFFFFFFFFFFFFFFF
        out[starts[i]] = value
    return mix(out), starts


def distinct(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each sequence, sorted, and the new starts."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[first], minlength=len(starts) - 1)
    return values[first], np.concatenate([[0], np.cumsum(counts)])


def multipliers(n: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 32, 1 << 63, n, np.uint64) | np.uint64(1)


def min_hashes(values: np.ndarray, starts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(sequences, factors) 32-bit minima; sequences must not be empty."""
    out = np.empty((len(starts) - 1, len(factors)), np.uint32)
    if len(out):
        for j, a in enumerate(factors):
            out[:, j] = np.minimum.reduceat(((values * a) >> np.uint64(32)).astype(np.uint32), starts[:-1])
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """(sequences, bands) 64-bit bucket keys."""
    rows = signatures.shape[1] // bands
    keys = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signatures), b + 1, np.uint64)
        for j in range(b * rows, (b + 1) * rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, j])
        keys[:, b] = key
    return keys


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes, or one row if that is larger."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, int(batch.num_rows * most / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
