"""Language identification of mixed texts: scripts narrow the candidates, then a Viterbi path over per-word scores.

A model is learned from labelled rows: hashed character n-gram counts and the scripts of letters, per language.
A word's score for a language is its smoothed n-gram log-likelihood; only languages that use the word's script
are candidates (all of them, if none does).  The best path over the words pays ``SWITCH`` for each change of
language and labels spans.  A document's language is the one with the most letters under its spans, the score
is the share of these letters.

Bounds: about ``DOCS_PER_LANGUAGE`` labelled documents per language are learned from (chosen by a hash of their
text); the model has ``BUCKETS`` counts per language.  Every document is predicted on its whole text.

Defined cases: a null text or one without letters is ``und`` with score 0 and no spans; without any labelled
document all are ``und``; ties go to the language that comes first by code point; a row without doc_id is not
held out and not learned from; columns besides ``doc_id``, ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import words

UNKNOWN = "und"
DOCS_PER_LANGUAGE = 1500
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SMOOTH = 0.5
WEIGHT = 0.5
SWITCH = 12.0
SCRIPT_SHARE = 0.001
LONGEST = 32
CELLS = 1 << 22
_PIECE = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{LONGEST - 1}}}")

# First code points of blocks and the script each belongs to, up to the next entry.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x0800, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
]
_FIRST = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(name) for _, name in SCRIPTS])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Scripts(dict):
    """Character to the number of its script, remembered."""

    def __missing__(self, c: str) -> int:
        self[c] = value = int(_SCRIPT_OF[np.searchsorted(_FIRST, ord(c), "right") - 1])
        return value


_script = Scripts()
_LATIN = _NAMES.index("latin")


def pieces(token: str) -> list[tuple[str, int]]:
    """The runs of letters of one script in a token, lower-cased, each with its script."""
    if len(token) <= LONGEST and token.isascii() and token.isalpha():
        return [(token.lower(), _LATIN)]
    out = []
    for found in _PIECE.findall(token):
        scripts = [_script[c] for c in found]
        start = 0
        for end in range(1, len(found) + 1):
            if end == len(found) or scripts[end] != scripts[start]:
                out.append((found[start:end].lower(), scripts[start]))
                start = end
    return out


def grams(found: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, the hash buckets of the n-grams of words with their ends marked, and the number of the word that
    each belongs to, in order."""
    marked = "".join(f" {x} " for x in found)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(found)), [len(x) + 2 for x in found])
    for n in ORDERS:
        if len(codes) < n:
            continue
        last = len(codes) - n + 1
        value = np.full(last, n, np.uint64)
        for j in range(n):
            value = value * np.uint64(0x9E3779B97F4A7C15) + codes[j:j + last]
        inside = owner[:last] == owner[n - 1:]
        yield (words.mix(value[inside]) % np.uint64(BUCKETS)).astype(np.int64), owner[:last][inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
    for batch in words.slices(batches):
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen.setdefault(lang, Counter()).update(text.as_py().split())
        for lang, tokens in seen.items():
            found = [(piece, script, n) for token, n in tokens.items() for piece, script in pieces(token)]
            times = np.array([n for *_, n in found], np.float64)
            total = np.zeros(BUCKETS + len(_NAMES), np.int64)
            for buckets, owner in grams([piece for piece, *_ in found]):
                total[:BUCKETS] += np.bincount(buckets, times[owner], BUCKETS).astype(np.int64)
            for piece, script, n in found:
                total[BUCKETS + script] += n * len(piece)
            at = np.flatnonzero(total)
            yield words.batch_of(schema, [lang] * len(at), at, total[at])


class Model:
    """Log-likelihoods (bucket, language) and which languages use a script (script, language)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        n = counts[:BUCKETS].astype(np.float64)
        self.likelihood = (WEIGHT * (np.log(n + SMOOTH) - np.log(n.sum(axis=0) + SMOOTH * BUCKETS))).astype(np.float32)
        letters = counts[BUCKETS:]
        self.uses = letters > SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)

    def scores(self, found: list[tuple[str, int]]) -> np.ndarray:
        """(words, languages) scores of words and their scripts."""
        value = np.zeros((len(found), max(1, len(self.langs))), np.float32)
        for buckets, owner in grams([piece for piece, _ in found]):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(first):
                value[owner[first]] += np.add.reduceat(self.likelihood[buckets], first, axis=0)
        narrow = self.uses[[script for _, script in found]]
        narrow |= ~narrow.any(axis=1, keepdims=True)
        return np.where(narrow, value, value.min(axis=1, keepdims=True) - 50)


def learn(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """A model from rows (text, lang), of which about ``docs_per_language`` per language are used."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    counts = np.zeros((BUCKETS + len(_NAMES), max(1, len(langs))), np.int64)
    if langs:
        share = F.create_map(*(F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, docs_per_language / n))))
        chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
        for r in chosen.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["bucket"], langs.index(r["lang"])] = r["n"]
    return Model(langs, counts)


def best_paths(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best language of every word, for several sequences of (words, languages) scores."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list = [np.zeros(0, np.int16)] * len(scores)
    while order and len(scores[order[0]]):
        longest, langs = scores[order[0]].shape
        most = max(1, CELLS // (longest * langs))
        group = [i for i in order[:most] if len(scores[i])]
        order = order[most:]
        lengths = np.array([len(scores[i]) for i in group])
        table = np.zeros((longest, len(group), scores[group[0]].shape[1]), np.float32)
        for g, i in enumerate(group):
            table[:lengths[g], g] = scores[i]
        active = (lengths[None, :] > np.arange(longest)[:, None]).sum(axis=1)
        value = table[0].astype(np.float64)
        top = np.zeros((longest, len(group)), np.int16)
        moved = np.zeros(table.shape, bool)
        for t in range(1, longest):
            n = active[t]
            now = value[:n]
            best = now.argmax(axis=1)
            change = now[np.arange(n), best][:, None] - switch
            moved[t, :n] = change > now
            top[t, :n] = best
            value[:n] = np.maximum(now, change) + table[t, :n]
        state = value.argmax(axis=1)
        path = np.zeros((longest, len(group)), np.int16)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            path[t, :n] = state[:n]
            if t:
                state[:n] = np.where(moved[t, np.arange(n), state[:n]], top[t, :n], state[:n])
        for g, i in enumerate(group):
            out[i] = path[:lengths[g], g]
    return out


SPANS = "array<struct<lang:string,words:int,letters:int>>"


def _predict(model: Model, switch: float, place: int):
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([
        ("lang", pa.string()), ("words", pa.int32()), ("letters", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        scores, letters = np.zeros((0, max(1, len(model.langs))), np.float32), np.zeros(0, np.int64)
        for batch in words.slices(batches):
            tokens = [t.as_py().split() if model.langs and t.is_valid else [] for t in batch.column(0).field(place)]
            if len(known) > words.CACHED_WORDS:
                known, scores, letters = {}, scores[:0], letters[:0]
            new = set().union(*tokens).difference(known)
            found = []
            for token in new:
                own = pieces(token)
                known[token] = np.arange(len(scores) + len(found), len(scores) + len(found) + len(own), dtype=np.int32).tobytes()
                found += own
            if found:
                scores = np.concatenate([scores, model.scores(found)])
                letters = np.concatenate([letters, [len(piece) for piece, _ in found]])
            numbers = [np.frombuffer(b"".join(map(known.__getitem__, own)), np.int32) for own in tokens]
            out = []
            for own, path in zip(numbers, best_paths([scores[x] for x in numbers], switch)):
                if not len(own):
                    out.append((UNKNOWN, 0.0, []))
                    continue
                share = np.bincount(path, letters[own], len(model.langs))
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
                sums = np.add.reduceat(letters[own], cuts)
                out.append((model.langs[int(share.argmax())], float(share.max() / share.sum()),
                            [{"lang": model.langs[path[c]], "words": int(w), "letters": int(s)}
                             for c, w, s in zip(cuts, np.diff(np.append(cuts, len(path))), sums)]))
            done = words.batch_of(schema, *(zip(*out) if out else ([], [], [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *done.columns], ["row", *schema.names])

    return run


def _predicted(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """row (all columns), lang_pred, score, spans."""
    row = F.struct(*docs.columns).alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    place = [c.lower() for c in docs.columns].index("text")
    return docs.select(row).mapInArrow(_predict(model, switch, place), f"row {kind}, lang_pred string, score double, spans {SPANS}")


def predict(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``docs`` with lang_pred, score and spans, which take the place of columns of these names."""
    found = _predicted(docs, model, switch)
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score", "spans")), "lang_pred", "score", "spans")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language go on; a text without letters is rejected, also where no document is labelled."""
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return _predicted(docs, model).where(F.col("lang_pred") != UNKNOWN).select("row.*")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
