"""Mixing, packing, fingerprints and language ID: contracts, brute force and defined cases."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marketframe.llm import op04_source_mix as op4
from marketframe.llm import op05_retrieval_packing as op5
from marketframe.llm import op08_weighted_fingerprint as op8
from marketframe.llm import op10_language_id as op10

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, words string, score string, shard int, _size string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "w", "s", 1, "z") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "one two three", "en", "b"), (2, None, "en", "a"), (3, "", None, None), (4, "\t \n", "fr", "a"), (5, "x " * 20000, "en", "a"),
            (6, "dup row", "de", "c"), (6, "dup row", "de", "c"), (6, "other text", "de", "c"), (None, "no id here", "en", "b"), (None, None, None, None),
            (9, "été déjà", "fr", None), (10, "12 34 !!", "en", "é")]
    return rows, table(spark, rows)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_targets():
    assert op4.target_sizes([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert op4.target_sizes([1, 100, 100], [1, 2, 3])[1] == pytest.approx(79.2)
    assert op4.target_sizes([100, 1, 1], [1, 2, 3]) == [96, 3, 3]
    assert op4.target_sizes([0, 0], [1, 2]) == [0, 0] and op4.target_sizes([], []) == []


def test_tree_deals_every_draw_once():
    quotas = np.array([500, 3, 0, 77])
    source = np.repeat(np.arange(4), quotas)
    rank = np.concatenate([np.arange(q) for q in quotas])
    shard = op4.leaves(source, rank, quotas, 13, 1)
    sizes = np.bincount(shard, minlength=13)
    assert sizes.max() - sizes.min() <= 1 and sizes.sum() == 580
    part = op4.leaves(source[100:300], rank[100:300], quotas, 13, 1)
    assert (part == shard[100:300]).all()
    for s in range(4):
        assert (np.diff(shard[source == s]) >= 0).all()
    for n in (1, 2, 7, 360):
        factor, shift = op4._factor(n, np.random.default_rng(n))
        assert sorted(op4.permuted(np.arange(n), np.int64(n), factor, shift).tolist()) == list(range(n))


def test_mix_meets_targets(spark):
    one, two = (op4.op4_source_mix(spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)
    assert one.astype(str).equals(two.astype(str)) and len(one) == len(docs)
    assert [len(s) for s in one.shards] == [len(s) for s in one.places] and ((one.taken > 0) == (one.shards.map(len) > 0)).all()
    assert one["size"].tolist() == [len(words_of(t)) for t in docs.text] and (one.taken <= 3 * one["size"]).all()
    by = one.groupby(docs.source.fillna("~")).agg({"size": "sum", "source_size": "max", "target": "max", "taken": "sum"})
    assert (by["size"] == by.source_size).all() and (abs(by.taken - by.target) <= 1).all()
    assert by.target.tolist() == pytest.approx(op4.target_sizes(by["size"].tolist(), [1 + i % 3 for i in range(len(by))]))


def test_takes_stand_in_the_shards_that_the_tree_gives(spark, monkeypatch):
    """With small blocks and shards, against the leaves of a tree walked here."""
    plan = op4.Plan
    monkeypatch.setattr(op4, "Plan", lambda rows: plan(rows, block_words=50, shard_words=4000))
    df = op4.op4_source_mix(spark, SMALL)
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.size): r for r in df.collect()}
    rows = op4.sized(spark.read.parquet(f"{SMALL}/documents.parquet"))
    p = plan(rows, block_words=50, shard_words=4000)
    seen = set()
    for r in op4.positioned(rows, p).where("_size > 0").collect():
        whole, part = p.passes[r._source], p.rest[r._source] > r._start
        want = []
        for turn in range(whole + part):
            n, (factor, shift) = (p.blocks, p.whole[r._source]) if turn < whole else (p.last, p.part[r._source])
            rank = turn * p.blocks[r._source] + (r._start // 50 * factor + shift) % n[r._source]
            want += op4.leaves(np.array([r._source]), np.array([rank]), p.quotas, p.shards, p.seed).tolist()
        assert got[r.doc_id, r._size].shards == want
        seen |= set(want)
    assert p.shards > 5 and seen == set(range(p.shards))


def test_mix_of_odd_rows(spark, folder, odd):
    rows, df = odd
    got = op4.op4_source_mix(spark, folder(documents=df)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and got[got["size"] == 0].taken.sum() == 0
    mixed = op4.stage(spark, df, "")
    assert mixed.columns == df.columns
    out = mixed.collect()
    assert sum(len(words_of(r.text)) for r in out) == got.taken.sum()
    texts = {(i, t) for i, t, *_ in rows}
    assert all((r.doc_id, r.text) in texts or any(i == r.doc_id and words_of(t)[:len(words_of(r.text))] == words_of(r.text) for i, t in texts) for r in out)
    empty = df.limit(0)
    assert op4.stage(spark, empty, "").count() == 0 and op4.op4_source_mix(spark, folder(documents=empty)).count() == 0


def check_pieces(pieces, docs):
    from tokenizers import Tokenizer
    encode = Tokenizer.from_file(op5.tokenizer_path()).encode
    wanted = collections.Counter()
    for i, t in docs:
        wanted[(i, tuple(encode(t or "", add_special_tokens=False).ids + [1]))] += 1
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for found in by_sequence.values():
        found.sort(key=lambda p: p.offset)
        total = 0
        for p in found:
            assert p.offset == total
            total += p.length
        assert total == 2048 or total < 2048 and total & (total - 1) == 0
    return wanted


def test_packing(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    pieces = op5.op5_retrieval_packing(spark, SMALL).collect()
    wanted = {i: ids for (i, ids) in check_pieces(pieces, docs)}
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert set(by_doc) == set(wanted)
    for i, found in by_doc.items():
        found.sort(key=lambda p: p.start)
        ids, at = np.array(wanted[i], "<u4"), 0
        for p in found:
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_packing_odd_rows_in_many_shards(spark, folder, odd):
    rows, df = odd
    pieces = op5.pack(df, shard_bytes=2000).collect()
    wanted = check_pieces(pieces, [(i, t) for i, t, *_ in rows])
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in wanted.items())
    assert op5.pack(df.limit(0)).count() == 0 and op5.op5_retrieval_packing(spark, folder(documents=df.limit(0))).count() == 0


def test_words_have_the_text_s_ids(spark):
    from tokenizers import Tokenizer
    whole, parts = Tokenizer.from_file(op5.tokenizer_path()), op5.Tokens(op5.tokenizer_path())
    texts = ["", None, "a  b\tc", "¡Hola! ÀÉÎ ×÷ ÿß Ññ", "It's we'll 'tis 12a3_4-b", "a\x00b", "x" * 500, "it's don't x'll", "é ́x", "A\x1cB \x85 c", "<|endoftext|> x<|startoftext|>y", "日本語 テキスト", "x\r\n\ny", "1234 567", "ß İI z"]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for _ in range(2):
        for text, ids in zip(texts, parts.of(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids
    assert op5.Tokens(op5.tokenizer_path())._new(["ab", "x y"])["ab"] == parts.of(["ab"])[0]


def test_neighbours_share_rare_words():
    draw = np.random.default_rng(4)
    topics = [draw.integers(100 + 50 * t, 150 + 50 * t, 60) for t in range(5)]
    docs = [np.concatenate([draw.choice(topics[d % 5], 80), draw.integers(0, 100, 40)]) for d in range(100)]
    index = op5.Index(docs)
    best = index.neighbours(7, np.arange(100) != 7)[:10]
    assert (best % 5 == 2).mean() > 0.8
    assert 7 not in index.neighbours(7, np.arange(100) != 7)


def test_an_index_of_some_documents_finds_the_same_ones_among_them():
    draw = np.random.default_rng(5)
    docs = [draw.integers(0, 60, draw.integers(1, 40)) for _ in range(50)]
    whole, part, unused = op5.Index(docs), op5.Index(docs), np.ones(50, bool)
    for seed in draw.permutation(50).tolist():
        unused[seed] = False
        if seed % 3 == 0:
            part.keep(unused)
            assert len(part.doc) < len(whole.doc)
        assert part.neighbours(seed, unused).tolist() == whole.neighbours(seed, unused).tolist()


def test_words_beyond_those_remembered(monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(op5, "CACHED", 5)
    whole, parts = Tokenizer.from_file(op5.tokenizer_path()), op5.Tokens(op5.tokenizer_path())
    for texts in (["a b, c. d' e!", "été \xd7 f"], ["", None, " a  g's b, ", "\n"], ["été h d' d'", "a b, c. d' e!"]):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in parts.of(texts)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(parts.known) == 5


def test_neighbours_of_documents_match_full_bm25():
    texts = pq.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column("text").to_pylist()
    docs = [np.frombuffer(ids, "<u4") for ids in op5.Tokens(op5.tokenizer_path()).of(texts)]
    docs = [d for d in docs if len(d)]
    counts = [collections.Counter(d.tolist()) for d in docs]
    holds = collections.Counter(t for c in counts for t in c)
    mean = sum(map(len, docs)) / len(docs)

    def score(seed, d):
        norm = op5.K1 * (1 - op5.B + op5.B * len(docs[d]) / mean)
        return sum(np.log1p((len(docs) - holds[t] + 0.5) / (holds[t] + 0.5)) * counts[d][t] * (op5.K1 + 1) / (counts[d][t] + norm) for t in counts[seed] if t in counts[d])

    index = op5.Index(docs)
    for seed in range(0, len(docs), 5):
        want = np.array([score(seed, d) for d in range(len(docs))])
        got = index.neighbours(seed, np.arange(len(docs)) != seed)
        assert set(got.tolist()) == set(np.flatnonzero(want).tolist()) - {seed}
        assert (np.diff(want[got]) <= 1e-9 * want.max()).all()


def jaccard(a, b):
    x, y = (collections.Counter(w.lower() for w in words_of(t)) for t in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_fingerprints(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in op8.op8_weighted_fingerprint(spark, SMALL).collect()}
    assert len(got) == len(docs)
    error, prints = [], collections.defaultdict(set)
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        error += [got[i].near_edited - jaccard(text, edited), got[i].near_next - jaccard(text, after)]
        prints[text].add(got[i].fingerprint)
    assert np.std(error) < 0.1 and abs(np.mean(error)) < 0.03 and max(map(len, prints.values())) == 1


def test_collision_rate(spark):
    one, two = "a a a b b c d e f g h " * 3, "a b b b c c x y z h h " * 3
    df = spark.createDataFrame([(2, one + one[:len(one) // 2]), (1, two)], "doc_id long, text string")
    text = one + one[:len(one) // 2]
    got = op8.fingerprints(df, samples=200).where("doc_id = 2").first()
    assert got.near_next == pytest.approx(jaccard(text, two), abs=0.1)


def test_fingerprints_of_odd_rows(spark, folder, odd):
    rows, df = odd
    got = op8.op8_weighted_fingerprint(spark, folder(documents=df)).collect()
    assert len(got) == len(rows) and sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t, *_ in rows)
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {"0000" * op8.SAMPLES}
    alone = op8.fingerprints(df.where("doc_id = 1")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"one two tone ").hexdigest()
    assert op8.fingerprints(df.limit(0)).count() == 0


def test_best_paths_match_all_paths():
    draw = np.random.default_rng(1)
    scores = [draw.normal(0, 3, (n, 3)).astype(np.float32) for n in (0, 1, 5, 7, 6, 2)]
    for table_, path in zip(scores, op10.best_paths(scores, 2.0)):
        def value(q):
            return sum(table_[i, s] for i, s in enumerate(q)) - 2.0 * sum(a != b for a, b in zip(q, q[1:]))
        assert len(path) == len(table_) and value(list(path)) == pytest.approx(max(map(value, itertools.product(range(3), repeat=len(table_)))), abs=1e-4)


def test_held_out_accuracy(spark):
    got = op10.op10_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.98
    assert [bool(zlib.crc32(str(i).encode()) % 3 == 1) for i in got.doc_id] == got.held_out.tolist()


def test_many_languages_and_none(spark, odd):
    table_ = np.zeros((3, 300), np.float32)
    table_[:, 290] = 50
    assert op10.best_paths([table_])[0].tolist() == [290] * 3
    df = odd[1]
    kept = op10.stage(spark, df.withColumn("lang", F.lit(None).cast("string")), "").collect()
    assert len(kept) == df.where(F.col("text").rlike("[a-zé]")).count() > 0


def test_languages_of_odd_rows(spark, folder, odd):
    rows, df = odd
    got = op10.op10_language_id(spark, folder(documents=df)).collect()
    assert len(got) == len(rows)
    for r in got:
        letters = [any(c.isalpha() for c in t or "") for i, t, *_ in rows if i == r.doc_id]
        assert (r.lang_pred != "und") in letters and 0 <= r.score <= 1 and (r.lang_pred != "und" or not r.spans)
    kept = op10.stage(spark, df, "")
    assert kept.columns == df.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t, *_ in rows)
    unlabelled = op10.op10_language_id(spark, folder(documents=df.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert op10.op10_language_id(spark, folder(documents=df.limit(0))).count() == 0


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op10.learn(docs)
    parts = [docs.where(F.col("lang") == lang).orderBy("doc_id").first().text.split()[:40] for lang in ("en", "de", "fr")]
    greek = "αβγ δε ζηθ"
    df = spark.createDataFrame([(1, " ".join(sum(parts, []))), (2, greek)], "doc_id long, text string")
    out = {r.doc_id: r for r in op10.predict(df, model).collect()}
    assert [s.lang for s in out[1].spans] == ["en", "de", "fr"] and all(abs(s.words - 40) <= 4 for s in out[1].spans)
    assert out[2].lang_pred in model.langs
