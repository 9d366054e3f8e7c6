"""Near-duplicate operators against brute force, and their defined cases."""

import random

import numpy as np
import pytest

from marketframe.llm import buckets, words
from marketframe.llm import op02_substring_dedup as op2
from marketframe.llm import op06_embedding_dedup as op6
from marketframe.llm import op07_near_dup as op7

DOCS = "doc_id long, text string, key string, component long, n_shingles string"


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def prose(n, seed, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def edited(text, share, seed):
    draw = random.Random(seed)
    return [f"x{draw.randrange(10 ** 6)}" if draw.random() < share else w for w in text]


def family():
    """Copies of one text with more and less edits, some pairs of which link only through others."""
    base = prose(120, 1)
    return [" ".join(edited(base, 0.012 * (i % 9), i)) for i in range(60)] + [" ".join(prose(80, 100 + i)) for i in range(20)]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = family() + [None, "", " \t\n", "One", "one", "two words", "TWO  words", "a " * 30000, family()[3]]
    rows = [(i * 3, t, "k", 1, "x") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame([*rows, (3, texts[1], "k", 1, "x"), (None, texts[0], None, None, None)], DOCS)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(corpus, k):
    rows, df = corpus
    got = op7.near_duplicates(df, k=k).toPandas()
    sets = {i: op7._set(t, k) for i, t, *_ in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(ids, links)
    named = got[got.doc_id.notna()]
    assert len(got) == len(rows) + 2 and dict(zip(named.doc_id, named.component_id)) == want
    assert all(sets_n == len(sets[i]) for i, sets_n in zip(named.doc_id, named.n_shingles))
    assert (named.kept == (named.doc_id == named.component_id)).all() and got[got.doc_id.isna()].kept.all()


def test_small_tiles_find_the_same(corpus, monkeypatch):
    _, df = corpus
    want = op7.near_duplicates(df, k=2).toPandas().sort_values("doc_id").component_id.tolist()
    plain = buckets.open_links
    monkeypatch.setattr(buckets, "open_links", lambda *a: plain(*a, tile=3))
    assert op7.near_duplicates(df, k=2).toPandas().sort_values("doc_id").component_id.tolist()[:-1] == want[:-1]


def test_empty_tables(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    path = folder(documents=docs, embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert op7.op7_near_dup(spark, path).count() == 0
    assert op2.op2_substring_dedup(spark, path).count() == 0
    assert op6.op6_embedding_dedup(spark, path).count() == 0


def test_pruning_bound():
    assert op7.least_matches(192, 80, 1e-5) < 0.8 * 192
    for n in (32, 192):
        m = op7.least_matches(n, 80, 1e-5)
        draws = np.random.default_rng(0).beta(m + 1, n - m + 1, 400_000)
        assert (draws >= 0.8).mean() < 1e-3
    assert [op7.least_matches(32, 80, p) for p in (1e-2, 1e-5, 1e-9)] == sorted((op7.least_matches(32, 80, p) for p in (1e-2, 1e-5, 1e-9)), reverse=True)


def test_components_of_chains_and_stars(spark):
    draw = random.Random(5)
    names = draw.sample(range(-10 ** 12, 10 ** 12), 300)
    links = list(zip(names[:150], names[1:150])) + [(names[150], n) for n in names[151:250]] + [(names[299], names[299])]
    got = {r.id: r.component for r in buckets.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components(names, links)
    assert got == {n: want[n] for n in names[:250]}


def test_packed_postings_connect_every_bucket_in_few_rows(spark):
    draw = np.random.default_rng(11)
    keys, ids = draw.integers(-2 ** 63, 2 ** 63, 3000), draw.integers(-10 ** 9, 10 ** 9, 60_000)
    keys = np.where(draw.random(60_000) < 0.2, keys[0], keys[draw.integers(0, 3000, 60_000)])
    slices = [buckets.packed(k, i) for k, i in zip(np.array_split(keys, 6), np.array_split(ids, 6))]
    assert sum(x.num_rows for x in slices) < 15_000 and buckets.packed(keys[:0], ids[:0]).num_rows == 0
    posted = spark.createDataFrame([tuple(r.values()) for x in slices for r in x.to_pylist()], buckets.PACKED_TYPE)
    want = {}
    for k, i in zip(keys.tolist(), ids.tolist()):
        want.setdefault(k, set()).add(i)
    for batch in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = buckets.packed_edges(posted, lambda k: k % 2 == 0).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {r.key: r.a for r in got if r.b is None} == {k: min(v) for k, v in want.items() if k % 2 == 0}
        assert sum(r.b is None for r in got) == sum(k % 2 == 0 for k in want)
        edges = {}
        for r in got:
            if r.b is not None:
                edges.setdefault(r.key, []).append((r.a, r.b))
        for k, v in want.items():
            assert set(components(v, edges.get(k, [])).values()) == {min(v)}


def test_shingles_and_minima():
    cache = words.WordHash()
    texts = ["a b c d", "", "b c", "A b C d", "x"]
    values, starts = words.distinct(*words.shingles([words.hashes(words.ascii_words(t), cache) for t in texts], 2))
    parts = [set(values[a:b].tolist()) for a, b in zip(starts, starts[1:])]
    assert [len(p) for p in parts] == [3, 0, 1, 3, 1] and parts[0] == parts[3] and parts[2] < parts[0]


def paragraph(seed, n=12):
    return " ".join(prose(n, seed, 10 ** 6)).capitalize() + ". "


def test_repeated_passage_goes_and_the_rest_stays(spark):
    passage = "".join(paragraph(s) for s in range(6))
    near = passage.replace(passage.split()[-2], "changed", 1)
    rows = [(1, paragraph(50) + "\n" + passage + paragraph(51)), (2, paragraph(52) + "and then " + passage + "and on " + paragraph(53)),
            (3, near), (4, paragraph(54) * 2), (5, None), (6, ""), (7, "short. " * 3), (7, "short. " * 3), (None, passage)]
    df = spark.createDataFrame([(i, t, "x", [1], "y") for i, t in rows], "doc_id int, text string, removed string, _positions array<int>, _row string")
    got = op2.without_repeats(df)
    out = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and "_row" in got.columns
    assert out[1].text == rows[0][1] and out[1].n_removed == 0 and out[2].removed_of == [1]
    assert paragraph(53) in out[2].text and paragraph(3) not in out[2].text and out[2].text.startswith(paragraph(52))
    assert out[3].n_removed >= 5 and out[4].text == paragraph(54) and out[5].text is None and out[6].text == "" and out[7].text == "short. " * 3
    assert out[None].text == passage
    for i, t in rows:
        if out[i].removed:
            text = t
            for span in reversed(out[i].removed):
                text = text[:span["start"]] + text[span["start"] + span["length"]:]
            assert text == out[i].text
    kept = op2.stage(spark, df, "")
    assert kept.columns == df.columns and kept.count() >= len(rows) - 1


def test_bands_miss_less_than_one_link_in_ten_thousand(spark):
    bands = op2.tuned_bands(80, op2.RECALL)
    assert (1 - 0.8 ** op2.ROWS) ** bands < 1e-4
    base = [prose(12, 5000 + i, 10 ** 6) for i in range(400)]
    rows = [(i * 2 + j, " ".join(b if j else [*b, f"t{i}", f"u{i}"])) for i, b in enumerate(base) for j in (0, 1)]  # 8 of 10 shingles agree
    got = op2.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 800


def test_passages_of_short_units_go(spark):
    shout = "\n".join(f"{w.upper()}!!" for w in prose(60, 300, 10 ** 6)) + "\n"
    japanese = "".join(chr(0x3042 + random.Random(i).randrange(80)) * (i % 2 + 1) + ("。" if i % 11 == 10 else "") for i in range(220)) + "。"
    around = [paragraph(400 + i) for i in range(8)]
    edges = "Yes, yes. " + paragraph(390) + "No, never. "
    rows = [(1, around[0] + shout + around[1]), (2, around[2] + "Only here.\n" + shout + "And this.\n" + around[3]),
            (3, japanese), (4, "はじめ。" + japanese + "おわり。"), (5, around[4] + edges + around[5]), (6, around[6] + edges + around[7]),
            (7, "Ha. " * 40)]
    out = {r.doc_id: r for r in op2.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].text for i in (1, 3, 5)] == [rows[i - 1][1] for i in (1, 3, 5)]
    assert out[2].text == around[2] + "Only here.\nAnd this.\n" + around[3] and out[2].removed_of == [1]
    assert out[4].text == "はじめ。おわり。" and out[6].text == around[6] + around[7] and out[7].text == "Ha. " * 8


def test_paragraph_classes_match_brute_force(spark):
    draw = random.Random(8)
    units = [prose(12, 200 + i, 10 ** 6) for i in range(30)]
    texts = [" ".join(" ".join(edited(units[draw.randrange(30)], draw.choice([0, 0, 0.05, 0.3]), draw.random())) + "." for _ in range(6)) for _ in range(40)]
    got = {r.name: r.component for r in op2.repeated_paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), recall=0.9999).collect()}
    sets = {}
    for i, t in enumerate(texts):
        for p, (s, e) in enumerate(op2.paragraphs(t)):
            sets[op2._name(i, p)] = op2._set(b" ".join(words.ascii_words(t[s:e])), 5)
    names = sorted(sets)
    links = [(a, b) for a in names for b in names if a < b and op2._alike(sets[a], sets[b], 80)]
    want = components(names, links)
    linked = {x for pair in links for x in pair}
    assert got == {n: want[n] for n in linked}


def test_embeddings_match_all_pairs(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(40, 64))
    near = [c + draw.normal(size=64) * s for c in centres for s in (0, 0.05, 0.1, 0.15, 0.2, 0.25)] * 2 + list(draw.normal(size=(200, 64)))
    rows = [(i, v.astype(np.float32).tolist(), i % 2, "x") for i, v in enumerate(near)]
    hot = [(10_000 + i, rows[0][1], 0, "x") for i in range(700)] + [(20_000 + i, (centres[1] + draw.normal(size=64) * 0.1).tolist(), 0, "x") for i in range(600)]
    odd = [(-1, None, 0, ""), (-2, [], 0, ""), (-3, [0.0] * 64, 0, ""), (-4, [float("nan")] + [1.0] * 63, 0, ""), (-5, [None] + [1.0] * 63, 0, ""),
           (-6, rows[0][1], None, ""), (-7, rows[0][1][:10], 0, ""), (-8, [float("inf")] * 64, 0, "")]
    df = spark.createDataFrame(rows + hot + odd, "vec_id long, embedding array<float>, label int, links string")
    got = op6.near_vectors(df).toPandas().set_index("vec_id")
    every = rows + hot
    table = np.array([r[1] for r in every], np.float32).astype(np.float64)
    unit = table / np.linalg.norm(table, axis=1, keepdims=True)
    label = np.array([r[2] for r in every])
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    ids = [r[0] for r in every]
    found = got.loc[ids].n_links.to_numpy()
    assert (found <= linked.sum(axis=1)).all() and found.sum() >= 0.99 * linked.sum()
    want = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(linked)))])
    assert (got.loc[ids].component_id == [want[i] for i in ids]).mean() > 0.99
    assert (got.loc[[r[0] for r in odd]].n_links == 0).all() and (got.loc[[r[0] for r in odd]].kept).all()


def test_finite_vectors_of_any_size_link_by_their_direction(spark):
    draw = np.random.default_rng(3)
    one, two = draw.normal(size=(2, 16))
    sizes = [1.0, 1e-200, 1e200]
    rows = [(i, (one * s).tolist(), 1) for i, s in enumerate(sizes)] + [(10 + i, (two * s).tolist(), 1) for i, s in enumerate([1.0, 1e-200, 1.7e308 / np.abs(two).max()])]
    rows += [(20, [5e-324] + [0.0] * 15, 1), (21, [1e300] + [0.0] * 15, 1)]
    got = {r.vec_id: r.component_id for r in op6.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20}


def test_recall_on_the_table(spark):
    path = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    got = op6.op6_embedding_dedup(spark, path).toPandas().set_index("vec_id").loc[df.vec_id]
    table = np.array(df.embedding.tolist(), np.float64)
    unit = table / np.linalg.norm(table, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (df.label.to_numpy()[:, None] == df.label.to_numpy()[None, :])
    np.fill_diagonal(linked, False)
    assert (got.n_links.to_numpy() <= linked.sum(axis=1)).all() and got.n_links.sum() >= 0.99 * linked.sum()


def test_runs_are_found_again_by_their_number():
    draw = random.Random(3)
    for _ in range(300):
        sizes = [draw.choice([0, 0, 1, 2, 3, 5, 7, 8, 12]) for _ in range(draw.randrange(20))]
        n, total = len(sizes), np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
        ahead = {(i, min((e for e in range(i, n + 1) if total[e] >= total[i] + 8), default=None)) for i in range(n) if sizes[i]}
        back = {(max((s for s in range(i + 1) if total[i + 1] - total[s] >= 8), default=None), i + 1) for i in range(n) if sizes[i]}
        got = op2.pieces(sizes, 8)
        assert sorted((a, b) for a, b, _ in got) == sorted(p for p in ahead | back if None not in p)
        assert all(op2.run_at(number, sizes.__getitem__, n, 8) == (a, b) for a, b, number in got if b - a > 1)
        assert len({(b - a > 1, number) for a, b, number in got}) == len(got)


def test_many_runs_are_found_as_one_by_one():
    draw = random.Random(4)
    texts = [[draw.choice([0, 0, 1, 2, 3, 5, 7, 8, 12]) for _ in range(draw.randrange(12))] for _ in range(200)]
    asked = [(i, number) for i, sizes in enumerate(texts) for number in range(2 * len(sizes) + 3)]
    begin = np.cumsum([0, *map(len, texts)])
    low, high = np.array([[begin[i], begin[i + 1]] for i, _ in asked]).T
    first, end = op2.runs_at(np.array([number for _, number in asked]), np.cumsum([0, *sum(texts, [])]), low, high, 8)
    want = [op2.run_at(number, texts[i].__getitem__, len(texts[i]), 8) for i, number in asked]
    assert [(a - at, b - at) if b > a else None for a, b, at in zip(first.tolist(), end.tolist(), low.tolist())] == want


def test_classes_of_paragraphs_and_runs_are_those_of_their_words(monkeypatch):
    draw = random.Random(6)
    unit = lambda: "".join(draw.choice(["a", "B", "b", "é", "あ", " ", "\t", "\xa0", "\x1c", "。", ". ", "!\n", "."]) for _ in range(draw.randrange(1, 9)))
    texts = ["".join(unit() for _ in range(draw.randrange(40))) for _ in range(300)] + ["", " \n\n ", "x" * 300, "\udcff. \udcff"]
    spans = [op2.paragraphs(t) for t in texts]
    read = op2.Read(texts, spans)
    own = [op2.words_of(t[s:e]) for t, cut in zip(texts, spans) for s, e in cut]
    assert read.sizes.tolist() == [size for _, size in own] and np.diff(read.words).tolist() == [len(found) for found, _ in own]
    at, ranges = 0, []
    for cut in spans:
        ranges += [(i, j) for i in range(at, at + len(cut)) for j in range(i + 1, min(i + 5, at + len(cut) + 1))]
        at += len(cut)
    said = [(j - i == 1, tuple(tuple(found) for found, _ in own[i:j] if found)) for i, j in ranges]
    keys = read.classes(*np.array(ranges).T).tolist()
    assert len(set(keys)) == len(set(said)) == len(set(zip(keys, said))) < len(said)
    monkeypatch.setattr(op2, "CHUNK", 7)
    assert op2.Read(texts, spans).keys.tolist() == read.keys.tolist()


def test_versions_of_a_document_and_copies_in_one_text(spark):
    one, two, three = (paragraph(s) for s in (701, 702, 703))
    rows = [(1, one + two), (1, three), (1, two + three + one), (2, one + three), (3, two + "Hm. " + two + three + "Oh. " + one)]
    out = {(r.doc_id, r.n_paragraphs): r.text for r in op2.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == len(rows) and out[2, 2] == "" and "Hm." not in out[3, 6] and two not in out[3, 6]
    assert out[1, 2].startswith(one) and out[1, 1] == three
