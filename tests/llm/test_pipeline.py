"""The pipeline's stages, each on its own input, against brute force."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from marketframe.llm import op02_substring_dedup as op2
from marketframe.llm import op04_source_mix as op4
from marketframe.llm import op07_near_dup as op7
from marketframe.operators.landing import land

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(land(stage(spark, out[-1], SMALL)))
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dup", "substring_dedup", "source_mix", "retrieval_packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert all(s.where("n_chars <> length(text)").count() == 0 for s in stages[2:-1])


def test_language_stage_keeps_texts_with_letters(stages):
    with_letters = {r.doc_id for r in stages[0].collect() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in stages[1].collect()} == with_letters


def test_near_dup_stage_keeps_one_of_each_group(stages):
    docs = [(r.doc_id, op7._set(r.text, 5)) for r in stages[1].orderBy("doc_id").collect()]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for n, (i, a) in enumerate(docs):
        for j, b in docs[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    assert {r.doc_id for r in stages[2].collect()} == {i for i, _ in docs if root(i) == i}


def test_substring_stage_removes_repeats_only(stages):
    seen, want = set(), {}
    for r in stages[2].orderBy("doc_id").collect():
        units = [r.text[a:b] for a, b in op2.paragraphs(r.text)]
        long = [tuple(u.lower().split()) for u in units]
        want[r.doc_id] = [u for u, w in zip(units, long) if len(w) >= op2.MIN_WORDS and not (w in seen or seen.add(w))]
    got = {r.doc_id: r.text for r in stages[3].collect()}
    for i, text in got.items():
        assert len(text) <= len(stages[2].where(f"doc_id = {i}").first().text) if i % 10 == 0 else True
    repeats = [u for i, text in got.items() for u in (tuple(text[a:b].lower().split()) for a, b in op2.paragraphs(text)) if len(u) >= op2.MIN_WORDS]
    assert len(repeats) == len(set(repeats)) and len(got) >= 0.95 * len(want)


def test_mix_stage_meets_targets(stages):
    def sizes(df):
        out = {}
        for r in df.collect():
            out[r.source] = out.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        return out
    before, after = sizes(stages[3]), sizes(stages[4])
    order = sorted(before, key=lambda s: (s is None, s or ""))
    targets = op4.target_sizes([before[s] for s in order], [1 + i % 3 for i in range(len(order))])
    assert [after.get(s, 0) for s in order] == pytest.approx(targets, abs=1)


def test_pack_stage_holds_every_document(stages):
    from tokenizers import Tokenizer

    from marketframe.llm import op05_retrieval_packing as op5
    encode = Tokenizer.from_file(op5.tokenizer_path()).encode
    total = sum(len(encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    assert stages[5].selectExpr("sum(length)").first()[0] == total


def test_run_is_the_stages_in_turn(spark, stages):
    assert corpus_pipeline.run(spark, SMALL).count() == stages[-1].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_landing_leaves_no_shuffle_files(spark):
    from marketframe.operators import landing

    def files():
        return {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",") if "/shuffle_" in x}

    before, setting = files(), spark.conf.get(landing._CLEANUP)
    out = landing.land(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    assert not files() - before and spark.conf.get(landing._CLEANUP) == setting
    assert sorted(out.collect()) == sorted(out.collect()) and out.count() == 10
