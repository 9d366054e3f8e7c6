"""URL filter: rules, unigram Viterbi segmentation of host names, and multinomial naive Bayes over the words.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest rule
wins.  Other urls are judged by naive Bayes over the words of host and path.  Host names run words together, so
each label between dots and hyphens is split into the words that make it most likely under a unigram model.  The model's
counts come from all words of the pages' texts and from the classifier's own vocabulary; only the substrings of
host labels that are words are ever looked up, by a join, so that neither table is gathered.

The classifier learns from the table: every url that a rule allows or blocks is a labelled url, and the words of all of them are
counted in one aggregate.  ``SEED_URLS``, a fixed list of urls made of ``SEED_WORDS``, are labelled urls beside them, for words
and tables without any; so is a prior of ``PRIOR`` blocked urls, which weighs as much as ``PRIOR_URLS`` urls.  The table
of log odds is joined to the words of each distinct url, salted because some words stand in most urls, and never
gathered.  Words without a label say nothing.

A word that is cut out of a label has at most ``LONGEST_WORD`` characters, and longer words of the pages are not counted: a longer
stretch is an unknown one.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule, and the prior's verdict; so has an url without known words;
labels of over 63 characters, which no host name has, stay whole; repeated urls each get a row; columns besides
``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import words
from marketframe.operators.landing import land

LONGEST_LABEL = 63
LONGEST_WORD = 24
PRIOR = 0.2
PRIOR_URLS = 100
SALTS = 16
SMOOTH = 0.05
SEED_COUNT = 1000

# The rules of the query, and words of urls that are to be blocked or allowed.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
SEED_WORDS = {
    "block": """adult xxx porn sex sexy nude escort cam casino casinos poker slots slot bet bets betting gamble gambling jackpot lottery roulette
        win winner prize pills pill viagra cialis pharma pharmacy drugs cheap replica loan loans payday credit crypto forex spam farm seo
        backlinks ads ad track tracker tracking click clicks popup banner doubleclick malware phishing crack cracked warez keygen torrent hack
        free miracle diet weightloss dating singles hookup""".split(),
    "allow": """news blog wiki docs article articles library school university research science history book books journal magazine weather
        travel guide recipes recipe music art museum health garden sport sports city government home about help support forum community
        learning teaching culture politics world science technology software data open project press archive report story stories kitchen""".split(),
}


def training_urls() -> list[tuple[list[str], str]]:
    """Labelled urls, as words: each seed word with two others of its kind."""
    out = []
    for verdict, found in SEED_WORDS.items():
        found = list(dict.fromkeys(found))
        out += [([w, found[(i + 7) % len(found)], found[(i + 19) % len(found)]], verdict) for i, w in enumerate(found)]
    return out


SEED_URLS = training_urls()


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels(host: Column) -> Column:
    return F.filter(F.split(host, "[.-]"), lambda x: x != "")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all words in the text between the tags of ``texts`` (html)."""
    bare = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "(?s)<[^>]*>", " "))
    return texts.select(F.explode(F.split(bare, r"[^\p{L}\p{N}]+")).alias("word")).where(f"word <> '' AND length(word) <= {LONGEST_WORD}") \
        .groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """The unigram counts: all words of the texts, and the classifier's words as if seen ``SEED_COUNT`` times."""
    seeds = texts.sparkSession.createDataFrame([(w, SEED_COUNT) for w in sorted({w for ws in SEED_WORDS.values() for w in ws})], "word string, n long")
    return word_counts(texts).union(seeds).groupBy("word").agg(F.sum("n").alias("n"))


def best_split(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely words of a label (Viterbi).  An unknown stretch costs as much as a word seen 10 / total times
    with a tenth of that for every further character."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(label[start:end])
            score = log(n / total) if n else log(10 / total) - (end - start) * log(10)
            options.append((best[start][0] + score, start))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    out, end = [], len(label)
    while end:
        start = best[end][1]
        out.append(label[start:end])
        end = start
    return out[::-1]


def _segment(total: int):
    schema = pa.schema([("label", pa.string()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            found = batch.column(0).to_pylist()
            known = [{x["word"]: x["n"] for x in row} for row in batch.column(1).to_pylist()]
            yield words.batch_of(schema, found, [best_split(x, k, total) if len(x) <= LONGEST_LABEL else [x] for x, k in zip(found, known)])

    return run


def segmented(hosts: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(host, words) of distinct ``hosts`` (host): each label of each host split into words."""
    unigrams = land(unigrams)
    total = unigrams.agg(F.sum("n")).first()[0] or 1
    parts = land(hosts.select("host", F.posexplode(labels(F.col("host"))).alias("place", "label")))
    distinct = parts.select("label").distinct()
    cut = (distinct.where(F.length("label") <= LONGEST_LABEL)
           .withColumn("start", F.explode(F.expr("sequence(1, length(label))")))
           .withColumn("size", F.explode(F.expr(f"sequence(1, least({LONGEST_WORD}, length(label) - start + 1))")))
           .select("label", F.expr("substr(label, start, size)").alias("word")).distinct())
    known = cut.join(unigrams, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    rows = distinct.join(known, "label", "left").select("label", F.coalesce("known", F.expr("CAST(array() AS array<struct<word:string,n:bigint>>)")).alias("known"))
    split = rows.mapInArrow(_segment(total), "label string, words array<string>")
    return parts.join(split, "label").groupBy("host").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"])).alias("words"))


READ_SCHEMA = "host string, path string, n long, rule string, ruled string, words array<string>"


def _read(rules: list[tuple[str, str, str]]):
    """Each distinct url with the longest rule that fits, its verdict, and the words of host and path."""
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("n", pa.int64()), ("rule", pa.string()), ("ruled", pa.string()),
                        ("words", pa.list_(pa.string()))])
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))

    def rule_of(host: str, path: str) -> tuple[str | None, str | None]:
        best = (None, None)
        suffix = host
        while suffix:
            for start, verdict in by_host.get(suffix, ()):
                if path.startswith(start) and len(suffix + start) > len(best[0] or ""):
                    best = (suffix + start, verdict)
            _, _, suffix = suffix.partition(".")
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            out = [(host, path, n, *rule_of(host, path), [*(found or []), *re.findall(r"[^\W\d_]+", path.lower())])
                   for host, path, n, found in zip(*(c.to_pylist() for c in batch.columns))]
            yield words.batch_of(schema, *(zip(*out) if out else [[]] * 6))

    return run


def labelled_counts(read: DataFrame, seeds: list[tuple[list[str], str]]) -> DataFrame:
    """(word, block, allow): how often each word stands in the labelled urls of ``read`` (words, ruled, n), and in the seeds."""
    more = Counter((w, verdict) for found, verdict in seeds for w in found)
    more = read.sparkSession.createDataFrame([(w, v, n) for (w, v), n in sorted(more.items())], "word string, ruled string, n long")
    seen = read.where("ruled IS NOT NULL").select(F.explode("words").alias("word"), "ruled", "n").union(more)
    return seen.groupBy("word").agg(*[F.sum(F.when(F.col("ruled") == v, F.col("n")).otherwise(0)).alias(v) for v in ("block", "allow")])


def log_odds(read: DataFrame, seeds: list[tuple[list[str], str]], prior: float) -> tuple[DataFrame, float]:
    """(word, odds) of block to allow by multinomial naive Bayes, and the log odds of the shares of both kinds of urls."""
    counts = land(labelled_counts(read, seeds))
    size = counts.agg(F.count("*").alias("known"), F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    urls = read.agg(*[F.coalesce(F.sum(F.when(F.col("ruled") == v, F.col("n"))), F.lit(0)).alias(v) for v in ("block", "allow")]).first()
    share = {v: log((size[v] or 0) + SMOOTH * (size["known"] or 1)) for v in ("block", "allow")}
    odds = F.log(F.col("block") + SMOOTH) - F.log(F.col("allow") + SMOOTH) - F.lit(share["block"] - share["allow"])
    return counts.select("word", odds.alias("odds")), log((urls["block"] + prior * PRIOR_URLS) / (urls["allow"] + (1 - prior) * PRIOR_URLS))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, seeds: list[tuple[list[str], str]] | None = None,
           prior: float = PRIOR) -> DataFrame:
    """page_id, host, path, rule, verdict, words and log_odds of every row of ``pages`` (page_id, url, html)."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    distinct = land(urls.groupBy("host", "path").agg(F.count("*").alias("n")))
    split = land(segmented(distinct.select("host").where("host <> ''").distinct(), vocabulary(pages)))
    read = land(distinct.join(split, "host", "left").select("host", "path", "n", "words").mapInArrow(_read(RULES if rules is None else rules), READ_SCHEMA))
    odds, base = log_odds(read, SEED_URLS if seeds is None else seeds, prior)
    odds = odds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tokens = read.select("host", "path", F.explode("words").alias("word")).withColumn("salt", F.pmod(F.hash("host", "path"), F.lit(SALTS)))
    scores = tokens.join(odds, ["word", "salt"]).groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    # rounded, so that the order of a sum decides nothing
    score = F.round(F.lit(base) + F.coalesce("odds", F.lit(0.0)), 9)
    done = read.join(scores, ["host", "path"], "left").select(
        "host", "path", "rule", F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), "words", score.alias("log_odds"))
    return urls.join(done, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "words", "log_odds")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES: dict[str, str] = {}
