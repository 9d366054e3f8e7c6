"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document's terms are its lower-cased words (white space parts them), weighted by their counts.  For each
sample j and term, hashes of the term give r and c from a Gamma(2, 1) distribution and b from a uniform one;
with t = floor(ln(weight) / r + b) the term's value is ln c - r (t - b + 1), and the sample is the (term, t) of
the smallest value.  Two documents agree in a sample with a probability equal to their generalised Jaccard
similarity, the sum of the smaller over the sum of the larger weights.

A value is a whole number: its upper bits order it, its lower 30 bits are a hash of (term, t), so that a sample is
one ``min`` over longs.  The 16 lowest bits of each sample form the fingerprint.

All words of a document meet in the task that the one exchange of texts (by block of doc_ids) sends them to; the
counts and the minima are taken there.

Defined cases: null text is empty; a text without words has the all-zero fingerprint, alike with its own kind;
rows that repeat a doc_id are ordered by a hash of their text and each get a row; rows without doc_id come
last in the order; an only row is followed by itself; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.operators.landing import land

SAMPLES = 32
GROUP = 8
BLOCK_BITS = 7
_LOW = (1 << 32) - 1
_ID_BITS = 30


def _unit(x: Column) -> Column:
    return (x + F.lit(0.5)) / F.lit(float(1 << 32))


def _uniforms(term: Column, j: Column, turn: int) -> tuple[Column, Column]:
    h = F.xxhash64(j * 4 + turn, term)
    return _unit(F.shiftrightunsigned(h, 32)), _unit(h.bitwiseAND(F.lit(_LOW)))


def _sample(term: Column, log_weight: Column, j: Column) -> Column:
    """Value and identity of one term in sample j, packed into a long."""
    u1, u2 = _uniforms(term, j, 0)
    u3, u4 = _uniforms(term, j, 1)
    b, _ = _uniforms(term, j, 2)
    r, log_c = -F.ln(u1 * u2), F.ln(-F.ln(u3 * u4))
    t = F.floor(log_weight / r + b)
    # r is below 46 and ln c above -23, so that the sum is positive for every count and below 2 ** 33.
    value = ((log_c - r * (t - b + 1) + 128) * F.lit(float(1 << 25))).cast("long")
    return F.shiftleft(value, _ID_BITS).bitwiseOR(F.xxhash64(term, t, j).bitwiseAND(F.lit((1 << _ID_BITS) - 1)))


def _print(prefix: str) -> Column:
    """16 bits of every sample of a group as hexadecimal digits; zeros for a text without words."""
    return F.concat(*(F.lpad(F.hex(F.coalesce(F.col(f"{prefix}{i}"), F.lit(0)).bitwiseAND(F.lit(0xFFFF))), 4, "0") for i in range(GROUP)))


def likeness(one: Column, two: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    same = [(F.substring(one, 4 * j + 1, 4) == F.substring(two, 4 * j + 1, 4)).cast("int") for j in range(samples)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(samples))


def followers(rows: DataFrame) -> DataFrame:
    """What follows the last row of each block in descending order, for ``rows`` (block, doc_id, tie):
    (block, next_block, next_id, next_tie).  Blocks are ordered in two levels, so that a window holds the blocks of
    one range, or one row per range."""
    first = F.struct("block", "doc_id", "tie")
    top = rows.groupBy("block").agg(F.max(first).alias("first")).withColumn("range", F.shiftright("block", 16))
    ranges = top.groupBy("range").agg(F.max("first").alias("range_first"))
    below = ranges.select("range", F.coalesce(F.lag("range_first").over(Window.orderBy("range")),
                                              F.max("range_first").over(Window.partitionBy())).alias("range_below"))
    within = Window.partitionBy("range").orderBy("block")
    after = F.coalesce(F.col("below"), F.col("range_below"))
    return (top.withColumn("below", F.lag("first").over(within)).join(below, "range").withColumn("after", after)
            .select("block", F.col("after.block").alias("next_block"), F.col("after.doc_id").alias("next_id"), F.col("after.tie").alias("next_tie")))


def with_edits(docs: DataFrame) -> DataFrame:
    """(block, place, doc_id, next_block, next_place, text, edited): each text, and the text with its last third
    replaced by the start of the next document's.  ``place`` counts a block's rows in descending order of doc_id."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("tie", F.xxhash64("text")) \
        .withColumn("block", F.coalesce(F.shiftright("doc_id", BLOCK_BITS), F.shiftright("tie", 48) - F.lit(1 << 61)))
    firsts = land(followers(base.select("block", "doc_id", "tie")))
    texts = base.select(F.col("doc_id").alias("i"), F.col("tie").alias("k"), F.col("text").alias("end_text"))
    ends = firsts.join(texts, F.col("next_id").eqNullSafe(F.col("i")) & (F.col("next_tie") == F.col("k"))) \
        .select("block", "next_block", "end_text").dropDuplicates(["block"])
    order = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), F.desc("tie"))
    placed = base.select("block", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("after"))
    follow, last = F.coalesce("after", "end_text"), F.col("after").isNull()
    third = F.floor(F.length("text") / 3).cast("int")
    return placed.join(ends, "block").select(
        "block", "place", "doc_id", F.when(last, F.col("next_block")).otherwise(F.col("block")).alias("next_block"),
        F.when(last, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"), "text",
        F.concat(F.substr("text", F.lit(1), F.length("text") - third), F.substr(follow, F.lit(1), third)).alias("edited"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``samples`` is a multiple of ``GROUP``.  One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    row = ["block", "place"]
    words = lambda c: F.split(F.lower(F.translate(c, "\t\n\x0b\x0c\r", "     ")), " ")
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    facts = ["doc_id", "next_block", "next_place", "n_chars", *(f"sha{i}" for i in range(5))]
    edits = with_edits(docs).withColumn("n_chars", F.length("text"))
    told = F.array(*(F.col(c).cast("string") for c in facts[:4]), *(F.conv(F.substring(sha, 15 * i + 1, 15), 16, 10) for i in range(5)))
    # A document's facts travel with its words, as rows marked by y = -1, so that its text is sent and read once.
    sides = F.array(*(F.struct(w.alias("w"), F.lit(x).alias("x"), F.lit(y).alias("y")) for w, x, y in ((words("text"), 1, 0), (words("edited"), 0, 1), (told, 0, -1))))
    fact = F.col("y") == -1
    counted = (edits.select(*row, F.explode(sides).alias("s")).select(*row, "s.x", "s.y", F.posexplode("s.w").alias("pos", "word"))
               .select(*row, F.when(fact, F.col("pos").cast("long")).when(F.col("word") != "", F.xxhash64("word")).alias("term"),
                       F.when(fact, F.col("word").cast("long")).otherwise(F.col("x").cast("long")).alias("x"), F.col("y").cast("long").alias("y"))
               .groupBy(*row, "term", fact.alias("fact")).agg(F.sum("x").alias("x"), F.sum("y").alias("y")))
    weighted = ~F.col("fact") & F.col("term").isNotNull()
    logs = counted.select(*row, "term", "fact", "x", *(F.when(weighted & (F.col(c) > 0), F.ln(F.col(c).cast("double"))).alias(f"log_{c}") for c in "xy"))
    # samples are taken in groups, which keeps the compiled loop small
    group = F.col("group")
    sample = lambda c, i: _sample(F.col("term"), F.col(f"log_{c}"), group * GROUP + i)
    least = logs.withColumn("group", F.explode(F.array(*map(F.lit, range(samples // GROUP))))).groupBy(*row, "group").agg(
        *(F.min(sample(c, i)).alias(f"{c}{i}") for i in range(GROUP) for c in "xy"),
        *(F.max(F.when(F.col("fact") & (F.col("term") == i), F.col("x"))).alias(c) for i, c in enumerate(facts)))
    digits = [F.lpad(F.lower(F.hex(f"sha{i}")), 15 if i < 4 else 4, "0") for i in range(5)]
    parts = least.select(*row, *facts[:4], F.concat(*digits).alias("edited_sha256"), F.struct("group", _print("x").alias("x"), _print("y").alias("y")).alias("p"))
    whole = parts.groupBy(*row, *facts[:4], "edited_sha256").agg(F.array_sort(F.collect_list("p")).alias("p"))
    prints = land(whole.select(*row, *facts[:4], "edited_sha256", F.array_join("p.x", "").alias("fingerprint"), F.array_join("p.y", "").alias("edited_fingerprint")))
    ahead = prints.select(F.col("block").alias("next_block"), F.col("place").cast("long").alias("next_place"), F.col("fingerprint").alias("next_fingerprint"))
    return (prints.join(ahead, ["next_block", "next_place"])
            .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next")))


def op8_weighted_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_weighted_fingerprint": op8_weighted_fingerprint}
ORACLES: dict[str, str] = {}
