"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text, with word rules.

Native: only DataFrame functions on the main path. Word unigrams and bigrams are hashed into
``buckets`` counters. Two add-one multinomials over the buckets, one of the raw corpus and one of
the trusted target, give each bucket a log ratio; a document scores the mean ratio of its n-grams
and is kept if that is at least ``threshold``. The raw counts cover every document. The target is
a bounded, documented sample: at most ``max_trusted`` documents labelled as trusted, those of
least hash, so that the ids can be broadcast.

Per document all features are taken inside its row: windows of three words are hashed, sorted with
their positions, and neighbours compared, so nothing is exploded or shuffled for them and a long
text costs n log n.

Defined results: a null text has no words; documents under ``min_words`` words, or with more than
half of their words in repeated windows, fail the base rules and are not kept; without any trusted
document the ratio is 0 for all; a null ``doc_id`` stays null and is never trusted; repeated rows
count and are scored each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.llm.columns import documents

# The characters of a word, and the symbols that are counted.
SPACE_RUN = r"[ \t-\r]+"
HAS_WORD = r"[^ \t-\r]"
SYMBOL = r"[#*$%&|<>]"

BUCKETS = 16_384
MAX_TRUSTED = 20_000
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
THRESHOLD = -0.075


def with_words(docs: DataFrame) -> DataFrame:
    """Adds ``words`` (maximal runs without ASCII white space) and ``n_words``."""
    return docs.withColumn("words", F.array_remove(F.split("text", SPACE_RUN), "")).withColumn("n_words", F.size("words").cast("long"))


def bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """At most ``max_trusted`` distinct ids with quality 1, those of least hash."""
    ids = labels.filter((labels["quality"] == 1) & labels["doc_id"].isNotNull()).select(F.col("doc_id").cast("long")).distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def bucket_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> list[float]:
    """Log ratio of each bucket. One row a bucket reaches the driver; their number is a parameter."""
    chosen = F.broadcast(trusted_ids(labels, max_trusted).select(F.col("doc_id").alias("trusted_id")))
    marked = documents(docs).join(chosen, F.col("doc_id") == F.col("trusted_id"), "left")
    pairs = with_words(marked).select(F.explode(F.arrays_zip("words", F.expr("slice(words, 2, n_words)").alias("next"))).alias("p"), F.col("trusted_id").isNotNull().cast("long").alias("t"))
    first, second = F.xxhash64("p.words"), F.xxhash64("p.next")
    grams = pairs.select(F.explode(F.array(bucket(first, buckets), F.when(F.col("p.next").isNotNull(), bucket(F.xxhash64(first, second), buckets)))).alias("bucket"), "t").filter("bucket IS NOT NULL")
    raw, target = [0] * buckets, [0] * buckets
    for row in grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect():
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    if not sum(target):
        return [0.0] * buckets
    import math

    base = math.log((sum(raw) + buckets) / (sum(target) + buckets))
    return [math.log((t + 1) / (r + 1)) + base for t, r in zip(target, raw, strict=True)]


def scored(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Features, length-normalised ratio and verdict of every document."""
    buckets = len(ratios)
    table = F.split(F.lit(",".join(repr(r) for r in ratios)), ",").cast("array<double>")  # folded to one literal
    # Each column is used more than once further on, so the optimizer computes it once and does not inline it.
    base = with_words(documents(docs)).withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    window = F.transform("h1", lambda h, i: F.xxhash64(h, F.get("h1", i + 1), F.get("h1", i + 2)))
    base = base.withColumn("h3", F.slice(window, 1, F.greatest(F.size("h1") - 2, F.lit(0))))
    # Most texts repeat no window; only the others sort their windows.
    placed = F.sort_array(F.zip_with("h3", F.sequence(F.lit(1), F.size("h3")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("sorted", F.when(F.size(F.array_distinct("h3")) < F.size("h3"), placed))
    repeated = F.filter("sorted", lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"]))
    base = base.withColumn("starts", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(
        F.zip_with("starts", F.slice("starts", 2, F.size("starts")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(HAS_WORD))
    base = base.withColumn("lines", lines)
    gain = F.transform(
        "h1",
        lambda h, i: F.get(table, bucket(h, buckets)) + F.when(i + 1 < F.size("h1"), F.get(table, bucket(F.xxhash64(h, F.get("h1", i + 1)), buckets))).otherwise(0.0),
    )
    total = F.aggregate(gain, F.lit(0.0), lambda s, x: s + x)
    length = F.col("n_words") * 2 - 1
    featured = base.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOL, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.when(F.col("n_words") > 0, total / length).otherwise(F.lit(0.0)).alias("ratio"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    return featured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED, threshold: float = THRESHOLD) -> DataFrame:
    """Every document with its features, ``ratio``, ``base_failed`` and ``kept``."""
    return scored(docs, bucket_ratios(docs, labels, buckets, max_trusted), threshold)
