"""Filter interaction audit: what each filter removes under every order of the filters.

Five failure conditions hold or not for a document. A: fewer than ``MIN_WORDS`` words. B: distinct
words under ``LEAST_DISTINCT`` percent of the words. C: capitals A-Z over ``MOST_CAPITALS`` percent of the
code points. D: a symbol. E: the text is that of a smaller ``doc_id`` anywhere in the table.

A to D come from one sweep over the Arrow buffers (``scan``): byte classes, prefix sums, and per text
the sorted word hashes, of which equal neighbours are verified byte by byte; a text with a false
match is counted from its words. The failures of a document are a mask of five bits, and everything
the report needs is the number of documents by part, mask and label: one small table, at most 128
rows a part, which all 120 orders are derived from.

E needs no join of equal texts: of each digest (SHA-256) the least id passes and all others fail, and
texts are counted by digest, part and mask before they meet, so a text held by a third of all
documents is a few rows.

Defined results: a null text is empty (it fails A, and E if an empty text has a smaller id); a null
part is the empty string, and so is an empty one; a null ``doc_id`` is smaller than none and larger
than none, so it never fails E nor makes another fail, and has no labels; rows that repeat an id all
count, and fail E by ids only; of repeated labels of an id one with the mark is enough, a null label
is no mark; an empty table gives no rows; whole texts are read; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.llm.columns import documents
from sparquill.llm.hashing import U
from sparquill.llm.memory import releasing
from sparquill.llm.scan import counts, differing, range_hashes, sweeps, word_ranges

# The filters in bit order, their limits, and the symbols of D.
FILTERS = "ABCDE"
MIN_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = "#$%&*|"

_CAPITAL = np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80  # not a continuation: one for each code point

#: Bits of a word's hash in a sort key; the text's index stands above them.
HASH_BITS = 48


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Number of distinct words of each text."""
    sizes = np.diff(word_at)
    key = (np.repeat(np.arange(len(sizes), dtype=U), sizes) << U(HASH_BITS)) | (range_hashes(data, starts, ends) >> U(64 - HASH_BITS))
    order = np.argsort(key, kind="stable")
    key = key[order]
    twin = np.flatnonzero(key[1:] == key[:-1])
    owner = (key[twin] >> U(HASH_BITS)).astype(np.int64)
    out = sizes - np.bincount(owner, minlength=len(sizes))
    for i in set(owner[differing(data, starts, ends, order[twin], order[twin + 1])].tolist()):
        out[i] = len({data[s:e].tobytes() for s, e in zip(starts[word_at[i] : word_at[i + 1]], ends[word_at[i] : word_at[i + 1]], strict=True)})
    return out


def failures(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits 0 to 3 of each text's mask: it fails A, B, C, D."""
    starts, ends, word_at = word_ranges(data, at)
    n_words = np.diff(word_at)
    few = n_words < MIN_WORDS
    plain = 100 * distinct_words(data, starts, ends, word_at) < LEAST_DISTINCT * n_words
    loud = 100 * counts(_CAPITAL[data], at) > MOST_CAPITALS * counts(_FIRST_BYTE[data], at)
    symbols = counts(_SYMBOL[data], at) > 0
    return few * 1 + plain * 2 + loud * 4 + symbols * 8


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """``doc_id, part, mask, digest`` of every document; the mask has bits for A to D."""
    rows = documents(docs, "doc_id", "text", part).select("doc_id", "text", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in sweeps(batch.column(1)):
                n, raw = len(at) - 1, data.tobytes()
                digests = [hashlib.sha256(raw[a:b]).digest() for a, b in itertools.pairwise(at.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first : first + n], batch.column(2)[first : first + n], pa.array(failures(data, at), pa.int32()), pa.array(digests, pa.binary())],
                    names=["doc_id", "part", "mask", "digest"],
                )

    return rows.mapInArrow(releasing(run), "doc_id long, part string, mask int, digest binary")


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part, mask, good, toxic, n``: documents by what they fail (five bits) and their labels."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("doc_id IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("spread", F.lit(0))
    # Rows without an id match no label; they are spread by the task they come from and do not meet in one.
    found = masks(docs, part).withColumn("spread", F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(F.lit(0)))
    marked = found.join(marks, ["doc_id", "spread"], "left")
    kinds = ["part", "mask", "good", "toxic"]
    false = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    by_id = marked.select("doc_id", "spread", "digest", "part", "mask", false("good"), false("toxic")).groupBy("doc_id", "spread", "digest", *kinds).agg(F.count(F.lit(1)).alias("n"))
    # Of each digest and kind: all rows, those without an id, and those of the least id.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    by_text = by_id.groupBy("digest", *kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("no_id"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("no_id") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(F.lit(0))
    split = by_text.select(*kinds, "n", passing.alias("passing"))
    both = F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    each = split.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "good", "toxic", "x.n")
    return each.groupBy(*kinds).agg(F.sum("n").alias("n"))


def report(cells: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included, from the counts of ``cells``."""
    n = len(FILTERS)
    steps = []
    for order in itertools.permutations(range(n)):
        earlier = 0
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[i] for i in order), k + 1, 1 << f, earlier))
            earlier |= 1 << f
    plan = F.from_json(F.lit(str([[*s] for s in steps]).replace("'", '"')), "array<array<string>>")
    # A document that fails k filters is removed by each of them in one k-th of the orders.
    orders = len(steps) // n
    rows = cells.select("*", F.explode(plan).alias("s")).select(
        "part",
        F.col("s")[0].alias("filter_order"),
        F.col("s")[1].cast("int").alias("step"),
        F.col("mask").bitwiseAND(F.col("s")[2].cast("int")).alias("fails"),
        F.col("mask").bitwiseAND(F.col("s")[3].cast("int")).alias("failed"),
        "mask",
        "good",
        "toxic",
        "n",
    )
    fails, gone = F.col("fails") > 0, F.col("failed") > 0
    removed = fails & ~gone
    total = lambda when, x="n": F.sum(F.when(when, F.col(x)).otherwise(F.lit(0))).cast("long")
    share = F.when(fails, F.col("n") * (F.lit(orders) / F.bit_count("mask")).cast("long")).otherwise(F.lit(0))
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(removed).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(fails & (F.col("mask") == F.col("fails"))).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
        F.sum(share).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    return report(cells(docs, labels, part))


_WORD = r"[^\x20\x09-\x0D]+"

SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
counted AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS w FROM texts),
failing AS (SELECT doc_id, part,
    len(w) < {MIN_WORDS} AS a, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) AS b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(text) AS c,
    regexp_matches(text, '[{SYMBOLS}]') AS d, coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e FROM counted),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
kinds AS (SELECT part, {{'A': a, 'B': b, 'C': c, 'D': d, 'E': e}} AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY ALL),
flat AS (SELECT row_number() OVER () AS kind, part, good, toxic, n, CAST(f.A AS INT) + CAST(f.B AS INT) + CAST(f.C AS INT) + CAST(f.D AS INT) + CAST(f.E AS INT) AS n_failed,
  map {{'A': f.A, 'B': f.B, 'C': f.C, 'D': f.D, 'E': f.E}} AS f FROM kinds),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
placed AS (SELECT part, good, toxic, n, n_failed, filter_order, step, f[filter_order[step]] AS fails,
  len(list_filter(range(1, step), lambda k: f[filter_order[k]])) > 0 AS gone FROM flat, steps),
worth AS (SELECT part, filter_order[step] AS x, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS shapley FROM placed GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step,
  CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails AND n_failed = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(any_value(shapley) AS BIGINT) AS shapley
FROM placed JOIN worth ON worth.part = placed.part AND worth.x = filter_order[step] GROUP BY placed.part, filter_order, step
"""
SQL = SQL.replace("SELECT part, filter_order, CAST(step", "SELECT placed.part AS part, filter_order, CAST(step")
