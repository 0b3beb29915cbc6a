"""The best documents of a query without scoring every candidate.

The documents, in the order of their ids, are cut into blocks of ``BLOCK_DOCS``. For each term and block a
row holds the greatest that the term makes of any document's BM25 there, and its greatest share of a document's terms,
from which the block's least norm bounds the cosine. The sum over a query's terms, and the most that proximity can add,
bounds the score of all documents of a block. Blocks of high bounds are scored first; the k-th best score found is a threshold, and blocks
that cannot reach it are never read: postings are sorted by term and document, so a block is a
range of ids that the scan prunes by. The rows are those of scoring everything.

    path/ranges     block, low, high (ids), n_docs, least_norm (above 0)
    path/bounds     term, block, bm25, share (rounded up to whole numbers); each file sorted by term

Postings are written in that order and carry their documents' lengths, so the bounds are made where the postings are read and
nothing is shuffled. A block has one row more where two tasks share it. Of the blocks only their first ids go to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.operators.index import Index, sized, vocabulary_ranks
from sparquill.operators.lookup import gathered, in_ranges, one_of
from sparquill.operators.ranking import BROADCAST_TERMS, COSINE_WEIGHT, COSINE_WEIGHT_STEMMED, K1, TOP, VARIANT, B, best, distinct_terms, scored
from sparquill.storage import new_path, passing

BLOCK_DOCS = 64
#: Blocks that are scored first, of each query.
FIRST_BLOCKS = 16
#: What rounding to three places can add to a score.
ROUNDING = 0.0006
#: Bounds are kept in these parts of one, rounded up.
UNIT_BM25, UNIT_SHARE = 1000, 10_000


@dataclass(frozen=True)
class Bounds:
    """Score bounds of an index, as written."""

    index: Index
    ranges: DataFrame
    bounds: DataFrame

    @classmethod
    def build(cls, index: Index, path: str | None = None, block_docs: int = BLOCK_DOCS) -> Bounds:
        """Writes the bounds of a written index. Documents without terms are in no block: no query finds them."""
        spark = index.docs.sparkSession
        path = path or new_path(spark, "bounds")
        docs = index.docs.filter("n_terms > 0").select("doc_id", "doc_norm")
        with passing(spark):
            placed = vocabulary_ranks(docs.withColumnRenamed("doc_id", "term")).withColumnRenamed("term", "doc_id")
            blocks = placed.withColumn("block", F.floor(F.col("place") / block_docs)).groupBy("block")
            ranges = blocks.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n_docs"), F.min(F.when(F.col("doc_norm") > 0, F.col("doc_norm"))).alias("least_norm"))
            ranges.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").parquet(f"{path}/ranges")
        ranges = spark.read.parquet(f"{path}/ranges")
        lows = [r.low for r in ranges.select("low").orderBy("low").toLocalIterator()]  # one of block_docs ids
        with sized(spark, index.dictionary.agg(F.sum("df")).first()[0] or 0):
            rows = index.counted
            if rows is None:
                rows = index.postings.select("term", "doc_id", "tf").join(index.docs.select("doc_id", "n_terms"), "doc_id").repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
            most = rows.select("term", "doc_id", "tf", "n_terms").mapInArrow(greatest(lows, float(index.avg_dl)), "term string, block long, bm25 int, share int")
            most.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/bounds")
        return cls(index, ranges, spark.read.parquet(f"{path}/bounds"))

    def of_blocks(self, query_terms: DataFrame) -> DataFrame | None:
        """``query_id, block, bound``: what no document of the block can exceed. ``None`` if the terms are too many to be gathered."""
        small = gathered(distinct_terms(query_terms), BROADCAST_TERMS)
        if small is None:
            return None
        q, terms = small[0], one_of("term", {r.term for r in small[1]})
        dictionary = self.index.dictionary.filter(terms).select("term", "df", "idf")
        n = self.index.n_docs
        idf = F.coalesce("idf", F.lit(0.0))
        known = q.join(dictionary, "term", "left").withColumn("rarity", F.greatest(F.log2((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0)))
        whole = known.groupBy(*VARIANT).agg(
            F.sqrt(F.sum(F.col("weight") * F.col("weight")).cast("double")).alias("w"),
            # A term's proximity is under min(1, idf) * (K1 + 1); a single term has none.
            F.when(F.count(F.lit(1)) > 1, F.sum(F.least(F.lit(1.0), idf)) * (K1 + 1)).otherwise(F.lit(0.0)).alias("near"),
        )
        most = self.bounds.filter(terms).groupBy("term", "block").agg(F.max("bm25").alias("bm25"), F.max("share").alias("share"))
        hits = most.join(F.broadcast(known.filter("df IS NOT NULL").select(*VARIANT, "term", "weight", "rarity", "idf")), "term")
        sums = hits.groupBy(*VARIANT, "block").agg(
            F.sum(F.col("rarity") * F.col("bm25") / UNIT_BM25).alias("bm25"),
            F.sum(F.col("idf") * F.col("share") / UNIT_SHARE * F.col("weight")).alias("cosine"),
        )
        weight = COSINE_WEIGHT_STEMMED if self.index.stem else COSINE_WEIGHT
        # No cosine is over 1, but that the norm was rounded to four places.
        cosine = F.least(F.col("cosine") / F.col("w") / F.col("least_norm"), F.lit(1.0) + F.lit(0.00005) / F.col("least_norm"))
        bound = F.col("bm25") + F.coalesce(cosine, F.lit(0.0)) * weight + F.col("near") + ROUNDING
        of = sums.join(F.broadcast(whole), list(VARIANT)).join(self.ranges.select("block", "least_norm"), "block")
        return of.groupBy("query_id", "block").agg(F.max(bound).alias("bound"))

    def _restricted(self, blocks: list[int]) -> Index:
        """The index with the postings of some blocks only (and of what lies between, where blocks share a range)."""
        found = self.ranges.filter(one_of("block", set(blocks))).collect()  # as many as the blocks that were gathered
        return replace(self.index, postings=self.index.postings.filter(in_ranges("doc_id", joined(found))))

    def left_to_score(self, query_terms: DataFrame, k: int = TOP, languages: list[str] | None = None) -> Index:
        """The index with those postings that can matter to the k best documents of the queries."""
        of = self.of_blocks(query_terms)
        if of is None:
            return self.index
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
        small = gathered(of.withColumn("place", place).filter(F.col("place") <= FIRST_BLOCKS).select("block").distinct())
        if small is None:
            return self.index
        first = best(scored(self._restricted([r.block for r in small[1]]), query_terms, languages), k)
        floor = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        can = of.join(floor, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
        small = gathered(can.select("block").distinct())
        return self.index if small is None else self._restricted([r.block for r in small[1]])

    def search(self, query_terms: DataFrame, k: int = TOP, languages: list[str] | None = None) -> DataFrame:
        """``query_id, doc_id, score, rank``: the k best, as ``best(scored(...), k)`` gives them."""
        return best(scored(self.left_to_score(query_terms, k, languages), query_terms, languages), k)


def greatest(lows: list, avg_dl: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``term, block, bm25, share`` of postings ``term, doc_id, tf, n_terms`` in that order, for blocks that begin with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array(lows) if lows and not isinstance(lows[0], str) else np.array(lows, dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            term, tf, n_terms = batch["term"].dictionary_encode(), batch["tf"].to_numpy().astype(float), batch["n_terms"].to_numpy().astype(float)
            block = np.searchsorted(first, batch["doc_id"].to_numpy(zero_copy_only=False), side="right") - 1
            code = term.indices.to_numpy()
            at = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(block) != 0)))
            bm25 = (K1 + 1) * tf / (K1 * (1 - B + B * n_terms / avg_dl) + tf)
            whole = lambda x, unit: pa.array(np.ceil(np.maximum.reduceat(x, at) * unit + 1e-9).astype(np.int32))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch["term"].take(pa.array(at)), pa.array(block[at]), whole(bm25, UNIT_BM25), whole(tf / n_terms, UNIT_SHARE)], ["term", "block", "bm25", "share"])

    return run


def joined(blocks: list) -> list[tuple]:
    """Ranges of ids, those of neighbouring blocks in one."""
    out: list[list] = []
    for r in sorted(blocks, key=lambda r: r.block):
        if out and out[-1][2] == r.block - 1:
            out[-1][1], out[-1][2] = r.high, r.block
        else:
            out.append([r.low, r.high, r.block])
    return [(low, high) for low, high, _ in out]
