"""An index that grows by segments, and the merge of its segments.

A segment is the documents of one batch, tokenised once, with their postings in their rows. It
counts from the moment its number is committed, by an empty file that is created when everything else
is written, so a batch that fails half-way leaves nothing behind and one that is repeated does nothing.
Numbers order the segments: of an id in several segments the last one counts, and a deletion takes
away what was added before it.

The merge makes one index of the last merged one and the segments since. Postings that are replaced or
deleted are left out; the others are ranged and sorted together, never tokenised again, and counted
as they are written. Next-word counts are kept for the merge, unless the index has none: those of the
segments are added, those of documents that go are subtracted. Joins by document happen only if some
id was replaced or deleted, and then on the ids; up to ``BROADCAST_IDS`` of them are broadcast.

    path/meta                     mode, stem, stop words, next words or not
    path/terms/number=N           doc_id, lang, header, posts, field_posts[, terms, field_terms[, said]]
    path/deleted/number=N         doc_id
    path/commits/N                committed segments
    path/merged/N                 the index of all segments up to N; counts once path/merges/N is there

One writer at a time is assumed; readers of a merged index are not disturbed by the next merge.
"""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.operators.index import STOP_WORDS, Index, counted_norms, dictionary, doc_stats, field_postings, frequent_in, frequent_terms, pairs, sized, small_reads, tokenised, top_next, vocabulary_ranks, write_counted, write_meta, write_sorted
from sparquill.storage import exists, mark, names, passing, remove, written

#: Replaced or deleted ids that are broadcast to the postings they are taken from.
BROADCAST_IDS = 2_000_000
#: Bytes of segments that a task sorts for the merge.
SORTED_BYTES = 16_000_000


def grows(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/commits")


class Segments:
    """A growing index at ``path``; the settings of an existing one are read from it."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "words", stop_words: tuple[str, ...] = STOP_WORDS, stem: bool = False, next_words: bool = True):
        self.spark, self.path = spark, path
        if not exists(spark, f"{path}/meta/_SUCCESS"):
            rows = [(mode, stem, list(stop_words), next_words)]
            spark.createDataFrame(rows, "mode string, stem boolean, stop_words array<string>, next_words boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        meta = spark.read.parquet(f"{path}/meta").first()
        self.mode, self.stem, self.stop_words = meta.mode, meta.stem, tuple(meta.stop_words)
        self.next_words = meta.asDict().get("next_words", True)

    def numbers(self) -> list[int]:
        """Committed segments, in order."""
        return sorted(map(int, names(self.spark, f"{self.path}/commits")))

    def merges(self) -> list[int]:
        return sorted(map(int, names(self.spark, f"{self.path}/merges")))

    def _next(self) -> int:
        return max(self.numbers(), default=-1) + 1

    def add(self, docs: DataFrame, number: int | None = None) -> int:
        """Adds ``docs(doc_id, text[, lang, header])`` as one segment; of rows that share an id one counts, as in ``Index.build``."""
        number = self._next() if number is None else number
        if number not in self.numbers():
            with passing(docs.sparkSession):
                rows = tokenised(docs, self.mode, self.stop_words, self.stem)
                rows = rows if self.next_words else rows.drop("terms", "field_terms", "said")
                rows.write.mode("overwrite").parquet(f"{self.path}/terms/number={number}", compression="zstd")
            mark(self.spark, f"{self.path}/commits/{number}")
        return number

    def delete(self, ids: DataFrame, number: int | None = None) -> int:
        """Takes the documents of ``ids(doc_id)`` away, as far as they were added before."""
        number = self._next() if number is None else number
        if number not in self.numbers():
            ids.select("doc_id").filter("doc_id IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.path}/deleted/number={number}")
            mark(self.spark, f"{self.path}/commits/{number}")
        return number

    def _read(self, table: str, numbers: list[int]) -> DataFrame | None:
        """The rows of a table in these segments, with ``number``; ``None`` if none of them has it."""
        found = {f"number={n}" for n in numbers} & set(names(self.spark, f"{self.path}/{table}"))
        if not found:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/{n}" for n in sorted(found)))

    def _few(self, ids: DataFrame) -> DataFrame | None:
        """The ids to be left out, marked to be broadcast if they are few; ``None`` if there are none."""
        n = ids.count()
        return None if n == 0 else F.broadcast(ids) if n <= BROADCAST_IDS else ids

    def index(self) -> Index:
        """The index of all committed segments; merges those that the last merge does not hold."""
        last = max(self.numbers(), default=-1)
        if last < 0:
            raise ValueError(f"{self.path} has no segments yet")
        if last not in self.merges():
            self._merge(last)
        return Index.open(self.spark, f"{self.path}/merged/{last}", self.next_words)

    def _merge(self, last: int) -> None:
        before = max(self.merges(), default=None)
        new = [n for n in self.numbers() if before is None or n > before]
        out, base = f"{self.path}/merged/{last}", f"{self.path}/merged/{before}"
        old = lambda table: None if before is None else self.spark.read.parquet(f"{base}/{table}")
        with passing(self.spark), ExitStack() as stack:
            added, deleted = self._read("terms", new), self._read("deleted", new)
            if added is None and before is None:
                raise ValueError(f"{self.path} has no documents yet")
            events = [t.select("doc_id", "number", F.lit(live).alias("live")) for t, live in ((added, True), (deleted, False)) if t is not None]
            changes = events[0] if len(events) == 1 else events[0].unionByName(events[1])
            # The last word on each id, and the segments that spoke of it.
            state = changes.groupBy("doc_id").agg(F.max(F.struct("number", "live")).alias("s"), F.collect_set("number").alias("numbers"))
            state = written(state.select("doc_id", "s.number", "s.live", "numbers"), "changes")
            gone = None  # ids of the merged index that are replaced or deleted, with the segment they are in
            if before is not None:
                gone = self._few(written(old("docs").select("doc_id", F.col("segment").alias("number")).join(state.select("doc_id"), "doc_id", "left_semi"), "gone"))
            # Only if an id has more than one event do the new segments hold rows that do not count.
            stale = F.filter("numbers", lambda n: ~F.col("live") | (n != F.col("number")))
            stale = self._few(written(state.select("doc_id", F.explode(stale).alias("number")), "stale"))

            def current(rows: DataFrame | None) -> DataFrame | None:
                return rows if rows is None or stale is None else rows.join(stale, ["doc_id", "number"], "left_anti").select(*rows.columns)

            def left(rows: DataFrame | None) -> DataFrame | None:
                return rows if rows is None or gone is None else rows.join(gone.select("doc_id"), "doc_id", "left_anti").select(*rows.columns)

            def both(a: DataFrame | None, b: DataFrame | None) -> DataFrame:
                return a if b is None else b if a is None else a.unionByName(b)

            fresh = current(added)
            counts = None if fresh is None else doc_stats(fresh, "lang", "header", F.col("number").cast("long").alias("segment"))
            docs = written(both(None if before is None else left(old("docs").drop("doc_norm")), counts), "docs")
            size = docs.agg(F.count(F.lit(1)).alias("docs"), F.sum("n_distinct").alias("posts")).first()
            stack.enter_context(sized(self.spark, size.posts or 0))
            own = None if fresh is None else fresh.select("doc_id", F.explode("posts").alias("p")).select("p.term", "doc_id", "p.positions")
            if own is not None:  # sorted rows shuffle as two thirds of their bytes; without the filter, which is always true, the optimizer would drop this sort for the next one
                own = own.sortWithinPartitions("term", "doc_id").filter(F.monotonically_increasing_id() >= 0)
            merged = left(old("postings"))
            frequent = set() if before is None else set(frequent_terms(old("dictionary")))
            for n in new:
                segment = self._read("terms", [n])
                frequent |= set() if segment is None else set(frequent_in(segment))
            frequent = sorted(frequent)
            with small_reads(self.spark, SORTED_BYTES):
                write_counted(both(None if merged is None else merged.select("term", "doc_id", "positions"), own), f"{out}/postings", frequent)
            posts = self.spark.read.parquet(f"{out}/postings")
            vocabulary_ranks(dictionary(posts, size.docs)).write.mode("overwrite").parquet(f"{out}/dictionary")
            dic = self.spark.read.parquet(f"{out}/dictionary")
            write_sorted(both(left(old("fields")), None if fresh is None else field_postings(fresh, "header")), f"{out}/fields", "term", "doc_id")
            if self.next_words:
                summed = [t for t in (old("pairs"), None if fresh is None else pairs(fresh, self.stem)) if t is not None]
                if gone is not None:
                    lost = self._read("terms", [n for n in self.numbers() if n <= before]).join(gone, ["doc_id", "number"], "left_semi")
                    summed.append(pairs(lost, self.stem).withColumn("cnt", -F.col("cnt")))
                counted = summed[0]
                for t in summed[1:]:
                    counted = counted.unionByName(t)
                counted.groupBy("term", "next_term").agg(F.sum("cnt").alias("cnt")).filter("cnt > 0").write.mode("overwrite").parquet(f"{out}/pairs")
                write_sorted(top_next(self.spark.read.parquet(f"{out}/pairs")), f"{out}/next_words", "term", "rank")
            full = docs.join(counted_norms(posts, dic, docs, frequent), "doc_id", "left")
            full.withColumn("doc_norm", F.coalesce("doc_norm", F.lit(0.0))).write.mode("overwrite").parquet(f"{out}/docs")
        write_meta(self.spark, out, self.mode, self.stem)
        mark(self.spark, f"{self.path}/merges/{last}")
        for old_one in self.merges()[:-2]:  # the merge before the last may still be read
            remove(self.spark, f"{self.path}/merges/{old_one}")
            remove(self.spark, f"{self.path}/merged/{old_one}")
