"""The inverted index as DataFrames: postings, dictionary, document and corpus statistics, next words.

A document's terms stay one array per row as long as they can; only postings and counts explode it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.functions import tokenize
from sparquill.functions.compat import compat_terms
from sparquill.functions.porter import stem_udf, stemmed
from sparquill.storage import new_path, passing, written

STOP_WORDS = ("a", "and", "for", "in", "is", "it", "of", "on", "that", "the", "to")
MODES = ("words", "clean", "compat")
#: Terms with this part of all postings are frequent; so many of them at most.
FREQUENT = 10_000
#: Files that frequent terms are looked for in, to deal postings evenly.
SEEN_FILES = 2
#: Stop lists up to this size travel as literals inside the plan, larger ones are joined.
LITERAL_WORDS = 1000
#: Characters that a task tokenises, and rows that it sorts or groups, at most on average.
TASK_CHARS, TASK_ROWS = 8_000_000, 2_000_000


def terms(docs: DataFrame, mode: str = "words", stop_words: tuple[str, ...] = STOP_WORDS, text: str = "text", leading: bool = True) -> DataFrame:
    """``docs`` with ``terms``, the array of emitted terms in order.

    ``compat`` keeps every quirk of the original rules; there documents have a ``leading`` space, queries have none.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if len(stop_words) > LITERAL_WORDS:
        raise ValueError("a stop list this long is given as a table: without_stop_words")
    if mode == "compat":
        return docs.withColumn("terms", compat_terms(F.col(text), stop_words, leading))
    made = F.expr(getattr(tokenize, "words" if mode == "words" else "terms")(text))
    return docs.withColumn("terms", F.filter(made, lambda t: ~t.isin(*stop_words)) if stop_words else made)


def tasks(spark: SparkSession, amount: int, of_one: int) -> int:
    """Tasks for an amount of work, at most ``of_one`` in each; never fewer than the session's partitions or cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-amount // of_one))


def spread(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows dealt evenly to tasks of ``TASK_CHARS``: a file of few row groups would be tokenised by as few tasks."""
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    return docs.repartition(tasks(docs.sparkSession, chars, TASK_CHARS), F.xxhash64("doc_id", text))


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator:
    """Inside the block shuffles have partitions of ``TASK_ROWS`` at most on average, which tasks sort and group in memory."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks(spark, rows, TASK_ROWS)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@contextmanager
def small_reads(spark: SparkSession, of_one: int) -> Iterator:
    """Inside the block scans of files give a task ``of_one`` bytes at most, which it sorts in memory."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(of_one))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def tokens(termed: DataFrame) -> DataFrame:
    """``doc_id, pos, term``: positions count the emitted terms from 0."""
    return termed.select("doc_id", F.posexplode("terms").alias("pos", "term"))


def without_stop_words(tokens: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Tokens whose term is not in the table ``stop_words(term)``; the planner broadcasts it if its size allows."""
    return tokens.join(stop_words.select("term").distinct(), "term", "left_anti").select("doc_id", "pos", "term")


def postings(tokens: DataFrame) -> DataFrame:
    """``term, doc_id, tf, positions``."""
    return tokens.groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


POSITIONS = pa.list_(pa.int32())
POST = pa.struct([("term", pa.string()), ("tf", pa.int32()), ("positions", POSITIONS)])
#: Documents that are grouped at a time.
SLICE = 1024


def posts_of_slice(terms: pa.Array) -> pa.Array:
    """A ``term, tf, positions`` for each distinct term of each row, by term: places are sorted by row and term in one go."""
    sizes = pc.fill_null(terms.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = terms.flatten().dictionary_encode()
    n, order = len(coded), pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    row = np.repeat(np.arange(len(sizes)), sizes)
    keys = row * len(order) + rank[coded.indices.to_numpy()]
    by_key = np.argsort(keys, kind="stable")
    keys = keys[by_key]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    places = (np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes))[by_key]
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), pa.array(places, pa.int32()))
    named = coded.dictionary.take(coded.indices.take(pa.array(by_key[starts])))
    posts = pa.StructArray.from_arrays([named, pa.array(np.diff(starts, append=n), pa.int32()), positions], fields=list(POST))
    ends = np.cumsum(np.bincount(row[by_key[starts]], minlength=len(sizes)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), posts)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])))
def posts_udf(terms: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([], pa.list_(POST)), *(posts_of_slice(terms[i : i + SLICE]).cast(pa.list_(POST)) for i in range(0, len(terms), SLICE))])


def with_posts(rows: DataFrame, terms: str, posts: str) -> DataFrame:
    """``rows`` with ``posts``, a ``term, tf, positions`` for each distinct term of the array column ``terms``.

    A document is grouped in its row, a slice of rows at a time; nothing is shuffled for it.
    Write the rows before exploding ``posts``: the filter that Spark derives from an explode repeats what makes them.
    """
    return rows.withColumn(posts, posts_udf(terms))


def write_postings(termed: DataFrame, path: str) -> None:
    """``term, doc_id, tf, positions`` of the rows of ``tokenised``, ranged and sorted by term and document."""
    write_sorted(termed.select("doc_id", F.explode("posts").alias("p")).select("p.term", "doc_id", "p.tf", "p.positions"), path, "term", "doc_id")


def frequent_in(termed: DataFrame) -> list[str]:
    """Terms that seem frequent in a few files of a written table; its documents are dealt to files by hash. They decide where postings go, not what they are."""
    seen = termed.sparkSession.read.schema(termed.schema).parquet(*sorted(termed.inputFiles())[:SEEN_FILES]).select(F.explode("posts.term").alias("term"))
    counted = seen.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return [r.term for r in counted.filter(F.col("n") * FREQUENT >= total).select("term").collect()]


def frequent_terms(dictionary: DataFrame) -> list[str]:
    """Terms with a ``FREQUENT``-th of all postings of a dictionary."""
    total = dictionary.agg(F.sum("df")).first()[0] or 0
    return [r.term for r in dictionary.filter(F.col("df") * FREQUENT >= total).select("term").collect()]


def write_counted_postings(termed: DataFrame, path: str, frequent: list[str]) -> None:
    """As ``write_postings``, with ``n_terms`` of the document and ``df``, null for ``frequent`` terms, whose postings may spread over files.

    All postings of any other term come to one task, which counts them as it writes them: nothing is joined for their idf.
    """
    rows = termed.select("doc_id", "n_terms", F.explode("posts").alias("p")).select("p.term", "doc_id", "p.tf", "p.positions", "n_terms")
    write_counted(rows, path, frequent)


def write_counted(rows: DataFrame, path: str, frequent: list[str]) -> None:
    """Postings ranged and sorted by term and document, with ``df`` as ``write_counted_postings`` has it."""
    columns = [c for c in rows.columns if c != "tf"]  # tf is the number of positions, so it need not be shuffled
    rows = rows.select(*columns).withColumn("place", F.when(F.col("term").isin(frequent), F.col("doc_id")) if frequent else F.lit(None).cast(rows.schema["doc_id"].dataType))
    ranged = rows.repartitionByRange("term", "place").sortWithinPartitions("term", "place", "doc_id")
    df = F.count(F.lit(1)).over(Window.partitionBy("term", "place"))
    counted = ranged.withColumn("df", F.when(~F.col("term").isin(frequent), df) if frequent else df)
    tf = F.size("positions").alias("tf")
    counted.select("term", "doc_id", tf, "positions", *(c for c in counted.columns if c not in ("term", "doc_id", "positions", "place"))).write.mode("overwrite").option("compression", "zstd").parquet(path)


def shard(term: Column) -> Column:
    """First letter a-z, or # for all else."""
    return F.when(term.rlike("^[a-z]"), F.substring(term, 1, 1)).otherwise(F.lit("#"))


def corpus_stats(doc_stats: DataFrame) -> DataFrame:
    """One row: ``n_docs`` and the floored mean length ``avg_dl``."""
    return doc_stats.agg(F.count(F.lit(1)).alias("n_docs"), F.floor(F.sum("n_terms") / F.count(F.lit(1))).cast("long").alias("avg_dl"))


def dictionary(postings: DataFrame, n_docs: int) -> DataFrame:
    """``term, df, cf, idf``; idf is log2 of the floored N/df, rounded half-even to two places."""
    counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return counted.withColumn("idf", idf_of(n_docs))


def idf_of(n_docs: int) -> Column:
    return F.bround(F.log2(F.floor(F.lit(n_docs) / F.col("df"))), 2)


def doc_stats(termed: DataFrame, *others: str | Column) -> DataFrame:
    """``doc_id, n_terms, n_distinct, max_tf`` of every row of ``tokenised``, from its own arrays, and ``others`` of its columns; zeros for those without terms."""
    own = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = F.aggregate("posts", F.lit(0), lambda s, p: s + p["tf"]), F.size(F.coalesce("posts", F.array().cast(termed.schema["posts"].dataType))), F.array_max(F.transform("posts", lambda p: p["tf"]))
    return termed.select("doc_id", *(own(c).alias(n) for c, n in zip(sums, ("n_terms", "n_distinct", "max_tf"))), *others)


def with_stats(rows: DataFrame) -> DataFrame:
    """The rows of ``tokenised`` with what ``doc_stats`` gives of them, so that no later step reads their arrays for it."""
    own = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.withColumns({"n_terms": own(F.size("terms")), "n_distinct": own(F.size("posts")), "max_tf": own(F.array_max("posts.tf"))})


def with_idf(postings: DataFrame, dictionary: DataFrame, by_document: DataFrame | None = None) -> DataFrame:
    """``term, doc_id, tf, idf``. Terms with a ``FREQUENT``-th of all postings, that many at most, are broadcast, so no task gets all postings of one; the rest is joined.

    Frequent terms are read from ``by_document`` if it is given: the same postings, those of a document together.
    """
    names = frequent_terms(dictionary)
    posts, idf = postings.select("term", "doc_id", "tf"), dictionary.select("term", "idf")
    frequent = F.col("term").isin(names)
    if not names:
        return posts.join(idf, "term")
    often = posts if by_document is None else by_document.select("term", "doc_id", "tf")
    return posts.filter(~frequent).join(idf.filter(~frequent), "term").unionByName(often.filter(frequent).join(F.broadcast(idf.filter(frequent)), "term"))


def doc_norms(postings: DataFrame, dictionary: DataFrame, doc_stats: DataFrame, by_document: DataFrame | None = None) -> DataFrame:
    """``doc_id, doc_norm``: length of the idf-weighted relative-frequency vector, four places half-even. Postings are summed by document before its length is joined.

    With ``by_document`` (see ``with_idf``) the sums of frequent terms meet before they are shuffled: a range of terms has few postings of one document.
    """
    return norms_of(with_idf(postings, dictionary, by_document), doc_stats)


def norms_of(rows: DataFrame, doc_stats: DataFrame) -> DataFrame:
    """``doc_id, doc_norm`` of the postings ``doc_id, tf, idf``."""
    x = F.col("idf") * F.col("tf")
    summed = rows.groupBy("doc_id").agg(F.sum(x * x).alias("squares"))
    norm = F.bround(F.sqrt("squares") / F.col("n_terms"), 4)
    return summed.join(doc_stats.select("doc_id", "n_terms"), "doc_id").select("doc_id", norm.alias("doc_norm"))


def counted_norms(counted: DataFrame, dictionary: DataFrame, doc_stats: DataFrame, frequent: list[str]) -> DataFrame:
    """As ``doc_norms``, of what ``write_counted_postings`` wrote: idf of all but the frequent terms comes with their postings."""
    own = counted.filter("df IS NOT NULL").select("doc_id", "tf", idf_of(doc_stats.count()).alias("idf"))
    if frequent:
        idf = dictionary.filter(F.col("term").isin(frequent)).select("term", "idf")
        own = own.unionByName(counted.filter("df IS NULL").join(F.broadcast(idf), "term").select("doc_id", "tf", "idf"))
    return norms_of(own, doc_stats)


def field_postings(termed: DataFrame, field: str) -> DataFrame:
    """``term, doc_id, field, tf`` of the column ``field_posts``."""
    return termed.select("doc_id", F.explode("field_posts").alias("p")).select("p.term", "doc_id", F.lit(field).alias("field"), "p.tf")


def bigrams(termed: DataFrame, skip_last: bool = False, stem: bool = False) -> DataFrame:
    """``term, next_term, cnt``. Pairs are cut from each row's array, so nothing is shuffled to find neighbours.

    ``skip_last`` leaves out each document's last pair, as the original did. With ``stem`` the first
    term of a pair is its stem and the next one stays as it is.
    """
    followers = F.slice("terms", 2, F.greatest(F.size("terms") - (2 if skip_last else 1), F.lit(0)))
    pairs = F.zip_with(F.slice("terms", 1, F.size(followers)), followers, lambda a, b: F.struct(a.alias("term"), b.alias("next_term")))
    out = termed.select(F.explode(pairs).alias("p")).groupBy("p.term", "p.next_term").agg(F.count(F.lit(1)).alias("cnt"))
    if not stem:
        return out
    key = F.when(F.col("term").rlike("^[a-z]+$"), stem_udf("term")).otherwise(F.col("term"))
    return out.select(key.alias("term"), "next_term", "cnt").groupBy("term", "next_term").agg(F.sum("cnt").alias("cnt"))


def top_next(bigrams: DataFrame, k: int = 5) -> DataFrame:
    """``term, rank, next_term, cnt``: the k most frequent successors of each term, ties by term."""
    w = Window.partitionBy("term").orderBy(F.desc("cnt"), "next_term")
    return bigrams.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("term", "rank", "next_term", "cnt")


def vocabulary_ranks(dictionary: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows of ``dictionary`` with ``place``: dense positions from 0 in term order, without a window over all rows.

    The vocabulary is ranged into sorted partitions and numbered inside each as it is written; the
    partitions' sizes (one row each) give the offsets.
    """
    spark = dictionary.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = dictionary.repartitionByRange(n, "term").sortWithinPartitions("term")
    inside = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranks")
    sizes = inside.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return inside.join(F.broadcast(offsets), "part").select(*dictionary.columns, (F.col("offset") + F.col("k")).alias("place"))


def display(dictionary: DataFrame) -> DataFrame:
    """``value``: the dictionary as lines in display order, each letter's entries, sorted, under one heading; other terms come first."""
    rows = listing(dictionary).withColumn("letter", shard(F.col("term")))
    lines = rows.select("letter", F.lit(1).alias("kind"), "term", F.col("entry").alias("value")).unionByName(
        rows.select("letter", F.lit(0).alias("kind"), F.lit("").alias("term"), F.col("heading").alias("value")).distinct()
    )
    return lines.orderBy("letter", "kind", "term").select("value")


def listing(dictionary: DataFrame) -> DataFrame:
    """``heading, entry``, for display in term order: the first letter (``Numbers and Symbols`` for all else) and ``term : cf``."""
    letter = shard(F.col("term"))
    return dictionary.select(F.when(letter == "#", F.lit("Numbers and Symbols")).otherwise(letter).alias("heading"), "term", F.concat_ws(" : ", "term", "cf").alias("entry"))


def one_row_an_id(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang, header`` without null ids; of rows that share an id the least by text."""
    extra = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "header")]
    one = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra)
    # Only ids are shuffled to see whether any repeats; texts are only where one does.
    if one.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return one
    return one.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "header")).alias("d")).select("doc_id", "d.*")


def tokenised(docs: DataFrame, mode: str = "words", stop_words: tuple[str, ...] = STOP_WORDS, stem: bool = False) -> DataFrame:
    """``doc_id, lang, header, terms, field_terms, posts, field_posts``: one row an id, all that an index is made of.

    With ``stem`` also ``said``, the terms before stemming, as next words show them. ``header`` are its terms joined by spaces.
    """
    kept = (lambda c: F.filter(c, lambda t: ~t.isin(*stop_words))) if stop_words else (lambda c: c)
    of_text = terms(spread(one_row_an_id(docs)), mode, () if stem else stop_words).withColumnRenamed("terms", "said")
    both = terms(of_text, mode, () if stem else stop_words, text="header").withColumnRenamed("terms", "field_terms")
    if stem:
        both = both.select("doc_id", "lang", kept("said").alias("said"), kept(stemmed("said")).alias("terms"), kept(stemmed("field_terms")).alias("field_terms"))
    else:
        both = both.select("doc_id", "lang", F.col("said").alias("terms"), "field_terms")
    both = with_posts(with_posts(both, "terms", "posts"), "field_terms", "field_posts")
    bare = F.transform("field_posts", lambda p: F.struct(p["term"].alias("term"), p["tf"].alias("tf")))
    return both.withColumn("field_posts", bare).withColumn("header", F.array_join("field_terms", " "))


def pairs(tokenised: DataFrame, stem: bool = False) -> DataFrame:
    """``term, next_term, cnt`` of the rows of ``tokenised``: a term as indexed and the one said after it."""
    return bigrams(tokenised.select("doc_id", F.col("said" if stem else "terms").alias("terms")), stem=stem)


def write_sorted(table: DataFrame, path: str, *keys: str) -> None:
    """Ranged and sorted: keys are found by the row groups' statistics, and a frequent key spreads over files."""
    table.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_meta(spark: SparkSession, path: str, mode: str, stem: bool) -> None:
    kinds = T.StructType([T.StructField("mode", T.StringType()), T.StructField("stem", T.BooleanType())])
    spark.createDataFrame([(mode, stem)], kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


@dataclass(frozen=True)
class Index:
    """A written index; queries only read it."""

    postings: DataFrame  # term, doc_id, tf, positions
    dictionary: DataFrame  # term, df, cf, idf, place
    next_words: DataFrame | None  # term, rank, next_term, cnt; none if opened without
    fields: DataFrame  # term, doc_id, field, tf: terms outside the text, so far of the header
    docs: DataFrame  # doc_id, n_terms, n_distinct, max_tf, doc_norm, lang, header (its terms, joined by spaces)
    n_docs: int
    avg_dl: int
    avg_header: float
    mode: str
    stem: bool
    counted: DataFrame | None = None  # term, doc_id, tf, n_terms; none if the postings were merged

    TABLES = ("postings", "dictionary", "next_words", "fields", "docs")

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, mode: str = "words", stop_words: tuple[str, ...] = STOP_WORDS, stem: bool = False, next_words: bool = True) -> Index:
        """Tokenises ``docs(doc_id, text[, lang, header])`` once, writes all tables under ``path``, and opens them; ``next_words``, which no search reads, can be left out.

        Of rows that share a ``doc_id`` one counts, the first by text; rows with a null ``doc_id`` or text have no terms and rows with a null ``doc_id`` are left out.
        With ``stem`` a term is a stop word if its stem is one.
        """
        spark = docs.sparkSession
        path = path or new_path(spark, "index")
        with passing(spark):
            # Tokenised once, for all tables.
            termed = tokenised(docs, mode, stop_words, stem)
            termed = with_stats(termed)
            termed = written(termed if next_words else termed.drop("terms", "said"), "terms", compression="zstd")
            stats = termed.select("doc_id", "n_terms", "n_distinct", "max_tf")
            size = stats.agg(F.count(F.lit(1)).alias("docs"), F.sum("n_distinct").alias("posts")).first()
            with sized(spark, size.posts or 0):
                frequent = frequent_in(termed)
                write_counted_postings(termed, f"{path}/postings", frequent)
                posts = spark.read.parquet(f"{path}/postings")
                vocabulary_ranks(dictionary(posts, size.docs)).write.mode("overwrite").parquet(f"{path}/dictionary")
                dic = spark.read.parquet(f"{path}/dictionary")
                if next_words:
                    write_sorted(written(top_next(pairs(termed, stem)), "next-words"), f"{path}/next_words", "term", "rank")
                write_sorted(field_postings(termed, "header"), f"{path}/fields", "term", "doc_id")
                full = termed.select(*stats.columns, "lang", "header").join(counted_norms(posts, dic, stats, frequent), "doc_id", "left").select(*stats.columns, "doc_norm", "lang", "header")
                full.withColumn("doc_norm", F.coalesce("doc_norm", F.lit(0.0))).write.mode("overwrite").parquet(f"{path}/docs")
        write_meta(spark, path, mode, stem)
        return cls.open(spark, path, next_words)

    @classmethod
    def open(cls, spark: SparkSession, path: str, next_words: bool = True) -> Index:
        """Opens a written index; fails if a table is missing. An index that grows (``segments``) is opened with all that was committed."""
        from sparquill.operators import segments  # which builds on this module

        if segments.grows(spark, path):
            return segments.Segments(spark, path).index()
        posts, dic, following, fields, docs, meta = (spark.read.parquet(f"{path}/{t}") if next_words or t != "next_words" else None for t in (*cls.TABLES, "meta"))
        row, how = corpus_stats(docs).first(), meta.first()
        header = docs.agg(F.avg(F.length("header"))).first()[0] or 1.0
        counted = posts.select("term", "doc_id", "tf", "n_terms") if "n_terms" in posts.columns else None
        return cls(posts.select("term", "doc_id", "tf", "positions"), dic, following, fields, docs, row.n_docs, row.avg_dl or 0, header, how.mode, how.stem, counted)
