"""Files in the original's formats, next to the Parquet tables: documents, dictionary, postings by shard, runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.operators.index import Index, shard
from sparquill.operators.segments import grows
from sparquill.sources.corpus import normal_language

DOC_COLUMNS = ["doc_id", "max_tf", "n_distinct", "n_terms", "lang", "doc_norm", "header"]
#: Documents of a posting line of text.
LINE_DOCS = 100_000
SHARDS = ["#", *map(chr, range(ord("a"), ord("z") + 1))]


def run_lines(results: DataFrame) -> DataFrame:
    """``value``: one line of a run file for each ranked document."""
    return results.select(F.concat_ws(" ", F.col("query_id"), F.lit("0"), F.col("doc_id"), F.col("score"), F.lit("1"), F.lit("3")).alias("value"))


def write_run(results: DataFrame, path: str) -> None:
    """One run file; results are bounded by the top k of each query."""
    run_lines(results.orderBy("query_id", "rank")).coalesce(1).write.mode("overwrite").text(path)


def write_docs(index: Index, path: str) -> None:
    """Comma-separated document lines; the header comes last and may hold commas."""
    index.docs.select(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in DOC_COLUMNS)).alias("value")).write.mode("overwrite").text(path)


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """Document lines with typed columns and normalised languages; a title line is passed over."""
    f = F.split("value", ",", len(DOC_COLUMNS))
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^[^,]*,\d"))
    kinds = ["string", "long", "long", "long", "string", "double", "string"]
    named = [f[i].cast(kind).alias(c) for i, (c, kind) in enumerate(zip(DOC_COLUMNS, kinds, strict=True))]
    return rows.select(*named).withColumn("lang", normal_language(F.col("lang")))


def write_dictionary(dictionary: DataFrame, top_next: DataFrame, path: str) -> None:
    """Lines of term length, term, df, cf, idf and next words, in term order; the length tells where a term with spaces ends."""
    following = top_next.groupBy("term").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "next_term"))), lambda x: x["next_term"]).alias("following"))
    rows = dictionary.join(following, "term", "left")
    line = F.concat_ws(" ", F.length("term"), "term", "df", "cf", "idf", F.to_json(F.coalesce("following", F.array().cast("array<string>"))))
    rows.orderBy("term").select(line.alias("value")).write.mode("overwrite").text(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``term, df, cf, idf, next_terms``."""
    raw = spark.read.text(path)
    n = F.regexp_extract("value", r"^(\d+) ", 1)
    rest = F.expr("substring(value, length(n) + 2)")
    rows = raw.withColumn("n", n).withColumn("rest", rest)
    rows = rows.withColumn("term", F.expr("substring(rest, 1, int(n))")).withColumn("f", F.split(F.expr("substring(rest, int(n) + 2)"), " ", 4))
    return rows.select("term", F.col("f")[0].cast("long").alias("df"), F.col("f")[1].cast("long").alias("cf"), F.col("f")[2].cast("double").alias("idf"), F.from_json(F.col("f")[3], "array<string>").alias("next_terms"))


def write_posting_shards(index: Index, path: str) -> None:
    """Postings partitioned by the first letter; a shard without terms is an empty folder."""
    index.postings.withColumn("shard", shard(F.col("term"))).write.mode("overwrite").partitionBy("shard").parquet(path)
    spark = index.postings.sparkSession
    for name in SHARDS:
        folder = _shard_folder(spark, path, name)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)


def _shard_folder(spark: SparkSession, path: str, name: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path, "shard=" + jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name))


def has_posting_shards(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a readable postings table with all 27 shards and no other."""
    try:
        found = {str(r.shard) for r in spark.read.parquet(path).select("shard").distinct().collect()}
    except Exception as e:  # the path's reader says in many ways that there is no table
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "UNRESOLVED_COLUMN" in str(e):
            return False
        raise
    folders = [_shard_folder(spark, path, name) for name in SHARDS]
    return found <= set(SHARDS) and all(f.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(f) for f in folders)


def posting_lines(index: Index) -> DataFrame:
    """``shard, term, piece, line``: a term's postings as text, ``doc tf position ...`` for each document, closed by a comma each.

    The postings of a frequent term are cut into pieces of about ``LINE_DOCS`` documents, so that no
    row holds an unbounded list; all but its first documents, by id, may stand in any piece.
    """
    entry = F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("tf").cast("string"), F.array_join(F.transform("positions", lambda p: p.cast("string")), " "))
    pieces = F.ceil(F.col("df") / LINE_DOCS)
    sized = index.postings.join(index.dictionary.filter(F.col("df") > LINE_DOCS).select("term", pieces.alias("pieces")), "term", "left")
    cut = sized.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), "pieces"), F.lit(0)))
    lines = cut.groupBy("term", "piece").agg(F.sort_array(F.collect_list(F.struct("doc_id", entry.alias("e")))).alias("entries"))
    return lines.select(shard(F.col("term")).alias("shard"), "term", "piece", F.array_join(F.transform("entries", lambda x: F.concat(x["e"], F.lit(","))), "").alias("line"))


def runs_of(postings: DataFrame) -> DataFrame:
    """``shard, value``: the lines of a run for each task that reads ``postings``, which are sorted by term within it; nothing is shuffled or joined.

    A term's postings are cut after ``LINE_DOCS`` documents, and where a task or a batch of rows ends.
    """
    entry = F.concat(F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("tf").cast("string"), F.array_join(F.transform("positions", lambda p: p.cast("string")), " ")), F.lit(","))
    most = LINE_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                rows = batch.slice(i, most)
                term, entries = rows["term"], rows["entry"]
                starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(term)), pa.int32()), entries.cast(pa.string()))
                named = term.take(pa.array(starts)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([named, pc.binary_join_element_wise(named, pc.binary_join(lists, ""), "\n")], names=["term", "value"])

    return postings.select("term", entry.alias("entry")).mapInArrow(run, "term string, value string").select(shard(F.col("term")).alias("shard"), "value")


def write_posting_runs(index: Index, path: str, compression: str = "none") -> None:
    """Sorted runs as text, by shard: a line with a term, then one with its postings; a term's further pieces repeat both.

    Runs are what a merge of runs expects: lines of one term in several runs are put one after the other.
    """
    runs_of(index.postings).write.mode("overwrite").partitionBy("shard").text(path, compression=compression)
    spark = index.postings.sparkSession
    for name in SHARDS:
        folder = _shard_folder(spark, path, name)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value`` of all text files below a folder; lines count from 0 in each file, whatever the size of its splits."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    ids = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    # Ids go up within a split; the splits' line counts, one row each, give the offsets.
    splits = ids.groupBy("file", "at").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "at", "least", before.alias("before"))
    return ids.join(offsets, ["file", "at"]).select("file", (F.col("id") - F.col("least") + F.col("before")).alias("line_no"), "value")


def parsed_postings(lines: DataFrame) -> DataFrame:
    """``term, doc_id, tf, positions`` of ``lines(term, line)``; a document that stands in several pieces of a term is joined."""
    entries = lines.select("term", F.explode(F.filter(F.split("line", ","), lambda e: F.trim(e) != "")).alias("e")).select("term", F.split(F.trim("e"), " ").alias("p"))
    return entries.select("term", F.col("p")[0].alias("doc_id"), F.col("p")[1].cast("int").alias("tf"), F.slice("p", 3, F.size("p")).cast("array<int>").alias("positions"))


def read_posting_runs(spark: SparkSession, path: str) -> DataFrame:
    """Postings of runs as ``write_posting_runs`` makes them: every other line is a term.

    A posting line ends with a comma, so a comma and a line end part the pairs of lines, each of which is read as one row.
    No term of ``words`` or ``clean`` ends with a comma; runs where one does are read by the numbers of their lines.
    """
    pairs = spark.read.option("recursiveFileLookup", "true").option("lineSep", ",\n").text(path)
    odd = pairs.filter(~F.col("value").rlike(r"\A[^\n]*\n[^\n]*\z"))
    if not odd.isEmpty():
        return parsed_postings(paired_lines(numbered_lines(spark, path)))
    return parsed_postings(pairs.select(F.substring_index("value", "\n", 1).alias("term"), F.substring_index("value", "\n", -1).alias("line")))


def paired_lines(numbered: DataFrame) -> DataFrame:
    """``term, line`` of the rows of ``numbered_lines``, by file: a term and the line behind it."""
    rows = numbered.withColumn("entry", F.floor(F.col("line_no") / 2))
    first = F.col("line_no") % 2 == 0
    return rows.groupBy("file", "entry").agg(F.max(F.when(first, F.col("value"))).alias("term"), F.max(F.when(~first, F.col("value"))).alias("line"))


def read_posting_files(spark: SparkSession, path: str, dictionary: DataFrame) -> DataFrame:
    """Postings of an old folder: a text file for each of the 27 shards, whose lines hold no term.

    ``dictionary(term, line_no)`` points to them, as the old dictionary file does (``read_old_dictionary``).
    The shard is the character before ``.txt`` in the file's name.
    """
    rows = numbered_lines(spark, path).withColumn("shard", F.regexp_extract("file", r"([a-z#]|%23)\.txt$", 1))
    rows = rows.withColumn("shard", F.when(F.col("shard") == "%23", F.lit("#")).otherwise(F.col("shard"))).filter("shard <> ''")
    pointers = dictionary.select("term", F.col("line_no").cast("long").alias("line_no"), shard(F.col("term")).alias("shard"))
    return parsed_postings(pointers.join(rows, ["shard", "line_no"]).select("term", F.col("value").alias("line")))


def read_old_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``term, df, cf, idf, line_no, next_terms`` from lines of term length, term, df, cf, idf, line number and next words."""
    n = F.regexp_extract("value", r"^(\d+) ", 1)
    rows = spark.read.text(path).withColumn("n", n).filter("n <> ''").withColumn("rest", F.expr("substring(value, length(n) + 2)"))
    rows = rows.withColumn("term", F.expr("rtrim(substring(rest, 1, int(n)))")).withColumn("f", F.expr("filter(split(substring(rest, int(n) + 2), ' '), x -> x <> '')"))
    f = F.col("f")
    return rows.select("term", f[0].cast("long").alias("df"), f[1].cast("long").alias("cf"), f[2].cast("double").alias("idf"), f[3].cast("long").alias("line_no"), F.slice("f", 5, F.size("f")).alias("next_terms"))


def clear(spark: SparkSession, path: str) -> None:
    """Deletes an index folder that this engine wrote, and nothing else: it must hold the index tables, or be an index that grows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not grows(spark, path) and not all(fs.exists(jvm.org.apache.hadoop.fs.Path(target, t)) for t in (*Index.TABLES, "meta")):
        raise ValueError(f"{path} is no index of this engine")
    fs.delete(target, True)
