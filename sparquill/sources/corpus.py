"""Reading corpora: tagged document files, stop lists, query batches, thesauri, web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Misspelt languages and what they stand for.
LANGUAGE_FIXES = {
    "rusian": "russian", "russia": "russian", "span": "spanish", "spansih": "spanish",
    "tigrigna": "tigrinya", "trigrigna": "tigrinya", "trigrignya": "tigrinya",
    "engligh": "english", "enhglish": "english", "enlgish": "english", "eng": "english",
}


def read_tagged(spark: SparkSession, path: str, skip: str = "stop_words") -> DataFrame:
    """``doc_id, title, lang, text`` of all files of a directory but those with ``skip`` in their path.

    Spark cuts the files at each document's end mark, so a file of any size is never one row.
    """
    raw = spark.read.option("lineSep", "</TEXT>").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return tagged(raw.filter(~F.col("path").contains(skip)))


def tagged(chunks: DataFrame) -> DataFrame:
    """The documents in ``chunks(value)``, each the text of one document up to its end mark.

    Text lines are lower-cased and joined by spaces, with one space in front; blank lines go. Lines
    with a language or article type before the first other line of the body are not text. A chunk
    without an id, or without a body, is no document. Documents that share an id all come; an index
    counts one of them.
    """
    rows = chunks.select(F.regexp_replace("value", "\r", "").alias("value"))
    head, body = F.regexp_extract("value", r"(?s)^(.*?)<TEXT>", 1), F.regexp_extract("value", r"(?s)<TEXT>[^\n]*(.*)$", 1)
    lines = F.split(body, "\n")
    preamble = r"Language: <F|Article Type:|<F P=105>"
    # Everything before the first line that is neither blank nor preamble goes.
    flags = F.transform(lines, lambda x: (F.trim(x) != "") & ~x.rlike(preamble))
    first = F.array_position(flags, True)
    text_lines = F.when(first > 0, F.slice(lines, first.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    text = F.concat_ws("", F.transform(F.filter(text_lines, lambda x: x != ""), lambda x: F.concat(F.lit(" "), F.lower(x))))
    # The language stands in the head or the preamble; a mark in running text is none.
    opening = F.when(first > 0, F.slice(lines, 1, first.cast("int") - 1)).otherwise(lines)
    language = F.regexp_extract(F.concat_ws("\n", head, opening), r"<F P=105>([^<\n]*)(?:</F>)?", 1)
    out = rows.filter(F.col("value").contains("<TEXT>")).select(
        F.regexp_replace(F.regexp_extract(head, r"<DOCNO>([^<\n]*)</DOCNO>", 1), " ", "").alias("doc_id"),
        F.lower(F.trim(F.regexp_extract(head, r"<TI>([^\n]*?)(?:</TI>|\n|$)", 1))).alias("title"),
        clean_language(language).alias("lang"),
        text.alias("text"),
    )
    return out.filter("doc_id <> ''")


def clean_language(raw: Column) -> Column:
    """Lower case, without surrounding spaces and a closing non-letter; null if empty or a number."""
    s = F.regexp_replace(F.lower(F.trim(raw)), r"\P{L}$", "")
    return F.when((s == "") | s.try_cast("double").isNotNull(), F.lit(None)).otherwise(s)


def normal_language(lang: Column) -> Column:
    """The first word, cut at ``language``, with known misspellings put right."""
    word = F.regexp_replace(F.element_at(F.split(F.lower(lang), " "), 1), "language.*$", "")
    fixes = F.create_map(*(F.lit(x) for pair in LANGUAGE_FIXES.items() for x in pair))
    return F.coalesce(F.get(F.array(fixes[word]), F.lit(0)), word)


def over_trimmed_title(line: Column) -> Column:
    """The title as the original trimmed it, by character set: leading t, i, h and 3 of the title itself go as well."""
    return F.lower(F.btrim(F.btrim(line, F.lit("<H3> TI")), F.lit("</TIH3<>")))


def page_titles(pages: DataFrame) -> DataFrame:
    """``page_id, title, lang`` of raw web pages."""
    return pages.select(
        "page_id",
        F.lower(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))).alias("title"),
        clean_language(F.regexp_extract("html", r'(?i)<html[^>]* lang="([^"]*)"', 1)).alias("lang"),
    )


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """``term``, one per line, as it stands."""
    return spark.read.text(path).select(F.col("value").alias("term")).distinct()


def read_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """``term``, one per line; only membership counts."""
    return read_stop_words(spark, path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, text`` from lines of id, tab, query."""
    return spark.read.schema("query_id int, text string").option("sep", "\t").option("quote", "").csv(path)


def languages(docs: DataFrame) -> DataFrame:
    """Distinct languages, sorted for display."""
    return docs.select("lang").filter("lang IS NOT NULL").distinct().orderBy("lang")
