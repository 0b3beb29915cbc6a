"""Queries: parsing, important words, vocabulary neighbours, variants and their merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions.porter import stem_udf
from sparquill.operators import ranking
from sparquill.operators.index import STOP_WORDS, Index, terms, vocabulary_ranks
from sparquill.operators.lookup import gathered, in_ranges, one_of

# Least similarity of neighbours, and the weight of important words.
LEAST_JACCARD = 0.71
IMPORTANT_WEIGHT = 2
NEIGHBOURS = 2


def char_bigrams(word: Column) -> Column:
    """Distinct character pairs of a word; none for a word of one letter."""
    return F.when(F.length(word) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, 2)))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of the character-pair sets; 0 if they share none."""
    x, y = char_bigrams(a), char_bigrams(b)
    shared = F.size(F.array_intersect(x, y))
    return F.when(shared > 0, shared / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def parsed(queries: DataFrame, mode: str = "words", stop_words: tuple[str, ...] = STOP_WORDS, stem: bool = False) -> DataFrame:
    """``query_id, qpos, term`` of ``queries(query_id, text)``: tokenised as documents are, each term once, in order."""
    tok = terms(queries.select("query_id", "text"), mode, () if stem else stop_words, leading=False).select("query_id", F.posexplode("terms").alias("qpos", "term"))
    if stem:
        tok = tok.withColumn("term", F.when(F.col("term").rlike("^[a-z]+$"), stem_udf("term")).otherwise(F.col("term")))
        tok = tok.filter(~F.col("term").isin(*stop_words)) if stop_words else tok
    first = tok.groupBy("query_id", "term").agg(F.min("qpos").alias("qpos"))
    w = Window.partitionBy("query_id").orderBy("qpos")
    return first.select("query_id", (F.row_number().over(w) - 1).alias("qpos"), "term")


def important(query_terms: DataFrame, thesaurus: DataFrame) -> DataFrame:
    """Query terms that ``thesaurus(term)`` does not know."""
    return query_terms.join(thesaurus.select("term").distinct(), "term", "left_anti")


def neighbours(query_terms: DataFrame, dictionary: DataFrame, reach: int = NEIGHBOURS, least: float = LEAST_JACCARD) -> DataFrame:
    """``term, candidate, step``: vocabulary terms up to ``reach`` places away, similar in spelling. A term outside the vocabulary has none.

    A written dictionary has the places; others are ranked first.
    """
    ranks = (dictionary if "place" in dictionary.columns else vocabulary_ranks(dictionary)).select("term", "place")
    own, near = query_terms.select("term").distinct(), ranks
    asked = gathered(own)
    if asked:  # few terms: the dictionary, sorted by term and so by place, is read where they and their neighbours are
        own, places = gathered(F.broadcast(asked[0]).join(ranks.filter(one_of("term", {r.term for r in asked[1]})), "term"))
        near = ranks.filter(in_ranges("place", [(r.place - reach, r.place + reach) for r in places]))
    else:
        own = own.join(ranks, "term")
    steps = F.array(*(F.lit(k) for k in range(-reach, reach + 1) if k))
    wanted = own.select("term", "place", F.explode(steps).alias("step")).select("term", "step", (F.col("place") + F.col("step")).alias("place"))
    found = wanted.join(near.withColumnRenamed("term", "candidate"), "place")
    return found.filter(jaccard(F.col("term"), F.col("candidate")) >= least).select("term", "candidate", "step")


def stems_in_vocabulary(query_terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``term, candidate``: stems that differ from their term and are in the vocabulary."""
    stems = query_terms.select("term").distinct().withColumn("candidate", F.when(F.col("term").rlike("^[a-z]+$"), stem_udf("term")).otherwise(F.col("term")))
    stems, vocabulary = stems.filter("term <> candidate"), dictionary
    asked = gathered(stems)
    if asked:
        stems, vocabulary = asked[0], dictionary.filter(one_of("term", {r.candidate for r in asked[1]}))
    return stems.join(vocabulary.select(F.col("term").alias("candidate")), "candidate", "left_semi").select("term", "candidate")


def candidates(query_terms: DataFrame, index: Index, synonyms: DataFrame | None = None) -> DataFrame:
    """``term, candidate``: the word itself and, in an unstemmed index, its neighbours and stem; ``synonyms(term, candidate)`` add to them if similar."""
    own = query_terms.select("term", F.col("term").alias("candidate")).distinct()
    if index.stem:
        return own
    out = own.unionByName(neighbours(query_terms, index.dictionary).select("term", "candidate")).unionByName(stems_in_vocabulary(query_terms, index.dictionary))
    if synonyms is not None:
        near = query_terms.select("term").distinct().join(synonyms, "term").filter(jaccard(F.col("term"), F.lower("candidate")) >= LEAST_JACCARD)
        out = out.unionByName(near.select("term", F.lower("candidate").alias("candidate")))
    return out.distinct()


def variants(query_terms: DataFrame, candidates: DataFrame, important_terms: DataFrame | None = None) -> DataFrame:
    """``query_id, variant_id, qpos, term, weight``.

    For each place and candidate, the query with that place rewritten; variants in which a term
    repeats are left out; each important word is a query by itself too, and weighs double everywhere.
    """
    swaps = query_terms.join(candidates, "term").select("query_id", F.col("qpos").alias("place"), "candidate")
    swaps = swaps.withColumn("variant_id", F.concat_ws(":", "place", "candidate"))
    rows = swaps.join(query_terms, "query_id").select("query_id", "variant_id", "qpos", F.when(F.col("qpos") == F.col("place"), F.col("candidate")).otherwise(F.col("term")).alias("term"))
    repeats = rows.groupBy("query_id", "variant_id", "term").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("query_id", "variant_id").distinct()
    rows = rows.join(repeats, ["query_id", "variant_id"], "left_anti")
    if important_terms is None:
        return rows.withColumn("weight", F.lit(1))
    words = important_terms.select("query_id", "term").distinct()
    alone = words.select("query_id", F.concat_ws(":", F.lit("word"), "term").alias("variant_id"), F.lit(0).alias("qpos"), "term")
    marked = words.withColumn("weight", F.lit(IMPORTANT_WEIGHT))
    return rows.unionByName(alone).join(marked, ["query_id", "term"], "left").select("query_id", "variant_id", "qpos", "term", F.coalesce("weight", F.lit(1)).alias("weight"))


def plain(query_terms: DataFrame) -> DataFrame:
    """The query as its only variant."""
    return query_terms.select("query_id", F.lit("0").alias("variant_id"), "qpos", "term", F.lit(1).alias("weight"))


def search(index: Index, queries: DataFrame, thesaurus: DataFrame | None = None, languages: list[str] | None = None, expand: bool = True, k: int | None = ranking.TOP, synonyms: DataFrame | None = None, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``query_id, doc_id, score, rank`` for a batch of ``queries(query_id, text)``: one plan for all variants of all queries."""
    q = parsed(queries, index.mode, stop_words, index.stem)
    marked = important(q, thesaurus) if thesaurus is not None else None
    full = variants(q, candidates(q, index, synonyms), marked) if expand else variants(q, q.select("term", F.col("term").alias("candidate")).distinct(), marked)
    return ranking.best(ranking.scored(index, full, languages), k)


def autocomplete(top_next: DataFrame, typed: str) -> DataFrame:
    """``rank, next_term`` after a word followed by a space; nothing otherwise."""
    words = typed.lower().split(" ")
    word = words[-2] if len(words) > 1 and words[-1] == "" else None
    return top_next.filter(F.col("term") == F.lit(word)).select("rank", "next_term")
