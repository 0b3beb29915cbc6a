"""Scoring: BM25, weighted cosine and ordered-pair proximity, over all variants of all queries at once.

Query terms are few. They are gathered if they number at most ``BROADCAST_TERMS`` (counted, not
assumed): the scans of dictionary and postings then read the row groups of these terms only, and the
terms are broadcast. More terms are joined as the planner sees fit. Only documents with a query term
are ever touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.operators.index import Index
from sparquill.operators.lookup import RANGES, gathered, one_of

# Parameters of the scores.
K1, B, B_PROXIMITY = 1.2, 0.75, 0.5
COSINE_WEIGHT, COSINE_WEIGHT_STEMMED = 0.5, 1.0
HEADER_WEIGHT = 0.4
TOP = 50
BROADCAST_TERMS = 100_000
HEADER_TERMS = 1000

VARIANT = ("query_id", "variant_id")


def distinct_terms(query_terms: DataFrame) -> DataFrame:
    """Each term of a variant once, at its first place; places renumbered from 0."""
    first = query_terms.groupBy(*VARIANT, "term").agg(F.min("qpos").alias("qpos"), F.max("weight").alias("weight"))
    w = Window.partitionBy(*VARIANT).orderBy("qpos", "term")
    return first.withColumn("qpos", F.row_number().over(w) - 1)


def of_terms(table: DataFrame, terms: set[str]) -> DataFrame:
    """The rows of a table sorted by term that have one of the terms, without reading other row groups; of more than ``RANGES`` terms the join that follows tells, as so many tests a row cost more than it saves."""
    return table if len(terms) > RANGES else table.filter(one_of("term", terms))


def matches(index: Index, query_terms: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """One row per variant and candidate document: statistics and a list of its query terms with positions.

    ``query_terms`` is ``query_id, variant_id, qpos, term, weight``. A language filter takes candidates
    away but leaves N and df as they are.
    """
    q, dictionary, postings = distinct_terms(query_terms), index.dictionary, index.postings
    small = gathered(q, BROADCAST_TERMS)
    if small:
        q, rows = small
        dictionary, postings = (of_terms(t, {r.term for r in rows}) for t in (dictionary, postings))
    known = q.join(dictionary, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    if small:  # each posting is shuffled once, to its document, before it meets the queries that have its term; what follows stays there
        wanted = F.broadcast(q.select("term").distinct())
        known, postings = F.broadcast(known), postings.join(wanted, "term", "left_semi").repartition("doc_id")
    hit = postings.join(known, "term")
    docs = index.docs.filter(F.col("lang").isin(*languages)) if languages else index.docs
    grouped = hit.groupBy(*VARIANT, "doc_id").agg(F.sort_array(F.collect_list(F.struct("qpos", "term", "tf", "df", "idf", "weight", "positions"))).alias("hits"))
    of_variant = known.groupBy(*VARIANT).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("qpos", "idf"))), lambda x: x["idf"]).alias("idfs"),
        F.sum(F.col("weight") * F.col("weight")).alias("w2"),
    )
    return grouped.join(docs, "doc_id").join(of_variant, list(VARIANT))


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + f(x))


def bm25(n_docs: int, avg_dl: int) -> Column:
    k = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("n_terms") / F.lit(float(avg_dl)))
    return _sum(F.col("hits"), lambda h: F.log2((n_docs - h["df"] + 0.5) / (h["df"] + 0.5)) * ((K1 + 1) * h["tf"]) / (k + h["tf"]))


def cosine() -> Column:
    """0 where the document's norm is 0."""
    inner = _sum(F.col("hits"), lambda h: h["tf"] / F.col("n_terms") * h["idf"] * h["weight"])
    return F.when(F.col("doc_norm") > 0, inner / (F.col("doc_norm") * F.sqrt(F.col("w2").cast("double")))).otherwise(F.lit(0.0))


def with_proximity(rows: DataFrame, avg_dl: int) -> DataFrame:
    """``rows`` of ``matches`` with ``proximity``, found inside each row.

    A pair of query terms (a before b) counts if b is in the document and so are all query terms from
    the first to a. Of the positions in such pairs, in text order, neighbours that form a pair
    themselves add (idf_a + idf_b) / distance**2; the sum runs on from term to term of the query.
    Every intermediate column is used at least twice, so it is computed once per row and not inlined
    into the loops.
    """
    hits = F.col("hits")
    every = rows.withColumn("prefix", F.size(F.filter(hits, lambda h, i: h["qpos"] == i)))  # terms present from the first on
    places = F.flatten(F.transform(hits, lambda h: F.transform(h["positions"], lambda p: F.struct(p.alias("p"), h["qpos"].alias("q")))))
    ends = F.transform(hits, lambda h: F.struct(h["qpos"].alias("q"), F.array_min(h["positions"]).alias("lo"), F.array_max(h["positions"]).alias("hi")))
    # A single term, or a document without the query's first term, has no pairs and needs no list.
    every = every.withColumn("pairs", (F.size("hits") > 1) & (F.col("prefix") > 0))
    every = every.withColumn("places", F.when(F.col("pairs"), places)).withColumn("ends", F.when(F.col("pairs"), ends))

    def paired(x: Column) -> Column:
        before = (x["q"] < F.col("prefix")) & F.exists("ends", lambda e: (e["q"] > x["q"]) & (e["hi"] > x["p"]))
        after = F.exists("ends", lambda e: (e["q"] < x["q"]) & (e["q"] < F.col("prefix")) & (e["lo"] < x["p"]))
        return before | after

    every = every.withColumn("line", F.when(F.size("places") > 1, F.sort_array(F.filter("places", paired))))
    steps = F.zip_with(
        F.slice("line", 1, F.greatest(F.size("line") - 1, F.lit(0))),
        F.slice("line", 2, F.greatest(F.size("line") - 1, F.lit(0))),
        lambda a, b: F.struct(
            a["q"].alias("a"),
            b["q"].alias("b"),
            ((F.get("idfs", a["q"]) + F.get("idfs", b["q"])) / ((b["p"] - a["p"]).cast("double") * (b["p"] - a["p"]))).alias("gain"),
        ),
    )
    every = every.withColumn("kept", F.filter(steps, lambda s: (s["a"] < s["b"]) & (s["a"] < F.col("prefix"))))
    k = F.lit(K1) * (F.lit(1 - B_PROXIMITY) + F.lit(B_PROXIMITY) * F.col("n_terms") / F.lit(float(avg_dl)))

    def of_term(idf: Column, i: Column) -> Column:
        acc = _sum(F.col("kept"), lambda s: s["gain"] * ((s["a"] <= i).cast("int") + (s["b"] <= i).cast("int")))
        return F.least(F.lit(1.0), idf) * (F.lit(K1 + 1) - (K1 + 1) * k / (acc + k))  # acc*(k1+1)/(acc+k), with acc taken once

    value = F.when((F.size("kept") > 0) & (F.size("idfs") > 1), _sum(F.transform("idfs", of_term), lambda x: x)).otherwise(F.lit(0.0))
    return every.withColumn("proximity", value).drop("prefix", "pairs", "places", "ends", "line", "kept")


def scored(index: Index, query_terms: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """``query_id, variant_id, doc_id, bm25, cosine, proximity, score`` of every candidate; score is rounded half-even to 3."""
    return score_of(index, matches(index, query_terms, languages))


def score_of(index: Index, rows: DataFrame) -> DataFrame:
    """``scored`` of rows of ``matches``."""
    weight = COSINE_WEIGHT_STEMMED if index.stem else COSINE_WEIGHT
    rows = with_proximity(rows, index.avg_dl)
    parts = rows.select(*VARIANT, "doc_id", bm25(index.n_docs, index.avg_dl).alias("bm25"), cosine().alias("cosine"), "proximity")
    return parts.withColumn("score", F.bround(F.col("bm25") + F.col("cosine") * weight + F.col("proximity"), 3))


def best(scores: DataFrame, k: int | None = TOP) -> DataFrame:
    """``query_id, doc_id, score, rank``: each document's best variant, the k best of each query; ties by ``doc_id``. ``None`` keeps all."""
    top = scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = top.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def by_score(results: DataFrame) -> DataFrame:
    """``query_id, score, docs``: the ranked documents of each query that share a score, by id."""
    return results.groupBy("query_id", "score").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))


def occurrences(text: Column, word: Column) -> Column:
    """How often ``word`` starts at some character of ``text``, overlaps included: in one pass, as long texts may be one header."""
    ahead = F.concat(F.lit(r"(?=\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    return F.when(word == "", F.greatest(F.length(text), F.lit(1))).when(F.contains(text, word), F.regexp_count(text, ahead)).otherwise(F.lit(0))


def header_scores(index: Index, query_terms: DataFrame) -> DataFrame:
    """``query_id, doc_id, header_score``: occurrences of the query terms in the header over its relative length; documents without one are left out.

    A query term occurs in a header term as often as it starts at some character of it. So the gathered query terms
    are sought in the vocabulary of the headers, and its terms' field postings are joined by term.
    """
    small = gathered(query_terms.select("query_id", "term").distinct(), HEADER_TERMS)
    if small is None:
        raise ValueError(f"queries of more than {HEADER_TERMS} terms together are scored in blocks")
    headers = index.fields.filter("field = 'header'")
    kind = query_terms.schema["query_id"].dataType.simpleString()
    wanted = F.array(*(F.struct(F.lit(r.query_id).alias("query_id"), F.lit(r.term).alias("word")) for r in small[1])).cast(f"array<struct<query_id:{kind},word:string>>")
    sought = headers.select("term").distinct().select("term", F.explode(F.filter(wanted, lambda w: F.contains(F.col("term"), w["word"]))).alias("w"))
    counted = sought.select("w.query_id", "term", occurrences(F.col("term"), F.col("w.word")).alias("n")).groupBy("query_id", "term").agg(F.sum("n").alias("n"))
    hits = headers.join(counted, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.col("n")).alias("htf"))
    lengths = index.docs.select("doc_id", F.length("header").alias("len"))
    return hits.join(lengths, "doc_id").select("query_id", "doc_id", (F.col("htf") / (F.lit(1.0) + (F.col("len") / F.lit(index.avg_header) - 1.0))).alias("header_score"))


def every_header_score(index: Index, query_terms: DataFrame) -> DataFrame:
    """``query_id, doc_id, header_score`` of every document for every query: 0 where the header has no query term."""
    queries = F.broadcast(query_terms.select("query_id").distinct())
    scores = header_scores(index, query_terms)
    every = index.docs.select("doc_id").crossJoin(queries).join(scores, ["query_id", "doc_id"], "left")
    return every.select("query_id", "doc_id", F.coalesce("header_score", F.lit(0.0)).alias("header_score"))


def bm25f(n_docs: int, avg_dl: int, avg_header: float) -> Column:
    """Header and body combined, over the columns of ``matches`` and ``header``; terms of idf 0 add nothing."""
    header = F.coalesce("header", F.lit(""))

    # Occurrences are counted once a term, before the formula takes them twice.
    counted = F.transform("hits", lambda h: F.struct(h["tf"].alias("tf"), h["idf"].alias("idf"), occurrences(header, h["term"]).alias("htf")))

    def of(h: Column) -> Column:
        body = h["tf"] / (F.col("n_terms") / float(avg_dl))
        head = F.when(F.length(header) > 0, h["htf"] / (F.length(header) / avg_header)).otherwise(0.0)
        both = body * h["tf"] * (1 - HEADER_WEIGHT) + head * h["htf"] * HEADER_WEIGHT
        return F.when(h["idf"] > 0, both / (K1 + both) * F.log2(n_docs / h["idf"])).otherwise(0.0)

    return _sum(counted, of)


def tf_over_max(index: Index, term: str) -> DataFrame:
    """``doc_id, score``: tf over the document's largest tf, five places half-even."""
    hit = index.postings.filter(F.col("term") == term).select("doc_id", "tf")
    return hit.join(index.docs, "doc_id").select("doc_id", F.bround(F.col("tf") / F.col("max_tf"), 5).alias("score"))


def with_all_terms(scores: DataFrame, index: Index, required: DataFrame) -> DataFrame:
    """Scores of documents that hold every term of ``required(query_id, term)``; queries without required terms pass whole."""
    need, postings = required.select("query_id", "term").distinct(), index.postings
    small = gathered(need, BROADCAST_TERMS)
    if small:
        need, postings = F.broadcast(small[0]), of_terms(postings, {r.term for r in small[1]})
    has = postings.select("term", "doc_id").join(need, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("has"))
    n = need.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
    joined = scores.join(n, "query_id", "left").join(has, ["query_id", "doc_id"], "left")
    return joined.filter(F.coalesce("needed", F.lit(0)) == F.coalesce("has", F.lit(0))).select(*scores.columns)
