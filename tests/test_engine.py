import math

import pytest
from pyspark.sql import functions as F

from sparquill.operators import expansion, index, ranking
from sparquill.operators.index import Index
from sparquill.sources import corpus, exports

DOCS = [
    (1, "alpha beta gamma alpha", "en", "alpha head"),
    (2, "beta alpha delta", "en", ""),
    (3, "gamma delta epsilon zeta", "de", "none"),
    (4, "alpha eta theta", "fr", None),
    (5, None, "en", None),
]


@pytest.fixture(scope="module")
def ix(spark):
    return Index.build(spark.createDataFrame(DOCS, "doc_id long, text string, lang string, header string"))


def score(spark, ix, text, **more):
    q = expansion.parsed(spark.createDataFrame([(1, text)], "query_id int, text string"))
    return {r.doc_id: r for r in ranking.scored(ix, expansion.plain(q), **more).collect()}


def brute(docs, query):
    """All three scores by their definitions, position by position."""
    terms = {d: (t or "").split() for d, t, *_ in docs}
    n, avg = len(terms), sum(map(len, terms.values())) // len(terms)
    df = {w: sum(w in t for t in terms.values()) for w in {*query, *(w for t in terms.values() for w in t)}}
    idf = {w: round(math.log2(n // df[w]), 2) if df[w] else 0.0 for w in df}
    out = {}
    for d, t in terms.items():
        if not set(query) & set(t):
            continue
        tf = {w: t.count(w) for w in {*query, *t}}
        k = 1.2 * (0.25 + 0.75 * len(t) / avg)
        bm = sum(math.log2((n - df[w] + 0.5) / (df[w] + 0.5)) * 2.2 * tf[w] / (k + tf[w]) for w in query if df[w])
        norm = round(math.sqrt(sum((idf[w] * t.count(w) / len(t)) ** 2 for w in set(t))), 4)
        cos = sum(tf[w] / len(t) * idf[w] for w in query) / (norm * math.sqrt(len(query))) if norm else 0.0
        pairs = {}
        for i, a in enumerate(query):
            for j in range(i):
                if not (tf[a] and tf[query[j]]):
                    break
                pairs[query[j], a] = [(p, q) for p, x in enumerate(t) if x == query[j] for q, y in enumerate(t) if y == a and p < q]
        line = sorted({p for ps in pairs.values() for pq in ps for p in pq})
        acc, near, kp = 0.0, 0.0, 1.2 * (0.5 + 0.5 * len(t) / avg)
        for w in query:
            for (a, b), ps in pairs.items():
                if w in (a, b):
                    acc += sum((idf[a] + idf[b]) / (q - p) ** 2 for p, q in ps if (p, q) in set(zip(line, line[1:], strict=False)))
            near += min(1, idf[w]) * acc * 2.2 / (acc + kp)
        out[d] = (bm, cos, near if len(query) > 1 else 0.0)
    return out


@pytest.mark.parametrize("query", [["alpha"], ["alpha", "beta"], ["beta", "alpha"], ["gamma", "delta", "alpha"], ["missing", "delta"], ["delta", "missing", "gamma"]])
def test_scores_follow_their_definitions(spark, ix, query):
    expected, got = brute(DOCS, query), score(spark, ix, " ".join(query))
    assert set(got) == set(expected)
    for d, parts in expected.items():
        assert (got[d].bm25, got[d].cosine, got[d].proximity) == pytest.approx(parts)


def test_scores_on_random_texts(spark):
    import random

    r = random.Random(3)
    words = [f"w{c}" for c in "abcdefgh"]
    docs = [(i, " ".join(r.choices(words, k=r.randrange(1, 12))), "en", None) for i in range(40)]
    built = Index.build(spark.createDataFrame(docs, "doc_id long, text string, lang string, header string"))
    for _ in range(6):
        query = r.sample(words, r.randrange(2, 5))
        expected, got = brute(docs, query), score(spark, built, " ".join(query))
        assert set(got) == set(expected)
        for d, parts in expected.items():
            assert (got[d].bm25, got[d].cosine, got[d].proximity) == pytest.approx(parts)


def test_index_sums(ix):
    df = ix.dictionary.agg(F.sum("df"), F.sum("cf")).first()
    assert df[0] == ix.postings.count() and df[1] == ix.docs.agg(F.sum("n_terms")).first()[0]
    assert ix.postings.filter("size(positions) <> tf").count() == 0
    assert (ix.n_docs, ix.docs.filter("doc_id = 5").first().n_terms) == (5, 0)


def test_language_filter_keeps_statistics(spark, ix):
    every, french = score(spark, ix, "alpha"), score(spark, ix, "alpha", languages=["fr"])
    assert set(french) == {4} and french[4].score == every[4].score


def test_next_words(spark):
    termed = index.terms(spark.createDataFrame([(1, "aa bb aa bb aa cc"), (2, "aa")], "doc_id long, text string"))
    rows = {(r.term, r.next_term): r.cnt for r in index.bigrams(termed).collect()}
    assert rows == {("aa", "bb"): 2, ("bb", "aa"): 2, ("aa", "cc"): 1}
    assert ("aa", "cc") not in {(r.term, r.next_term) for r in index.bigrams(termed, skip_last=True).collect()}
    top = index.top_next(index.bigrams(termed), 1)
    assert [r.next_term for r in expansion.autocomplete(top, "say aa ").collect()] == ["bb"]
    assert expansion.autocomplete(top, "say aa").count() == 0


def test_neighbours_and_variants(spark):
    d = spark.createDataFrame([(w,) for w in ("walk", "walked", "walker", "zebra", "zoo")], "term string")
    q = spark.createDataFrame([(1, 0, "walked"), (1, 1, "zebra")], "query_id int, qpos int, term string")
    found = {(r.term, r.candidate) for r in expansion.neighbours(q, d).collect()}
    assert found == set()  # walked and walker share four of six pairs, 0.67
    near = spark.createDataFrame([(w,) for w in ("internationally", "internationals", "zebra")], "term string")
    asked = spark.createDataFrame([("internationals",), ("zebra",)], "term string")
    assert {(r.term, r.candidate, r.step) for r in expansion.neighbours(asked, near).collect()} == {("internationals", "internationally", -1)}  # 11 of 14 pairs 
    own = q.select("term", F.col("term").alias("candidate"))
    swap = spark.createDataFrame([("walked", "zebra"), ("walked", "walker")], "term string, candidate string")
    ids = {r.variant_id for r in expansion.variants(q, own.unionByName(swap)).select("variant_id").collect()}
    assert ids == {"0:walked", "0:walker", "1:zebra"}  # the variant that repeats a term is left out


def test_important_words_weigh_double(spark):
    q = spark.createDataFrame([(1, 0, "alpha"), (1, 1, "beta")], "query_id int, qpos int, term string")
    own = q.select("term", F.col("term").alias("candidate"))
    rows = expansion.variants(q, own, expansion.important(q, spark.createDataFrame([("alpha",)], "term string"))).collect()
    assert {(r.variant_id, r.term, r.weight) for r in rows} == {("0:alpha", "alpha", 1), ("0:alpha", "beta", 2), ("1:beta", "alpha", 1), ("1:beta", "beta", 2), ("word:beta", "beta", 2)}


def test_places_and_next_words_are_written(spark, ix):
    rows = ix.dictionary.orderBy("term").collect()
    assert [r.place for r in rows] == list(range(len(rows))) and rows == sorted(rows, key=lambda r: r.term)
    assert {(r.term, r.next_term, r.cnt) for r in ix.next_words.filter("term = 'alpha'").collect()} == {("alpha", "beta", 1), ("alpha", "delta", 1), ("alpha", "eta", 1)}
    many = spark.createDataFrame([(f"w{i:04}",) for i in range(500)], "term string")
    assert [(r.term, r.place) for r in index.vocabulary_ranks(many, 7).orderBy("place").collect()] == [(f"w{i:04}", i) for i in range(500)]


def test_stemmed_index(spark):
    docs = spark.createDataFrame([(1, "ons walking of walks onward")], "doc_id long, text string")
    built = Index.build(docs, stem=True)
    # "ons" goes because its stem is a stop word; positions count what stays.
    assert sorted((r.term, list(r.positions)) for r in built.postings.collect()) == [("onward", [2]), ("walk", [0, 1])]
    pairs = {(r.term, r.next_term) for r in built.next_words.collect()}
    assert ("walk", "walks") in pairs and ("walk", "onward") in pairs  # stems lead to words as they stand


def test_display_has_one_heading_a_letter(spark):
    d = spark.createDataFrame([("beta", 2), ("alpha", 1), ("9", 4), ("axe", 3), ("\u00e9t\u00e9", 1)], "term string, cf long")
    lines = [r.value for r in index.display(d).collect()]
    assert lines == ["Numbers and Symbols", "9 : 4", "\u00e9t\u00e9 : 1", "a", "alpha : 1", "axe : 3", "b", "beta : 2"]


def test_documents_of_equal_score(spark):
    best = spark.createDataFrame([(1, 7, 2.0, 2), (1, 3, 2.0, 1), (1, 9, 1.0, 3), (2, 4, 2.0, 1)], "query_id int, doc_id long, score double, rank int")
    assert {(r.query_id, r.score, tuple(r.docs)) for r in ranking.by_score(best).collect()} == {(1, 2.0, (3, 7)), (1, 1.0, (9,)), (2, 2.0, (4,))}


def test_compat_queries_have_no_leading_space(spark):
    from sparquill.functions.compat import compat_tokens

    for text in ("5 million dollars", "june 1994 report", "x 10 percent"):
        q = spark.createDataFrame([(1, text)], "query_id int, text string")
        expected = list(dict.fromkeys(compat_tokens(text)))
        assert [r.term for r in expansion.parsed(q, "compat", ()).orderBy("qpos").collect()] == expected


def test_tagged_files(spark, tmp_path):
    body = "<DOC>\n<DOCNO> X 1 </DOCNO>\n<H3> <TI>The Title</TI></H3>\n<F P=105> English1 </F>\n<TEXT>\nLanguage: <F P=105> English </F>\nArticle Type:X\n\nFirst Line\n\nSecond\n</TEXT>\n<DOC>\n<DOCNO> X2 </DOCNO>\n<TEXT>\nbody\n</TEXT>\n"
    (tmp_path / "a").write_text(body)
    (tmp_path / "stop_words.txt").write_text("the\n")
    rows = {r.doc_id: r for r in corpus.read_tagged(spark, str(tmp_path)).collect()}
    assert rows["X1"].text == " first line second" and rows["X1"].title == "the title" and rows["X1"].lang == "english"
    assert rows["X2"].text == " body" and rows["X2"].lang is None
    late = spark.createDataFrame([("<DOCNO> X3 </DOCNO>\n<TEXT>\nsome text\n<F P=105> Greek </F> is quoted\n",)], "value string")
    assert corpus.tagged(late).first().lang is None  # a mark in running text is no language


def test_languages(spark):
    raw = spark.createDataFrame([("Rusian",), ("spansih text",), ("frenchlanguage",)], "raw string")
    assert [r[0] for r in raw.select(corpus.normal_language(F.col("raw"))).collect()] == ["russian", "spanish", "french"]


def test_files_round_trip(spark, ix, tmp_path):
    exports.write_docs(ix, str(tmp_path / "docs"))
    back = {r.doc_id: r for r in exports.read_docs(spark, str(tmp_path / "docs")).collect()}
    assert back["1"].n_terms == 4 and back["1"].header == "alpha head"
    top = spark.createDataFrame([("alpha", 1, "beta gamma", 3)], "term string, rank int, next_term string, cnt long")
    exports.write_dictionary(ix.dictionary, top, str(tmp_path / "dic"))
    dic = {r.term: r for r in exports.read_dictionary(spark, str(tmp_path / "dic")).collect()}
    assert dic["alpha"].df == 3 and dic["alpha"].next_terms == ["beta gamma"] and len(dic) == ix.dictionary.count()
    exports.write_posting_shards(ix, str(tmp_path / "shards"))
    assert exports.has_posting_shards(spark, str(tmp_path / "shards")) and not exports.has_posting_shards(spark, str(tmp_path / "none"))
    import shutil

    shutil.rmtree(tmp_path / "shards" / "shard=q")
    assert not exports.has_posting_shards(spark, str(tmp_path / "shards"))  # one of the 27 is missing
    results = ranking.best(ranking.scored(ix, expansion.plain(expansion.parsed(spark.createDataFrame([(7, "alpha")], "query_id int, text string")))))
    exports.write_run(results, str(tmp_path / "run"))
    assert spark.read.text(str(tmp_path / "run")).first()[0].startswith("7 0 ")
    (tmp_path / "q.tsv").write_text("3\thello \"world\n")
    assert corpus.read_queries(spark, str(tmp_path / "q.tsv")).first().text == 'hello "world'


def test_clear_deletes_only_indexes(spark, tmp_path):
    with pytest.raises(ValueError):
        exports.clear(spark, str(tmp_path))
    Index.build(spark.createDataFrame([(1, "aa bb")], "doc_id long, text string"), str(tmp_path / "ix"))
    exports.clear(spark, str(tmp_path / "ix"))
    assert not (tmp_path / "ix").exists()


def test_streamed_documents(spark, tmp_path):
    from sparquill.streaming.ingest import ingest, ingested

    spark.createDataFrame([(1, "aa bb aa")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.term, r.tf) for r in ingested(spark, str(tmp_path / "out")).collect()} == {("aa", 2), ("bb", 1)}


def test_registered_queries_have_results(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 50


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "bb"), (1, "aa aa"), (None, "cc"), (2, None)], "doc_id long, text string")
    built = Index.build(docs)
    assert {(r.term, r.doc_id, r.tf) for r in built.postings.collect()} == {("aa", 1, 2)} and built.n_docs == 2
    nothing = Index.build(docs.filter("false"))
    assert (nothing.n_docs, nothing.avg_dl) == (0, 0) and not score(spark, nothing, "aa")


def test_neighbours_of_the_whole_dictionary(spark, tmp_path):
    from sparquill.plans import catalog

    texts = ["internal international internationally walking walkings", "nationally nationals zebra zebras walking", "walkingly wal q"]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    words = sorted({w for t in texts for w in t.split()})
    pairs = {w: {w[i : i + 2] for i in range(len(w) - 1)} for w in words}
    alike = lambda a, b: len(pairs[a] & pairs[b]) >= 0.71 * len(pairs[a] | pairs[b]) > 0
    expected = {(a, b, j - i) for i, a in enumerate(words) for j, b in enumerate(words) if 0 < abs(i - j) <= 2 and alike(a, b)}
    found = [tuple(x) for x in catalog.all_queries()["vocab_neighbours"](spark, str(tmp_path)).select("term", "candidate", "step").collect()]
    assert expected and sorted(found) == sorted(expected)
