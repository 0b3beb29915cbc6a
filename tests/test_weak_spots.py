"""Features that no registered query shows: trimmed titles, stop-word tables, stemmed weights, synonyms, query files."""

import pytest
from pyspark.sql import functions as F

from sparquill.operators import expansion, index, ranking
from sparquill.operators.index import Index
from sparquill.sources import corpus

DOCS = [(1, "walking beta gamma walks", "en", "x"), (2, "beta walking delta", "en", ""), (3, "gamma delta epsilon zeta", "de", None), (4, "big house", "en", None), (5, "large houses", "en", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, header string")


def test_trimmed_titles(spark):
    """Leading and trailing characters of the tags go from the title itself as well."""
    lines = {"<H3> <TI>The Title</TI></H3>": "he title", "<H3> <TI>3 Things</TI></H3>": "ngs", "<H3> <TI>Plain words</TI></H3>": "plain words", "<TI></TI>": ""}

    def trimmed(line):
        a = line.strip("<H3> TI")
        return a.strip("</TIH3<>").lower()

    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", corpus.over_trimmed_title(F.col("line")).alias("t")).collect()
    assert {r.line: r.t for r in rows} == {x: trimmed(x) for x in lines}
    assert trimmed("<H3> <TI>The Title</TI></H3>") == "he title"


def test_stop_words_as_a_table(spark, docs, tmp_path):
    (tmp_path / "stop_words.txt").write_text("beta\ndelta\n beta\ndelta\n")
    stop = corpus.read_stop_words(spark, str(tmp_path / "stop_words.txt"))
    assert {r.term for r in stop.collect()} == {"beta", "delta", " beta"}  # lines as they stand
    toks = index.tokens(index.terms(docs, stop_words=()))
    left = {(r.doc_id, r.pos, r.term) for r in index.without_stop_words(toks, stop).collect()}
    assert left == {(r.doc_id, r.pos, r.term) for r in toks.collect() if r.term not in ("beta", "delta")}
    with pytest.raises(ValueError):
        index.terms(docs, stop_words=tuple(map(str, range(2000))))


def test_stemmed_scores_weigh_the_cosine_in_full(spark, docs):
    built = {stem: Index.build(docs, stem=stem) for stem in (False, True)}
    for stem, weight in ((False, 0.5), (True, 1.0)):
        q = expansion.parsed(spark.createDataFrame([(1, "walking delta")], "query_id int, text string"), stem=stem)
        rows = ranking.scored(built[stem], expansion.plain(q)).collect()
        assert rows and all(r.score == pytest.approx(r.bm25 + weight * r.cosine + r.proximity, abs=6e-4) for r in rows)
    stemmed = {r.doc_id for r in ranking.scored(built[True], expansion.plain(expansion.parsed(spark.createDataFrame([(1, "walk")], "query_id int, text string"), stem=True))).collect()}
    assert stemmed == {1, 2}


def test_synonyms_count_only_if_similar_in_spelling(spark, docs):
    built = Index.build(docs)
    q = expansion.parsed(spark.createDataFrame([(1, "house")], "query_id int, text string"))
    synonyms = spark.createDataFrame([("house", "Houses"), ("house", "large")], "term string, candidate string")
    found = {(r.term, r.candidate) for r in expansion.candidates(q, built, synonyms).collect()}
    assert ("house", "houses") in found and ("house", "large") not in found
    queries = spark.createDataFrame([(1, "house")], "query_id int, text string")
    hits = {r.doc_id for r in expansion.search(built, queries, synonyms=synonyms).collect()}
    assert hits == {4, 5}


def test_query_file_and_queries_without_results(spark, docs, tmp_path):
    built = Index.build(docs)
    (tmp_path / "q.tsv").write_text("351\tbeta walking\n352\tnothing of this kind\n")
    queries = corpus.read_queries(spark, str(tmp_path / "q.tsv"))
    hits = expansion.search(built, queries).collect()
    assert {r.query_id for r in hits} == {351} and {r.doc_id for r in hits} == {1, 2}
    assert expansion.search(built, queries.filter("query_id = 352")).count() == 0


def test_important_words_search(spark, docs):
    """A word the thesaurus does not know is a query of its own, so documents with it alone are found too."""
    built = Index.build(docs)
    queries = spark.createDataFrame([(1, "beta epsilon")], "query_id int, text string")
    thesaurus = spark.createDataFrame([("beta",)], "term string")
    plain = {r.doc_id: r.score for r in expansion.search(built, queries, expand=False).collect()}
    marked = {r.doc_id: r.score for r in expansion.search(built, queries, thesaurus, expand=False).collect()}
    assert set(plain) == set(marked) == {1, 2, 3} and marked[3] != plain[3]


def test_stemmer_equals_its_sql(spark):
    import random

    import duckdb

    from sparquill.functions.porter import stem
    from sparquill.plans.stems import stems_sql

    r = random.Random(8)
    ends = ["ational", "eed", "ed", "ing", "ies", "sses", "y", "ness", "fulli", "ization", "ement", "ion", "e", "ll", "bli", "logi", "alize", "s", "tional", "ive"]
    words = {"".join(r.choices("aeioubcdlstyzw", k=r.randrange(1, 6))) + "".join(r.choices(ends, k=r.randrange(0, 3))) for _ in range(6000)}
    words |= {"caresses", "ponies", "agreed", "plastered", "hopping", "falling", "filing", "sky", "happy", "relational", "conditional", "vietnamization", "electriciti", "controll", "rate", "cease", "probate"}
    con = duckdb.connect()
    con.execute("CREATE TABLE voc (term VARCHAR)")
    con.executemany("INSERT INTO voc VALUES (?)", [(w,) for w in sorted(words)])
    got = dict(con.sql(f"WITH {stems_sql('voc')} SELECT term, stem FROM stems").fetchall())
    assert {w: stem(w) for w in words} == got
