"""Batches of queries are answered from the pairs that may be among the best, with the rows of full scoring."""

import random

import numpy as np
import pytest

from sparquill.operators import contenders, expansion, ranking
from sparquill.operators.index import Index


@pytest.fixture(scope="module")
def ix(spark, tmp_path_factory):
    r = random.Random(21)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(f"d{i}", " ".join(r.choices(words, weights, k=r.choice((0, 1, 5, 60, 400)))), ["en", "de"][i % 2], "") for i in range(500)]
    rows += [(f"copy{i}", rows[3][1], "en", "") for i in range(9)]  # ties
    return Index.build(spark.createDataFrame(rows, "doc_id string, text string, lang string, header string"), str(tmp_path_factory.mktemp("contenders") / "ix"), next_words=False)


def asked(spark):
    r = random.Random(22)
    texts = ["waa wba wca", "wzd missing waa wbb", "missing waa", "missing", "waa waa wba", *(" ".join(f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(5))}" for _ in range(12)) for _ in range(6))]
    q = expansion.plain(expansion.parsed(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")))
    other = q.filter("query_id IN (0, 5)").selectExpr("query_id", "'other' AS variant_id", "qpos", "concat('w', substring(term, 3, 1), 'c') AS term", "weight + 1 AS weight")
    return q.unionByName(other)


@pytest.mark.parametrize("pairs, held", [(contenders.PAIRS, contenders.HELD), (30, 40)])
def test_contenders_give_the_rows_of_full_scoring(spark, ix, monkeypatch, pairs, held):
    monkeypatch.setattr(contenders, "PAIRS", pairs)
    monkeypatch.setattr(contenders, "HELD", held)
    monkeypatch.setattr(contenders, "TASK_ROWS", 500)
    q = asked(spark)
    for k, languages in ((3, None), (20, ["en"]), (1000, None)):
        expected = sorted(ranking.best(ranking.scored(ix, q, languages), k).collect())
        assert sorted(contenders.search(ix, q, k, languages).collect()) == expected != []


def test_few_pairs_are_scored_whole(spark, ix):
    q = asked(spark)
    every, left = ranking.matches(ix, q).count(), contenders.contenders(ix, q, 3).count()
    assert left < every / 5
    assert contenders.search(ix, q.filter("false")).count() == 0


def test_proximity_is_that_of_the_ranking(spark, ix, monkeypatch):
    """With no pair let go, the sums that the pruning goes by are the scores."""
    seen = {}
    q = asked(spark).filter("variant_id <> 'other'")
    known = contenders.gathered(ranking.distinct_terms(q))[0].join(ix.dictionary, "term", "left").fillna(0.0, ["idf"]).select("query_id", "variant_id", "qpos", "term", "weight", "df", "idf").collect()
    own = contenders.Asked(known, ix)
    numbers = {t: i for i, t in enumerate(own.terms)}
    posts = [p for p in ix.postings.filter(ix.postings.term.isin(own.terms)).join(ix.docs.select("doc_id", "n_terms", "doc_norm"), "doc_id").orderBy("doc_id").collect()]
    table = contenders.pa.Table.from_pylist([{"doc_id": p.doc_id, "number": numbers[p.term], "tf": p.tf, "positions": p.positions, "n_terms": p.n_terms, "doc_norm": p.doc_norm} for p in posts])
    scores, made, _ = contenders.contending(table, own, np.full((10_000, len(own.length)), -np.inf))
    for s, d, v in zip(scores, made["doc_id"].to_pylist(), made["variant"].to_pylist()):
        seen[own.variants[v][1], d] = s
    full = {(r.query_id, r.doc_id): r.bm25 + r.cosine * ranking.COSINE_WEIGHT + r.proximity for r in ranking.scored(ix, q).collect()}
    assert seen == pytest.approx(full, abs=1e-9) and len(full) > 1000
