"""Stated results that other tests leave out: ties, very long texts, repeated rows."""

import random

from pyspark.sql import functions as F

from sparquill.llm import decontaminate, language_id, line_dedup, near_dedup, quality


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_equal_languages_go_to_the_one_that_sorts_first(spark):
    text = "some words that both languages have in the same order"
    docs = spark.createDataFrame([(i, text, "bb" if i % 2 else "aa") for i in range(20)] + [(99, text, None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True))
    assert {x.lang_pred for x in language_id.identify(docs, model).collect()} == {"aa"}


def test_near_duplicates_of_very_long_and_of_very_many_equal_texts(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(30_000)]
    changed = list(words)
    for _ in range(300):
        changed[r.randrange(len(changed))] = "changed"
    docs = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words)), (4, " ".join(words[:15_000]))]
    docs += [(100 + i, "the very same short text in many documents of the table") for i in range(3000)] + [(5000 + i, None if i % 2 else " \n") for i in range(500)]
    rows = {x.doc_id: x for x in near_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert len(rows) == len(docs)
    assert [rows[d].component_id for d in (1, 2, 3, 4)] == [1, 1, 1, 4]
    assert {rows[100 + i].component_id for i in range(3000)} == {100}
    assert all(rows[5000 + i].kept and rows[5000 + i].n_shingles == 0 for i in range(500))


def test_lines_of_very_long_texts(spark):
    r = random.Random(4)
    long_line = "".join(r.choices("abcdefgh ", k=200_000)).strip()
    near = long_line[:777] + "X" + long_line[778:]
    many = ["".join(r.choices("abcdefghijklmnop", k=40)) for _ in range(20_000)]
    docs = [(1, long_line), (2, "own text\n" + near), (3, "\n".join(many)), (4, "\n".join(many[:5]) + "\nanother line of its own")]
    got = {x.doc_id: x for x in line_dedup.line_dedup(frame(spark, docs)).collect()}
    assert (got[1].dropped, got[2].dropped, got[3].n_lines, got[4].dropped) == ([], [1], 20_000, [0, 1, 2, 3, 4])


def test_repeated_rows_of_documents_and_items_are_each_searched(spark):
    items = spark.createDataFrame([(7, "one two three four five six"), (7, "one two three four five six"), (8, "not there at all in it")], "item_id long, text string")
    docs = frame(spark, [(1, "zero one two three four five six seven"), (1, "zero one two three four five six seven"), (2, "nothing")])
    found = [(x.doc_id, x.item_id, x.n_shared, x.n_item) for x in decontaminate.contained(docs, items).collect()]
    assert found == [(1, 7, 2, 2)] * 4


def test_rows_of_one_id_are_scored_by_their_own_text(spark):
    texts = [" ".join(f"w{i % 70}" for i in range(60)), " ".join(f"v{i % 5}" for i in range(90)), None]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    rows = quality.quality_rules(frame(spark, [(1, t) for t in texts]), labels).collect()
    assert sorted((x.n_words, x.base_failed) for x in rows) == [(0, True), (60, False), (90, True)]
