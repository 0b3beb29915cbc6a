"""Posting runs are written where the postings are read, and read back without a shuffle."""

import random

from pyspark.sql import functions as F

from sparquill.operators.index import Index
from sparquill.sources import exports


def rows_of(df):
    return sorted(map(str, df.select("term", F.col("doc_id").cast("string").alias("doc_id"), "tf", "positions").collect()))


def test_runs_are_not_shuffled(spark, tmp_path, monkeypatch):
    r = random.Random(31)
    docs = [(i, " ".join(r.choices(["waa", "été", "wbb", "the", "über", "wcc"], k=r.randrange(40)))) for i in range(300)]
    ix = Index.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "ix"), next_words=False)
    monkeypatch.setattr(exports, "LINE_DOCS", 50)
    assert "Exchange" not in exports.runs_of(ix.postings)._jdf.queryExecution().executedPlan().toString()
    path = str(tmp_path / "runs")
    exports.write_posting_runs(ix, path)
    back = exports.read_posting_runs(spark, path)
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    assert rows_of(back) == rows_of(ix.postings)
    for file in (tmp_path / "runs").rglob("*.txt"):
        lines = file.read_text().split("\n")
        shard = file.parent.name.removeprefix("shard=")
        assert lines.pop() == "" and len(lines) % 2 == 0 and lines[::2] == sorted(lines[::2])
        assert all((t[0] if "a" <= t[0] <= "z" else "%23") == shard and p.endswith(",") and p.count(",") <= 50 for t, p in zip(lines[::2], lines[1::2]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # pairs of lines lie across splits
    try:
        assert rows_of(exports.read_posting_runs(spark, path)) == rows_of(ix.postings)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    exports.write_posting_runs(ix, str(tmp_path / "small"), "gzip")
    assert list((tmp_path / "small").rglob("*.txt.gz")) and rows_of(exports.read_posting_runs(spark, str(tmp_path / "small"))) == rows_of(ix.postings)


def test_runs_with_terms_that_end_with_a_comma(spark, tmp_path):
    (tmp_path / "runs" / "shard=%23").mkdir(parents=True)
    (tmp_path / "runs" / "shard=%23" / "part.txt").write_text("5,\n1 2 0 3,2 1 4,\n6\n7 1 1,\n")
    got = {(x.term, x.doc_id, x.tf, tuple(x.positions)) for x in exports.read_posting_runs(spark, str(tmp_path / "runs")).collect()}
    assert got == {("5,", "1", 2, (0, 3)), ("5,", "2", 1, (4,)), ("6", "7", 1, (1,))}
