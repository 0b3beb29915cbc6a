"""The quirk-for-quirk tokenizer over batches."""

from pyspark.sql import functions as F

from sparquill.functions import compat


def test_a_batch_is_tokenised_in_slices(spark):
    rows = [(i, f"Word{i} on 12 May 1994, $ {i} million" if i % 7 else None) for i in range(2 * compat.SLICE + 9)]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    made = {r.i: r.x for r in df.select("i", compat.compat_terms(F.col("t"), ("on",)).alias("x")).collect()}
    assert made == {i: compat.compat_tokens(" " + (t or "").lower(), frozenset({"on"})) for i, t in rows}
    assert df.filter("false").select(compat.compat_terms(F.col("t"))).count() == 0
