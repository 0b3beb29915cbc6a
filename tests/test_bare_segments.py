"""A growing index without next words: the same other tables, postings written by merges only."""

import random

import pytest

from sparquill.operators import segments
from sparquill.operators.index import Index
from sparquill.operators.segments import Segments


@pytest.mark.parametrize("few", [segments.BROADCAST_IDS, 0])
def test_segments_without_next_words_are_a_rebuilt_index(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(segments, "BROADCAST_IDS", few)
    r = random.Random(41)
    rows = [(i, " ".join(r.choices([f"w{chr(97 + k)}" for k in range(20)], k=r.randrange(30))), "en", "wa wb") for i in range(60)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string, header string")
    growing = Segments(spark, str(tmp_path / "growing"), next_words=False)
    growing.add(frame([(i, "wz old", "de", "") for i in range(40)]))
    growing.add(frame(rows[:30]))
    growing.index()
    growing.add(frame(rows[30:]))
    growing.delete(spark.createDataFrame([(3,), (45,)], "doc_id long"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    merged, whole = Index.open(spark, str(tmp_path / "growing")), Index.build(frame([x for x in rows if x[0] not in (3, 45)]))
    assert before == (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.files.maxPartitionBytes"))
    for t in ("postings", "dictionary", "fields", "docs"):
        columns = getattr(whole, t).columns
        assert sorted(map(str, getattr(merged, t).select(columns).collect())) == sorted(map(str, getattr(whole, t).collect()))
    assert merged.next_words is None and {x.name for x in (tmp_path / "growing").iterdir()} == {"meta", "terms", "deleted", "commits", "merged", "merges"}
    assert not Segments(spark, str(tmp_path / "growing")).next_words and not (tmp_path / "growing" / "merged" / "3" / "pairs").exists()
    assert "terms" not in spark.read.parquet(str(tmp_path / "growing" / "terms")).columns
