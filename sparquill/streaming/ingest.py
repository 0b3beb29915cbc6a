"""A searchable index that grows from a stream of new documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparquill.operators.index import STOP_WORDS, Index
from sparquill.operators.segments import Segments


def ingest(docs: DataFrame, path: str, checkpoint: str, mode: str = "words", stop_words: tuple[str, ...] = STOP_WORDS, once: bool = True, stem: bool = False) -> StreamingQuery:
    """Adds streamed ``docs(doc_id, text[, lang, header])`` to the growing index at ``path``, a batch as a segment.

    A segment has its batch's number and is committed when it is whole, so a batch that is tried again
    after a failure is not counted twice. Of an id in several batches the last one counts.
    ``Index.open`` gives the index of all batches committed so far.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        Segments(batch.sparkSession, path, mode, stop_words, stem).add(batch, batch_id)

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """All postings taken in so far."""
    return Index.open(spark, path).postings
