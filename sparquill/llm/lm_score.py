"""Language-model scores: a gated recurrent model over frequent words, and an add-one unigram base.

Words are runs without ASCII white space, A-Z in lower case; every text ends with one end token.

*Counts.* All training texts are counted; the table of counts grows with the corpus and stays
distributed. Only the most frequent words, ``hot`` at most (a parameter), are broadcast; occurrences of other
words join the table by word. Such words are rare by choice, so no key of that join is hot.

*Symbols.* One pass turns every text into the symbols of the network (the ``symbols`` most frequent
words, the end and "other") and its rare words. Training and scoring read that table, not the texts.

*Model.* A word that is no symbol costs log P(other | state) plus its add-one share among such
words, so the model is a proper distribution over whole texts with one unseen word. The recurrent
network (``gru``) starts from the unigram model of the symbols and learns from all training texts,
each once, by parameter averaging: texts are dealt by their hash to replicas of about
``replica_tokens`` tokens, so neither files nor partitions shape the model; in each round every
replica trains on its own texts, and the mean of the round's replicas, weighted by symbols, starts
the next. Rounds grow by factors of four from ``FIRST`` replicas on, so their number grows with the
logarithm of the corpus and the early, cheap ones take the weights away from their start.

*Scores.* Documents are scored in one pass with the state carried from first to last symbol.

Defined results: a null text is empty and costs its end token; a null ``doc_id`` is in no held-out
fold; without training texts both scores come from uniform models; repeated rows are each scored;
whole texts are read, in memory that follows the symbols held, not the longest text; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.llm import gru
from sparquill.storage import passing, written

HOT = 50_000
SYMBOLS, CLASSES, HIDDEN = 1024, 32, 16
REPLICA_TOKENS = 2_000_000
FIRST, GROWTH = 2, 4  # replicas of the first round, and by how much each round is larger than all before it
HELD_WORDS = 300_000  # distinct words a task counts before it lets them go
HELD_TOKENS = 3_000_000  # symbols a task gathers before it scores them
MERGERS = 16
LEVEL = "CAST(floor(log2(n) * 8) AS INT)"


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (bytes) and ``n`` over all rows of ``texts(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0)[at : at + 256].to_pylist():
                    held.update(words_of(text))
                if len(held) > HELD_WORDS:
                    yield _counted(held)
                    held.clear()
        if held:
            yield _counted(held)

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


class Vocabulary:
    """What scoring needs to know of the counts: totals, and the hot words with their symbols."""

    def __init__(self, counts: DataFrame, n_docs: int, hot: int, symbols: int, classes: int):
        totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        # Levels of log2(count), eight to a factor of two: a few hundred rows tell which levels fit into ``hot`` words together.
        sizes = {r.level: r.n for r in counts.groupBy(F.expr(LEVEL).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
        self.level, taken = max(sizes, default=0) + 1, 0
        for level in sorted(sizes, reverse=True):
            if taken + sizes[level] > hot:
                break
            self.level, taken = level, taken + sizes[level]
        frequent = counts.filter(F.expr(LEVEL) >= self.level).collect()
        top = sorted(((bytes(r.word), r.n) for r in frequent), key=lambda p: (-p[1], p[0]))
        self.train_tokens = totals.n + n_docs
        self.distinct = totals.v + (n_docs > 0)
        own = top[: symbols - 2]
        others = totals.n - sum(n for _, n in own)
        self.other_tokens, self.other_distinct = others, totals.v - len(own)
        ranked = sorted([(-others, b""), (-n_docs, b"\n"), *((-n, w) for w, n in own)])  # neither b"" nor b"\n" is a word
        number = {w: i for i, (_, w) in enumerate(ranked)}
        self.other, self.end, self.n_symbols = number[b""], number[b"\n"], len(ranked)
        self.symbol_counts = np.array([-n for n, _ in ranked], float)
        self.classes = min(classes, self.n_symbols)
        self.index = {w: i for i, (w, _) in enumerate(top)}
        self.log_counts = np.log10(np.array([n for _, n in top] + [0], float) + 1)  # the last is that of a word not in ``top``
        self.symbol = np.array([number.get(w, self.other) for w, _ in top] + [self.other], np.int32)
        self.end_log_count = math.log10(n_docs + 1)

    def encoded(self, words: list[bytes]) -> np.ndarray:
        """Index of each word among the hot ones; -1 for others."""
        get = self.index.get
        return np.fromiter((get(w, -1) for w in words), np.int32, len(words))

    def symbols(self, at: np.ndarray) -> np.ndarray:
        return np.append(self.symbol[at], np.int32(self.end)).astype(np.uint16)


def _packed(weights: dict) -> bytes:
    return b"".join(weights[k].astype(np.float32).tobytes() for k in sorted(weights))


def _unpacked(data: bytes | np.ndarray, like: dict) -> dict:
    flat, out, at = np.frombuffer(data, np.float32) if isinstance(data, bytes) else data.astype(np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def rounds(replicas: int, first: int = FIRST, growth: int = GROWTH) -> list[tuple[int, int]]:
    """Replica numbers of each round, from and to; the last round is the largest."""
    out = [(0, first if replicas > 2 * first else replicas)]
    while out[-1][1] < replicas:
        done = out[-1][1]
        out.append((done, growth * done if 2 * growth * done <= replicas else replicas))
    return out


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A row for each of ``docs(doc_id, training, text)``: sums of log counts, ``symbols`` (16 bits each) and rare words (``tail``)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of parameter size
    schema = "row long, doc_id long, held_out boolean, n_tokens long, logs double, other_logs double, n_other long, tail array<binary>, symbols binary"
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for row, doc_id, is_training, text in zip(*(c[at : at + 256].to_pylist() for c in batch.columns), strict=True):
                    words = words_of(text)
                    index = v.encoded(words)
                    own = v.symbols(index)
                    logs = v.log_counts[index]
                    other = own[:-1] == v.other
                    tail = [words[i] for i in np.flatnonzero(index < 0)]
                    rows.append((row, doc_id, not is_training, len(words) + 1, float(logs.sum()) + v.end_log_count, float(logs[other].sum()), int(other.sum()), tail, own.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "training", "text").mapInArrow(run, schema)


def dealt(texts: DataFrame, replicas: int) -> DataFrame:
    """``replica, place, symbols`` of the training texts, each replica's texts together and in the order of their hashes."""
    place = F.xxhash64("doc_id", "symbols")
    parts = min(replicas, max(4 * texts.sparkSession.sparkContext.defaultParallelism, replicas // 16))
    return texts.filter("NOT held_out").select(F.pmod(place, F.lit(replicas)).alias("replica"), place.alias("place"), "symbols").repartition(parts, "replica").sortWithinPartitions("replica", "place", "symbols")


def trained(texts: DataFrame, weights: dict, replicas: int) -> dict:
    """The mean of the models that the ``replicas`` of ``texts``, rows of ``dealt``, train from ``weights``."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def summed(parts: Iterator[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        total, seen = None, 0
        for part, n in parts:
            total, seen = part * n if total is None else total + part * n, seen + n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([(total / seen).astype(np.float32).tobytes()]), pa.array([seen], pa.int64())], names=["weights", "n"])

    def models(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        def model() -> tuple[np.ndarray, int]:
            p, _, n = gru.train(shared.value, held)
            return np.frombuffer(_packed(p), np.float32).astype(np.float64), n

        now, held = None, []
        for batch in batches:
            for replica, symbols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and replica != now:
                    yield model()
                    held = []
                now = replica
                held.append(np.frombuffer(symbols, np.uint16))
        if held:
            yield model()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield np.frombuffer(w, np.float32).astype(np.float64), n

    schema = "weights binary, n long"
    means = texts.select("replica", "symbols").mapInArrow(lambda batches: summed(models(batches)), schema)
    for width in (w for w in (MERGERS**2, MERGERS) if w < replicas):
        means = means.repartition(width).mapInArrow(lambda batches: summed(rows(batches)), schema)
    found = means.collect()  # MERGERS rows at most
    if not found:
        return weights
    total = sum(r.n for r in found)
    return _unpacked(sum(np.frombuffer(bytes(r.weights), np.float32).astype(np.float64) * (r.n / total) for r in found), weights)


def scores(docs: DataFrame, training: Column, hot: int = HOT, symbols: int = SYMBOLS, classes: int = CLASSES, hidden: int = HIDDEN, replica_tokens: int = REPLICA_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for ``docs(doc_id, text)``; ``training`` is a condition on its columns."""
    docs = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("training"))
    seen = docs.filter("training")
    counts = written(word_counts(seen.select("text")), "word-counts")
    vocabulary = Vocabulary(counts, seen.select("doc_id").count(), hot, symbols, classes)
    texts = written(encoded(docs, vocabulary), "lm-encoded")
    weights = gru.initial(vocabulary.n_symbols, vocabulary.classes, hidden, vocabulary.symbol_counts)
    if vocabulary.train_tokens:
        replicas = -(-vocabulary.train_tokens // replica_tokens)
        with passing(docs.sparkSession):
            training_texts = written(dealt(texts, replicas), "lm-training")
            for low, high in rounds(replicas):
                weights = trained(training_texts.filter((F.col("replica") >= low) & (F.col("replica") < high)), weights, high - low)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of parameter size
    plain = ["row", "doc_id", "held_out", "n_tokens", "logs", "other_logs", "n_other", "n_tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored() -> pa.RecordBatch:
            model = gru.score(shared.value, symbols_of) / math.log(10)
            return pa.RecordBatch.from_arrays([*pa.concat_batches(parts).columns, pa.array(model)], names=[*plain, "model"])

        parts, symbols_of, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                symbols_of += [np.frombuffer(x, np.uint16) for x in some.column(len(plain)).to_pylist()]
                parts.append(some.select(plain))
                held += sum(map(len, symbols_of[-some.num_rows :]))
                if held > HELD_TOKENS:
                    yield scored()
                    parts, symbols_of, held = [], [], 0
        if parts:
            yield scored()

    schema = "row long, doc_id long, held_out boolean, n_tokens long, logs double, other_logs double, n_other long, n_tail int, model double"
    every = texts.withColumn("n_tail", F.size("tail")).select(*plain, "symbols").mapInArrow(run, schema)
    rare = counts.filter(F.expr(LEVEL) < vocabulary.level)
    tail = texts.select("row", F.explode("tail").alias("word")).join(rare, "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("tail_logs"), F.count(F.lit(1)).alias("tail_known"))
    out = every.join(tail, "row", "left").withColumn("tail_logs", F.coalesce("tail_logs", F.lit(0.0)))
    n, v = vocabulary.train_tokens, vocabulary.distinct
    known = F.col("n_tokens") - F.col("n_tail") - (0 if n else 1) + F.coalesce("tail_known", F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        known.cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("tail_logs") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("model") + F.col("other_logs") + F.col("tail_logs") - F.col("n_other") * math.log10(vocabulary.other_tokens + vocabulary.other_distinct + 1)).alias("score"),
    )
