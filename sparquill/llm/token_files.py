"""Token ids as files: Simple-8b words in segments, in the order of the documents' ids.

The folder of a corpus holds one file a task of the write, in Parquet, so that Spark's commit protocol
keeps whole files and any store will do. A row is a segment: whole documents of one task, in order,
of about ``SEGMENT_IDS`` ids together.

========== ======================================================================================
shard      task that wrote the segment; shards go up with the documents' ids
first      ids of the shard before this segment
doc_ids    ids of the segment's documents, ascending
sizes      number of token ids of each, its end id included
words      Simple-8b: 64-bit words, little-endian
block_at   index in ``words`` of each block's first word; a block is ``BLOCK_IDS`` token ids
escapes    64-bit values, little-endian, that do not fit a word
========== ======================================================================================

The upper four bits of a word are its selector: how many ids share its other 60 bits, lowest first.
Selector 0 is an escape: the word holds the place of one value in ``escapes``. A block begins with a
word of its own and is padded, so blocks decode on their own, and all words of one selector decode at
once. To pack, each place takes the selector of most ids of which all fit; that is looked up for every
place at once, and one walk from word to word picks the places.

The vocabulary is read from the tokenizer file of the ``tokenizers`` library and gives that library's ids;
``tiktoken`` computes them from its ranks, five times faster (see ``read_ranks`` for why they are equal).

Defined results: a null text is empty; an empty text has the end id only; null document ids come
first; rows that share an id are ordered by a hash of the text, equal rows follow each other in any
order; an empty table gives a folder without segments; whole texts are encoded, whatever their length;
extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.llm.bpe import byte_alphabet
from sparquill.llm.columns import documents
from sparquill.llm.memory import releasing
from sparquill.storage import new_path, written_to

U = np.uint64
#: Ids in a word by selector; each takes 60 // n bits. Selector 0 is the escape, 1 is not used.
PER_WORD = (1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 0
DATA_BITS = 60
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 18
#: Fixed value: the split pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "shard int, first long, doc_ids array<long>, sizes array<long>, words binary, block_at array<int>, escapes binary"


def packed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, each block's first word, and escapes."""
    ids, n = ids.astype(U), len(ids)
    blocks = -(-n // BLOCK_IDS)
    # A block a row, padded with zeros: they always fit, so words at its end may reach beyond it.
    grid = np.zeros((blocks, BLOCK_IDS + max(PER_WORD)), U)
    grid[: n // BLOCK_IDS, :BLOCK_IDS] = ids[: n // BLOCK_IDS * BLOCK_IDS].reshape(-1, BLOCK_IDS)
    grid[n // BLOCK_IDS :, : n % BLOCK_IDS] = ids[n // BLOCK_IDS * BLOCK_IDS :]
    selector = np.full((blocks, BLOCK_IDS), ESCAPE, np.uint8)
    most, span = grid, 1  # greatest of the ``span`` ids from each place on
    for s in range(len(PER_WORD) - 1, 1, -1):  # from few wide ids to many narrow ones; no count is over twice the last
        count = PER_WORD[s]
        if count > span:
            most, span = np.maximum(most[:, : span - count], most[:, count - span :]), count
        fits = most[:, :BLOCK_IDS] < U(1) << U(DATA_BITS // count)
        if not fits.any():
            break
        selector[fits] = s
    selector = selector.reshape(-1)[:n]
    end = np.minimum(np.arange(1, blocks + 1) * BLOCK_IDS, n).repeat(BLOCK_IDS)[:n]  # of each place's block
    step = np.minimum(np.array(PER_WORD, np.int64)[selector], end - np.arange(n)).tolist()
    places, i = [], 0
    while i < n:
        places.append(i)
        i += step[i]
    at = np.array(places, np.int64)
    chosen = selector[at]
    words = np.empty(len(at), U)
    padded = np.concatenate((ids, np.zeros(max(PER_WORD), U)))
    for s in np.unique(chosen).tolist():
        of = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[of] = np.arange(len(of), dtype=U)
            continue
        count, bits = PER_WORD[s], DATA_BITS // PER_WORD[s]
        lanes = at[of, None] + np.arange(count)
        value = np.where(lanes < end[at[of], None], padded[lanes], U(0)) << (np.arange(count, dtype=U) * U(bits))
        words[of] = np.bitwise_or.reduce(value, axis=1) | (U(s) << U(DATA_BITS))
    return words, np.searchsorted(at, np.arange(0, n, BLOCK_IDS)), ids[at[chosen == ESCAPE]]


def unpacked(words: np.ndarray, block_at: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of consecutive whole blocks (the last may be short)."""
    out = np.empty(n, U)
    selector = (words >> U(DATA_BITS)).astype(np.int64)
    before = np.cumsum(np.array(PER_WORD)[selector]) - np.array(PER_WORD)[selector]
    sizes = np.diff(np.append(block_at, len(words)))
    block = np.arange(len(block_at)).repeat(sizes)
    place = before - before[block_at][block] + block * BLOCK_IDS
    end = np.minimum((block + 1) * BLOCK_IDS, n)
    for s in np.unique(selector).tolist():
        of = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[place[of]] = escapes[words[of].astype(np.int64)]
            continue
        count, bits = PER_WORD[s], DATA_BITS // PER_WORD[s]
        values = (words[of, None] >> (np.arange(count, dtype=U) * U(bits))) & U((1 << bits) - 1)
        lanes = place[of, None] + np.arange(count)
        inside = lanes < end[of, None]
        out[lanes[inside]] = values[inside]
    return out


class Segment:
    """A segment as read from a file."""

    def __init__(self, doc_ids: np.ndarray, sizes: np.ndarray, words: bytes, block_at: np.ndarray, escapes: bytes):
        self.doc_ids, self.sizes, self.block_at = doc_ids, sizes, block_at
        self.words, self.escapes = np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8")
        self.n = int(sizes.sum())

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Token ids ``start`` to ``stop`` of the segment; only their blocks are decoded."""
        stop = self.n if stop is None else stop
        if start >= stop:
            return np.zeros(0, U)
        low, high = start // BLOCK_IDS, -(-stop // BLOCK_IDS)
        first = self.block_at[low]
        last = self.block_at[high] if high < len(self.block_at) else len(self.words)
        base = low * BLOCK_IDS
        got = unpacked(self.words[first:last], self.block_at[low:high] - first, self.escapes, min(high * BLOCK_IDS, self.n) - base)
        return got[start - base : stop - base]

    def document(self, k: int) -> np.ndarray:
        """Token ids of the segment's document ``k``."""
        start = int(self.sizes[:k].sum())
        return self.ids(start, start + int(self.sizes[k]))


def read_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Rank of each token's bytes and the special tokens of a byte-level tokenizer file.

    Merging by the rank of the merged bytes gives what merging by the rank of the pair gives, if ids follow
    the order of the merges (checked here) and every token's bytes encode to that token (a test): adjacent parts that
    cover a token's bytes have come about as in that token alone, so they are its own pair.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"]
    if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        raise ValueError("not a plain byte-level vocabulary")
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        raise ValueError("ids do not follow the order of the merges")
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}, special


class Encoder:
    """Token ids of whole texts. Texts the fast encoder cannot take go to the library whose file it is."""

    def __init__(self, path: str):
        import tiktoken

        ranks, special = read_ranks(path)
        self.path, self.library = path, None
        self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # its pattern engine gives up on some very long runs
            from tokenizers import Tokenizer

            self.library = self.library or Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None) -> str:
    """Encodes every text of ``docs``, adds ``end_id`` to each, and writes the folder; returns its path.

    ``vocabulary`` is a tokenizer file that all machines have at the same place.
    """
    path = path or new_path(docs.sparkSession, "token-files")
    tie = F.xxhash64("text")
    ordered = documents(docs).withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, first = TaskContext.get().partitionId(), 0
        if vocabulary not in _encoders:  # a worker keeps its encoder across tasks
            _encoders[vocabulary] = Encoder(vocabulary)
        held: list[tuple[int | None, np.ndarray]] = []
        n = 0

        def segment() -> pa.RecordBatch:
            words, block_at, escapes = packed(np.concatenate([x for _, x in held]))
            columns = [
                pa.array([shard], pa.int32()),
                pa.array([first], pa.int64()),
                pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
                pa.array([[len(x) for _, x in held]], pa.list_(pa.int64())),
                pa.array([words.tobytes()], pa.binary()),
                pa.array([block_at], pa.list_(pa.int32())),
                pa.array([escapes.tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "first", "doc_ids", "sizes", "words", "block_at", "escapes"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(_encoders[vocabulary].encode(text.as_py()), np.uint32(end_id))
                held.append((doc_id.as_py(), ids))
                n += len(ids)
                if n >= SEGMENT_IDS:
                    yield segment()
                    held, first, n = [], first + n, 0
        if held:
            yield segment()

    written_to(ordered.mapInArrow(releasing(run), SCHEMA), path)
    return path


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, with ``start``: the ids of all segments before."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    # One row a shard: as many as the write had tasks.
    shards = rows.select("shard", F.expr("aggregate(sizes, 0L, (s, x) -> s + x)").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(offsets), "shard").withColumn("start", F.col("before") + F.col("first")).drop("before")


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, Segment]]:
    for start, doc_ids, sizes, words, block_at, escapes in zip(*(batch.column(c) for c in range(6)), strict=True):
        yield start.as_py(), Segment(doc_ids.values, sizes.values.to_numpy(), words.as_buffer(), block_at.values.to_numpy().astype(np.int64), escapes.as_buffer())


_READ = ("start", "doc_ids", "sizes", "words", "block_at", "escapes")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, tokens``: every document's ids (array of long), read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, s in _segments(batch):
                ends = np.concatenate(([0], np.cumsum(s.sizes)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s.ids().view(np.int64)))
                yield pa.RecordBatch.from_arrays([s.doc_ids, pa.array(start + ends[:-1]), pa.array(s.sizes), lists], names=["doc_id", "start", "n_tokens", "tokens"])

    return read_segments(spark, path).select(*_READ).mapInArrow(releasing(run), "doc_id long, start long, n_tokens long, tokens array<long>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: the crc32 of a document's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, s in _segments(batch):
                ends = np.concatenate(([0], np.cumsum(s.sizes)))
                raw = memoryview(s.ids().astype("<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in itertools.pairwise(ends.tolist())]
                yield pa.RecordBatch.from_arrays([s.doc_ids, pa.array(start + ends[:-1]), pa.array(s.sizes), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_segments(spark, path).select(*_READ).mapInArrow(releasing(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
