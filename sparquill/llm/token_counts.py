"""Token counts by dynamic programming shared over a trie of pre-tokens.

A text falls into pre-tokens at ASCII white space, each led by the word mark. The count of a
pre-token is that of its best segmentation into vocabulary pieces: the one of greatest summed log
probability and, among equals, of fewest tokens. The forward score of a prefix does not depend on
what follows, so the distinct pre-tokens of a batch are put into a trie, the forward step is taken
once per trie node, and terminal nodes keep their counts. A node needs only the scores on its own
path, so the trie is walked depth first, in sorted order, and holds one path at a time.

A character that no piece covers costs one token per UTF-8 byte (byte fallback).

The public vocabulary file lists its pieces by merge order, without probabilities; the log
probability of a piece is taken as ``-log(rank + 1)`` (Zipf's law on that order). The driver reads
the file, whose size is fixed, and broadcasts its pieces.

Defined results: a null or blank text has 0 pre-tokens and 0 tokens; repeated rows are each
counted; whole texts are counted; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparquill.llm.columns import documents

MARK = "▁"
CACHE_WORDS = 400_000


def read_pieces(path: str) -> dict[str, float]:
    """Log probability of each ordinary piece of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {piece: -math.log(rank + 1) for rank, piece in enumerate(ordinary, 1)}


class TrieCounter:
    """Best-segmentation token counts of pre-tokens."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.fallback = min(pieces.values(), default=0.0) - 10.0
        self.known: dict[bytes, int] = {}

    def learn(self, words: set[bytes]) -> None:
        """Adds the counts of new pre-tokens: one forward step per node of their trie."""
        get, longest = self.pieces.get, self.longest
        score, count = [0.0], [0]  # along the path from the root to the current node
        path = ""
        for word in sorted(words):
            text = MARK + word.decode()
            shared = 0
            for a, b in zip(path, text, strict=False):
                if a != b:
                    break
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                n_bytes = len(text[end - 1].encode())
                best, tokens = score[-1] + self.fallback * n_bytes, count[-1] + n_bytes
                for start in range(max(0, end - longest), end):
                    p = get(text[start:end])
                    if p is not None:
                        s = score[start] + p
                        if s > best or (s == best and count[start] + 1 < tokens):
                            best, tokens = s, count[start] + 1
                score.append(best)
                count.append(tokens)
            path = text
            self.known[word] = count[-1]

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """Tokens and pre-tokens of each text."""
        words = [t.encode().split() for t in texts]
        new = {w for ws in words for w in ws if w not in self.known}
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = {w for ws in words for w in ws}
        self.learn(new)
        known = self.known
        return [(sum([known[w] for w in ws]), len(ws)) for ws in words]


_counters: dict[str, TrieCounter] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 1024) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``n_pretokens`` of every whole text; ``rows`` texts share a trie."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = TrieCounter(pieces.value)
        counter = _counters[path]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), rows):
                pairs = counter.counts(texts[at : at + rows].to_pylist())
                yield pa.RecordBatch.from_arrays([ids[at : at + rows], pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["doc_id", "n_tokens", "n_pretokens"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")
