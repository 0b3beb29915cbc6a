"""Benchmark decontamination by size-partitioned MinHash containment search.

The sketch of a test item is its shingle of least hash under each of ``probes`` permutations. Under
any permutation that shingle is a uniform draw from the item's shingles, so a document that
contains the share c of the item holds it with probability c: a symmetric signature would drown a
short item in a long document, this one does not depend on the document's length. Items are
partitioned by size (powers of two); a document is searched for the partitions that it is large
enough to contain ``percent`` of. A document with any sketched shingle of an item is a candidate, and
candidates are confirmed by exact containment of the item's shingles, words compared as text.

At 80 percent and 16 probes a contained item is missed with probability 0.2**16, under 1e-11.

An item with fewer words than a shingle is one shingle, its whole sequence of words, and is contained
where that sequence occurs.

The sketches and items are broadcast in blocks of at most ``block_items`` items. Of several blocks
one is in flight at a time: its finds are written before the next is collected, so driver, broadcast
and tasks hold one block, whatever the benchmark's size.

Words are split at ASCII white space, A-Z taken as lower case and ASCII punctuation left out.

Defined results: null or blank texts and items match nothing; repeated rows of an item id or of a
document give one result row each with the row they belong to; a null ``doc_id`` or ``item_id`` is
carried as null; whole texts are searched; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm import hashing
from sparquill.llm.columns import documents
from sparquill.operators.index import vocabulary_ranks
from sparquill.storage import passing, written

SHINGLE, PERCENT, PROBES = 5, 80, 16
BLOCK_ITEMS = 20_000
SEED = 97

# The ASCII punctuation that is left out.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def plain(text: str) -> bytes:
    return text.encode().translate(None, PUNCTUATION.encode()).lower()


def exact_shingles(text: bytes, n: int) -> set[bytes]:
    """Shingles as text; none where there are fewer words."""
    w = text.split()
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def sketches(items: list[tuple[int | None, str]], n: int, probes: int) -> dict:
    """For each shingle length its sorted sketched hashes with the item of each; the items' ids, lengths, exact shingles and size partitions."""
    rng = np.random.default_rng(SEED)
    a = (rng.integers(0, 1 << 63, probes, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
    b = rng.integers(0, 1 << 63, probes, dtype=np.uint64)[:, None]
    exact, lengths, found = [], [], {}
    for i, (_, text) in enumerate(items):
        text = plain(text)
        lengths.append(min(n, len(text.split())))
        exact.append(exact_shingles(text, lengths[-1]) if lengths[-1] else set())
        if exact[-1]:
            s = hashing.distinct_shingles(text, n)
            least = np.unique(s[hashing.mix(a * s + b).argmin(axis=1)])
            found.setdefault(lengths[-1], []).append((least, np.full(len(least), i)))
    tables = {}
    for length, parts in found.items():
        hashes, owners = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        tables[length] = hashes[order], owners[order]
    sizes = np.array([len(e) for e in exact] or [0])
    return {"tables": tables, "lengths": lengths, "exact": exact, "ids": [i for i, _ in items], "partition": np.floor(np.log2(np.maximum(sizes, 1))).astype(int)}


def _looked_up(grams: np.ndarray, offsets: np.ndarray, table: tuple, bits: np.ndarray, candidates: dict[int, set[int]]) -> None:
    """Adds the items any of whose sketched hashes is among ``grams`` to the candidates of the text that has it."""
    sketched, owners = table
    maybe = np.flatnonzero(bits[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
    place = np.searchsorted(sketched, grams[maybe])
    hit = (place < len(sketched)) & (sketched[np.minimum(place, len(sketched) - 1)] == grams[maybe])
    for where, p in zip(np.searchsorted(offsets, maybe[hit], side="right") - 1, place[hit], strict=True):
        q = p
        while q < len(sketched) and sketched[q] == sketched[p]:
            candidates.setdefault(int(where), set()).add(int(owners[q]))
            q += 1


def _block(docs: DataFrame, items: DataFrame, n: int, percent: int, probes: int) -> DataFrame:
    found = sketches([(r.item_id, r.text) for r in items.collect()], n, probes)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        # A bit for each possible low part of a sketched hash turns most shingles away before the sorted search.
        bits = {length: np.zeros(1 << 20, bool) for length in m["tables"]}
        for length, (sketched, _) in m["tables"].items():
            bits[length][(sketched & np.uint64(0xFFFFF)).astype(np.int64)] = True
        least_size = np.ceil(percent / 100 * 2.0 ** m["partition"])  # of a document, for each item
        for batch in batches:
            out: list[tuple[int | None, int | None, int, int]] = []
            for at in range(0, batch.num_rows, 512):
                ids = batch.column(0)[at : at + 512].to_pylist()
                texts = [plain(t) for t in batch.column(1)[at : at + 512].to_pylist()]
                for first, some in hashing.slices(texts):
                    words, offsets = hashing.word_hashes(some)
                    candidates: dict[int, set[int]] = {}
                    for length, table in m["tables"].items():
                        if len(words) >= length:  # shingles across two texts are confirmed away below
                            _looked_up(hashing.shingle_hashes(words, length), offsets, table, bits[length], candidates)
                    for where, whose in sorted(candidates.items()):
                        own: dict[int, set[bytes]] = {}
                        for i in sorted(whose):
                            length = m["lengths"][i]
                            if offsets[where + 1] - offsets[where] - length + 1 < least_size[i]:
                                continue
                            if length not in own:
                                own[length] = exact_shingles(some[where], length)
                            shared_n, size = len(own[length] & m["exact"][i]), len(m["exact"][i])
                            if 100 * shared_n >= percent * size:
                                out.append((ids[first + where], m["ids"][i], shared_n, size))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_shared", "n_item"])

    return docs.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long")


def contained(docs: DataFrame, items: DataFrame, n: int = SHINGLE, percent: int = PERCENT, probes: int = PROBES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item`` for each document that contains ``percent`` of an item's shingles, or more."""
    docs = documents(docs)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = max(1, -(-items.count() // block_items))
    if blocks == 1:
        return _block(docs, items, n, percent, probes)
    # Items are numbered in the order of their hash, so each block has ``block_items`` at most, repeated rows included.
    with passing(docs.sparkSession) as keep:
        numbered = written(vocabulary_ranks(items.withColumn("term", F.xxhash64("item_id", "text"))), "items")
        block = F.floor(F.col("place") / block_items)
        found = [keep(written(_block(docs, numbered.filter(block == i), n, percent, probes), "contained")) for i in range(blocks)]
    return reduce(DataFrame.unionAll, found)


def oracle(n: int = SHINGLE, percent: int = PERCENT) -> str:
    """The same rows in SQL, from all shared shingles."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    marks = PUNCTUATION.replace("'", "''")

    words = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}{marks}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
WITH docs AS (SELECT doc_id, {words} AS w FROM documents), items AS (SELECT item_id, {words} AS w FROM benchmark),
lengths AS (SELECT DISTINCT least({n}, len(w)) AS m FROM items WHERE len(w) > 0),
d AS (SELECT doc_id, m, unnest(list_distinct(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')))) AS g FROM docs, lengths WHERE len(w) >= m),
sets AS (SELECT item_id, least({n}, len(w)) AS m, list_distinct(list_transform(range(1, len(w) - least({n}, len(w)) + 2), lambda i: array_to_string(w[i:i + least({n}, len(w)) - 1], ' '))) AS s FROM items WHERE len(w) > 0),
i AS (SELECT item_id, m, len(s) AS n_item, unnest(s) AS g FROM sets)
SELECT doc_id, item_id, count(*) AS n_shared, n_item FROM d JOIN i USING (m, g)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= {percent} * n_item
"""
