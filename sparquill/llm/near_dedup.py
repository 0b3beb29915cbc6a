"""MinHash near-duplicates with min-max signatures.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum,
so a signature of given length costs half the hash evaluations; both are unbiased (either agrees
in two sets with their Jaccard similarity as probability), and as they come from opposite ends of
one permutation the estimate varies less than from two permutations.

1. Documents of equal shingle set are one class from the start; its least ``doc_id`` stands for it.
2. Signatures are cut into bands. Of a bucket (equal band values) not all pairs are made: each
   member is linked with the bucket's least and greatest member, and these links are confirmed on
   full shingle sets. The confirmed links give components.
3. Buckets that still hold several components are gone through exactly: members are dealt into
   blocks with their shingle sets, every two blocks of a bucket meet in one task, and links between
   different components are sought on the full sets there. Buckets of one component drop out, as
   most large groups of copies do; no pair leaves a task unless it links, and no pair is capped.

With 65 permutations (130 values in 26 bands of 5), two documents at similarity 0.8 miss all
buckets with probability 3e-5; at higher similarities still less.

Defined results: a null or blank text has no shingles, is linked with nothing and kept; texts with
fewer words than a shingle count as one shingle; of rows that share a ``doc_id`` each is treated
as a document with its own text; a row with a null ``doc_id`` is linked with nothing and kept;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.llm import hashing
from sparquill.llm.columns import documents
from sparquill.llm.components import components
from sparquill.llm.frequent import joined_by_frequency
from sparquill.llm.memory import releasing
from sparquill.storage import passing, written

PERMUTATIONS, BAND, BLOCK = 65, 5, 256
CHUNK = 4096  # shingles permuted at a time, so that long texts need no more memory
SEED = 20_240_607


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None], rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the high halves of ``a*x + b`` under each permutation."""
    low, high = None, None
    for at in range(0, len(shingles), CHUNK):
        x = a * shingles[at : at + CHUNK] + b
        lo, hi = x.min(axis=1), x.max(axis=1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    return np.concatenate((low, high)) >> np.uint64(32)


def band_keys(sig: np.ndarray, band: int) -> np.ndarray:
    """One 64-bit bucket key for each band, its number mixed in."""
    n = len(sig) // band
    rows = sig[: n * band].reshape(n, band)
    out = np.arange(1, n + 1, dtype=np.uint64)
    for k in range(band):
        out = hashing.mix(out * hashing.P + rows[:, k])
    return out.view(np.int64)


def signed(docs: DataFrame, n: int, permutations: int, band: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, set fingerprint ``f1, f2``, and bucket keys of each text (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(permutations)
        for batch in batches:
            ids = batch.column(0)
            for at in range(0, len(ids), 512):
                texts = [hashing.lowered(t) for t in batch.column(1)[at : at + 512].to_pylist()]
                sizes, f1, f2, keys = [], [], [], []
                for _, some in hashing.slices(texts):
                    words, offsets = hashing.word_hashes(some)
                    for i in range(len(some)):
                        s = np.unique(hashing.shingle_hashes(words[offsets[i] : offsets[i + 1]], n))
                        sizes.append(len(s))
                        if not len(s):
                            f1.append(None), f2.append(None), keys.append(None)
                            continue
                        f1.append(int(np.bitwise_xor.reduce(s).view(np.int64)))
                        f2.append(int(hashing.mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                        keys.append(band_keys(signature(s, a, b), band))
                yield pa.RecordBatch.from_arrays(
                    [ids[at : at + 512], pa.array(sizes, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "f1", "f2", "keys"],
                )

    return docs.mapInArrow(releasing(run), "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose full shingle sets reach ``percent``.

    Texts join their pairs by id; a document of many pairs is a skewed key that adaptive execution splits.
    """
    with_b = pairs.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept_set = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                if last != a[i]:  # the pairs of one document follow each other
                    last, kept_set = a[i], hashing.distinct_shingles(hashing.lowered(batch.column(2)[i].as_py()), n)
                other = hashing.distinct_shingles(hashing.lowered(batch.column(3)[i].as_py()), n)
                small, large = sorted((len(kept_set), len(other)))
                if 100 * small < percent * large:
                    continue
                union = len(np.union1d(kept_set, other))
                good[i] = 100 * (small + large - union) >= percent * union
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return both.mapInArrow(releasing(run), "a long, b long")


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id`` and its sorted shingle hashes, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [hashing.distinct_shingles(hashing.lowered(t), n).tobytes() for t in batch.column(1)[at : at + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 256], pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, shingles binary")


def block_links(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` that join different ``component``s of one bucket (``key``), confirmed on the full ``sets(doc_id, shingles)``.

    A component with ``block`` members or more in a bucket is dealt into blocks of its own, the rest
    of the bucket into shared ones, all of about ``block`` members. Each two blocks meet under a key
    of their own, so a task holds two blocks at a time; blocks of one component do not meet, so a
    large group costs its meetings with the others only. Within a meeting, shared shingles are
    counted through an inverted list, and links that close a circle are left out.
    """
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    large, of_block = F.col("n") >= block, lambda n: F.ceil(n / block).cast("int")
    totals = sizes.groupBy("key").agg(
        F.sum("n").alias("members"),
        F.coalesce(of_block(F.sum(F.when(~large, F.col("n")))), F.lit(0)).alias("shared"),
        F.coalesce(F.sum(F.when(large, of_block(F.col("n")))), F.lit(0)).cast("int").alias("owned"),
    )
    # At most one row for ``block`` members of a bucket comes into its window.
    before = F.sum("own").over(Window.partitionBy("key").orderBy("component")) - F.col("own")
    own = sizes.filter(large).withColumn("own", of_block(F.col("n"))).select("key", "component", "n", "own", before.cast("int").alias("before"))
    every = members.count()
    dealt = joined_by_frequency(members, written(totals, "bucket-sizes"), ["key"], "members", every)
    dealt = joined_by_frequency(dealt, written(own, "own-blocks"), ["key", "component"], "n", every).withColumn("first", F.col("shared") + F.coalesce("before", F.lit(0)))
    place = F.xxhash64("doc_id")
    mine = F.when(F.col("own").isNull(), F.pmod(place, F.greatest("shared", F.lit(1)))).otherwise(F.col("first") + F.pmod(place, F.col("own")))
    others = F.filter(F.sequence(F.lit(0), F.col("shared") + F.col("owned") - 1), lambda x: F.col("own").isNull() | (x < F.col("first")) | (x >= F.col("first") + F.col("own")))
    met = dealt.select("key", "doc_id", "component", mine.cast("int").alias("mine"), F.explode(others).alias("other")).join(sets, "doc_id")
    met = met.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("meeting"), "doc_id", "component", "shingles")
    sorted_rows = met.repartition("meeting").sortWithinPartitions("meeting", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _ended(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
                meeting = held.column(0).to_numpy()
                done = int(np.searchsorted(meeting, meeting[-1]))  # the last meeting may go on
            else:
                if held is None:
                    return
                meeting, done = held.column(0).to_numpy(), held.num_rows
            ready, held = held.slice(0, done), held.slice(done)
            if ready.num_rows == 0:
                continue
            meeting, ids, parts = (ready.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero(np.diff(meeting)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if (parts[s:e] != parts[s]).any():
                    links = linked(ids[s:e], parts[s:e], [np.frombuffer(x.as_py(), np.uint64) for x in ready.column(3)[s:e]], percent)
                    if links:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return sorted_rows.mapInArrow(releasing(run), "a long, b long")


def linked(ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, one for each two components that any link joins, directly or over others."""
    sizes = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(code, kind="stable")
    owner_of, start = owner[order], np.searchsorted(code[order], np.arange(code.max() + 2))
    _, group = np.unique(parts, return_inverse=True)
    first = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for i in range(len(ids)):
        if (group == group[i]).all():
            break
        own = code[first[i] : first[i + 1]]
        runs, lengths = start[own], start[own + 1] - start[own]
        at = np.repeat(runs - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner_of[at], minlength=len(ids))
        good = (100 * shared >= percent * (sizes + sizes[i] - shared)) & (group != group[i])
        for j in np.flatnonzero(good):
            if group[j] != group[i]:
                out.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return out


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, then None."""
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def near_duplicates(
    docs: DataFrame,
    n: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    permutations: int = PERMUTATIONS,
    band: int = BAND,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``."""
    docs = documents(docs, id_col, text_col)
    with passing(docs.sparkSession) as keep:
        every = written(signed(docs, n, permutations, band), "signed")
        sets_of = keep(written(every.drop("keys"), "fingerprints"))
        usable = every.filter("doc_id IS NOT NULL AND n_shingles > 0")
        classes = written(usable.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("held_by")), "classes")
        reps = usable.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2", "n_shingles"), ["doc_id", "f1", "f2", "n_shingles"], "left_semi").dropDuplicates(["doc_id", "f1", "f2"])
        entries = written(reps.select("doc_id", F.explode("keys").alias("key")), "entries")
        # Large buckets are broadcast here and below: their rows stay where they are.
        buckets = written(entries.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most"), "buckets")
        n_entries = classes.count() * (2 * permutations // band)
        met = joined_by_frequency(entries, buckets, ["key"], "n", n_entries).filter("least IS NOT NULL")
        shared = written(met.select("key", "doc_id", "least", "most"), "shared")
        nodes = docs.filter("doc_id IS NOT NULL")
        ends = F.array(F.struct(F.least("least", "doc_id").alias("a"), F.greatest("least", "doc_id").alias("b")), F.struct(F.least("most", "doc_id").alias("a"), F.greatest("most", "doc_id").alias("b")))
        star = shared.select(F.explode(ends).alias("e")).select("e.*").filter("a < b").distinct()
        links = written(confirmed(star, nodes, n, percent), "links")
        first = components(links)

        # What the stars left apart: buckets that hold several components.
        labelled = shared.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        labelled = written(labelled, "labelled")
        mixed = labelled.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("m")).filter("c1 < c2 AND m > 3")
        mixed = written(mixed.select("key", "m"), "mixed")
        apart = joined_by_frequency(labelled, mixed, ["key"], "m", labelled.count()).filter("m IS NOT NULL")
        apart = written(apart.select("key", "doc_id", "component"), "apart")
        sets = shingle_sets(nodes.join(apart.select("doc_id").distinct(), "doc_id", "left_semi"), n)
        more = block_links(apart, sets, percent)
        parts = components(links.unionAll(more))

        of_rep = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("f1", "f2", "n_shingles", "held_by", F.coalesce("component", "rep").alias("component"))
        of_rep = keep(written(of_rep, "class-components"))
    # A text that many documents hold is a frequent key; texts without words have none and are not joined.
    worded = joined_by_frequency(sets_of.filter("f1 IS NOT NULL"), of_rep, ["f1", "f2", "n_shingles"], "held_by", of_rep.agg(F.sum("held_by")).first()[0] or 0)
    out = worded.drop("held_by").unionByName(sets_of.filter("f1 IS NULL").withColumn("component", F.lit(None).cast("long")))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def oracle(n: int, percent: int) -> str:
    """The same rows in SQL, from all pairs of documents that share a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) END AS s FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.doc_id = l.a
), least AS (SELECT doc_id, min(root) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, c AS component_id, s.doc_id = c AS kept FROM sets s JOIN least USING (doc_id)
"""
