"""Line deduplication by a segment-partition edit join.

Lines within ``edits`` insertions, deletions or substitutions are linked. If a line is split into
``edits + 1`` segments, a line that close to it must contain one of the segments unchanged, at a
place bounded by the lengths and the segment's number. So each distinct line is indexed by
(length, segment number, segment) and probes, for each shorter or equal length in reach, the few
substrings that the bounds allow. Pairs that meet are thinned by letter counts inside the join
(one edit changes them by two at most) and verified on the text by banded bit-parallel edit
distance. Linked lines form classes; of a class the first line, by document id and line number,
stays and all others are dropped.

Lines are compared without leading and trailing ASCII white space. How many edits link two lines
follows from the shorter one: one for each ``per_edit`` characters, ``edits`` at most, so a line
under ``per_edit`` characters is linked by equality alone, as an edit would make any such lines alike.
Equality is that of a 128-bit hash of the line.

Only distinct lines take part in the join, so a line that fills a third of the corpus is one row in
it. What is decided on a line comes back to its occurrences by a join in which frequent lines are
broadcast (``joined_by_frequency``), so no task gets all rows of one. The same holds for large classes.

Defined results: a null or empty text has no lines; blank lines have no class and are never
dropped; a null ``doc_id`` sorts after all others; rows with equal id and text get equal decisions;
rows of one id with different texts are separate documents; very long lines are compared whole;
extra columns are ignored, or carried by ``without_repeated_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.llm.columns import documents
from sparquill.llm.components import components
from sparquill.llm.frequent import joined_by_frequency
from sparquill.llm.memory import releasing
from sparquill.storage import passing, written

digest = xxhash.xxh3_64_intdigest  # of the UTF-8 form of a text

EDITS = 2
PER_EDIT = 12
ASCII_SPACE = " \t\n\x0b\f\r"
# Frequent letters whose counts thin out the pairs.
COUNTED = "etaoinsrhldcumfp"
LETTER_PLACES = tuple((c, 4 * k) for k, c in enumerate(COUNTED))
LAST_ID = (1 << 63) - 1
BROADCAST_IDS = 500_000


def line_ids(lines: list[str]) -> np.ndarray:
    """The two halves of the 128-bit hash of each line, one row a line."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.int64).reshape(-1, 2)


def allowed(length: int, edits: int, per_edit: int) -> int:
    """Edits that link a line of ``length`` with another as long or longer."""
    return min(edits, length // per_edit)


def letter_counts(line: str) -> int:
    """Counts of the letters, modulo 16, four bits each; unsigned."""
    out, count = 0, line.count
    for c, shift in LETTER_PLACES:
        out |= (count(c) & 15) << shift
    return out


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and size of each of the ``edits + 1`` segments; sizes differ by one at most, the larger last."""
    k = edits + 1
    size, larger = divmod(length, k)
    sizes = [size + (i >= k - larger) for i in range(k)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


@lru_cache(8192)
def index_plan(length: int, edits: int, per_edit: int) -> tuple[tuple[int, int, int], ...]:
    """Start, end and seed of the segments of a line of ``length``; the seed tells length and segment number."""
    k = allowed(length, edits, per_edit)
    return tuple((at, at + size, length * 64 + i) for i, (at, size) in enumerate(segments(length, k))) if k else ()


@lru_cache(8192)
def probe_plan(n: int, edits: int, per_edit: int) -> tuple[tuple[tuple[int, int, int], ...], np.ndarray]:
    """Start, end and seed of the substrings under which lines in reach of one of length ``n`` may be indexed, and which of them look for lines as long.

    Lines in reach are as long or shorter; the bounds on a substring's place are the multi-match-aware ones.
    """
    spans, level = [], []
    for length in range(max(0, n - edits), n + 1):
        shift, k = n - length, allowed(length, edits, per_edit)
        for i, (at, size) in enumerate(segments(length, k) if k and shift <= k else ()):
            low = max(0, at - i, at + shift - (k - i))
            high = min(n - size, at + i, at + shift + (k - i))
            spans += [(start, start + size, length * 64 + i) for start in range(low, high + 1)]
            level += [not shift] * (high + 1 - low)
    return tuple(spans), np.array(level, bool)


def keys_of(line: str, plan: tuple[tuple[int, int, int], ...]) -> list[int]:
    """A key for each substring of the plan; unsigned."""
    return [digest(line[start:end], seed) for start, end, seed in plan]


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is ``edits`` or less: bit-parallel over a band of diagonals."""
    if abs(len(a) - len(b)) > edits:
        return False
    start, end = 0, min(len(a), len(b))
    step = end
    while step:  # the common prefix, by halving steps
        while start + step <= end and a[start : start + step] == b[start : start + step]:
            start += step
        step //= 2
    a, b = a[start:], b[start:]
    end = min(len(a), len(b))
    back, step = 0, end
    while step:
        while back + step <= end and a[len(a) - back - step : len(a) - back] == b[len(b) - back - step : len(b) - back]:
            back += step
        step //= 2
    a, b = a[: len(a) - back], b[: len(b) - back]
    if len(a) < len(b):
        a, b = b, a
    return len(a) <= edits if not b else _banded(a, b, edits)


def _banded(a: str, b: str, k: int) -> bool:
    """``len(a) >= len(b) > 0``. Bit j of the vectors is the row j places below the band's top; the band moves down a row with each column."""
    w = 2 * k + 2
    full = (1 << w) - 1
    top = 1 << (w - 1)
    vp, vn = (full << (w - k - 1)) & full, 0
    across = 1 << (w - 2)
    score, limit = k, 2 * k + len(b) - len(a)
    first = k + 1 - w
    down = max(len(a) - k, 0)
    for i, c in enumerate(b):
        x = 0
        for j in range(max(0, -first), min(w, len(a) - first)):
            if a[first + j] == c:
                x |= 1 << j
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if i < down:
            score += not d0 & top
        else:
            score += bool(hp & across) - bool(hn & across)
            across >>= 1
        if score > limit + k:
            return False
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (d0 >> 1) & hp
        first += 1
    return score <= k


def _lines(text: str) -> list[str]:
    return [x.strip(ASCII_SPACE) for x in text.split("\n")]


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``row``, equal for rows of equal id and text."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, row, line, id, id2``: each line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lines = [_lines(t) for t in part.column(2).to_pylist()]
                number = np.array([i for some in lines for i, x in enumerate(some) if x], np.int32)
                of = np.repeat(np.arange(len(lines)), [sum(map(bool, some)) for some in lines])
                ids = line_ids([x for some in lines for x in some if x])
                own = part.select(["doc_id", "row"]).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(number), pa.array(ids[:, 0]), pa.array(ids[:, 1])], names=["doc_id", "row", "line", "id", "id2"])

    return docs.select("doc_id", "row", "text").mapInArrow(releasing(run), "doc_id long, row long, line int, id long, id2 long")


def distinct_lines(docs: DataFrame, least: int) -> DataFrame:
    """``id, id2, line`` of each distinct line of ``least`` characters or more; repeats within a batch do not leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found = list({x for t in batch.column(0)[at : at + 1024].to_pylist() for x in _lines(t) if len(x) >= least})
                ids = line_ids(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(found, pa.string())], names=["id", "id2", "line"])

    return docs.select("text").mapInArrow(releasing(run), "id long, id2 long, line string").distinct()


def entries(lines: DataFrame, edits: int, per_edit: int, probes: bool) -> DataFrame:
    """``key, id, letters, level`` for each index or probe entry of each line; ``level`` probes look for lines as long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                ids, texts = batch.column(0)[at : at + 4096].to_numpy(), batch.column(1)[at : at + 4096].to_pylist()
                if not texts:
                    continue
                if probes:
                    plans, levels = zip(*(probe_plan(len(x), edits, per_edit) for x in texts), strict=True)
                else:
                    plans = [index_plan(len(x), edits, per_edit) for x in texts]
                keys = np.array([key for x, plan in zip(texts, plans, strict=True) for key in keys_of(x, plan)], np.uint64).view(np.int64)
                letters = np.array([letter_counts(x) for x in texts], np.uint64).view(np.int64)
                each = np.fromiter(map(len, plans), np.int64, len(plans))
                level = np.concatenate(levels) if probes else np.zeros(len(keys), bool)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids, each)), pa.array(np.repeat(letters, each)), pa.array(level)], names=["key", "id", "letters", "level"])

    return lines.select("id", "line").mapInArrow(releasing(run), "key long, id long, letters long, level boolean")


def letter_distance(a: Column, b: Column) -> Column:
    """Summed differences of the packed counts, each the shorter way round modulo 16."""
    total = F.lit(0)
    for k in range(len(COUNTED)):
        d = F.abs(F.shiftright(a, 4 * k).bitwiseAND(15) - F.shiftright(b, 4 * k).bitwiseAND(15))
        total = total + F.least(d, 16 - d)
    return total


def linked_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """``a < b`` with ``a2, b2``: ids of different lines near enough to be linked; exact and complete."""
    with passing(docs.sparkSession) as keep:
        lines = written(distinct_lines(docs, per_edit), "lines")
        index = entries(lines, edits, per_edit, probes=False).select("key", F.col("id").alias("id_a"), F.col("letters").alias("letters_a"))
        probe = entries(lines, edits, per_edit, probes=True).select("key", F.col("id").alias("id_b"), F.col("letters").alias("letters_b"), "level")
        # Two lines of equal length find each other both ways; one way is enough.
        apart = F.when(F.col("level"), F.col("id_a") < F.col("id_b")).otherwise(F.col("id_a") != F.col("id_b"))
        near = apart & (letter_distance(F.col("letters_a"), F.col("letters_b")) <= 2 * edits)
        met = index.join(probe, (index["key"] == probe["key"]) & near)
        pairs = written(met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct(), "line-pairs")
        wanted = written(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), "paired-lines")
        few = wanted.count() <= BROADCAST_IDS
        texts = written(lines.join(F.broadcast(wanted) if few else wanted, "id", "left_semi"), "line-texts")
        both = pairs.join(texts.toDF("a", "a2", "line_a"), "a").join(texts.toDF("b", "b2", "line_b"), "b").select("a", "a2", "b", "b2", "line_a", "line_b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
                good = pa.array([within(x, y, allowed(min(len(x), len(y)), edits, per_edit)) for x, y in pairs], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(good) for c in batch.columns[:4]], names=["a", "a2", "b", "b2"])

        return keep(written(both.mapInArrow(releasing(run), "a long, a2 long, b long, b2 long"), "line-links"))


def line_components(links: DataFrame, lines: DataFrame) -> DataFrame:
    """``id, id2, component`` of all linked ``lines(id, id2)``.

    A line's node is the first half of its hash. Lines that share it, with different second halves, take a
    number made of both, so that they are not taken for one line.
    """
    shared = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    if shared.isEmpty():
        return lines.select("id", "id2").join(components(links).withColumnRenamed("node", "id"), "id")
    marked = lines.select("id", "id2").join(shared.withColumn("both", F.lit(True)), "id", "left")
    nodes = written(marked.select("id", "id2", F.when(F.col("both"), F.xxhash64("id", "id2")).otherwise(F.col("id")).alias("node")), "line-nodes")
    ends = links.join(nodes.toDF("a", "a2", "x"), ["a", "a2"]).join(nodes.toDF("b", "b2", "y"), ["b", "b2"])
    return nodes.join(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), "node").select("id", "id2", "component")


def decisions(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """``row, doc_id, n_lines, n_links, dropped`` for each row of ``keyed`` documents that has a line; ``dropped`` are line numbers from 0.

    ``n_links`` sums, over the document's lines, the other distinct lines each is linked with.
    """
    line = ["id", "id2"]
    with passing(docs.sparkSession) as keep:
        links = linked_lines(docs, edits, per_edit)
        degree = links.select(F.col("a").alias("id"), F.col("a2").alias("id2")).unionAll(links.select("b", "b2")).groupBy(*line).agg(F.count(F.lit(1)).alias("links"))
        degree = written(degree, "linked-lines")
        linked = degree.join(line_components(links, degree), line)
        every = written(occurrences(docs).distinct(), "line-occurrences")
        place = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("d"), "row", "line")
        by_line = every.groupBy(*line).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        classed = written(by_line.join(linked, line, "left"), "line-classes")
        near = classed.filter("component IS NOT NULL")
        of_class = near.groupBy("component").agg(F.min("first").alias("class_first"), F.count(F.lit(1)).alias("members"))
        placed = joined_by_frequency(near, of_class, ["component"], "members", near.count()).select(*line, "n", "links", F.col("class_first").alias("first"))
        alone = classed.filter("component IS NULL AND n > 1").select(*line, "n", F.lit(0).cast("long").alias("links"), "first")
        fate = written(placed.unionByName(alone), "line-fates")
        found = joined_by_frequency(every, fate, line, "n", every.count())
        late = F.when(F.col("first").isNotNull() & (place != F.col("first")), F.col("line"))
        # collect_list passes over nulls: only the numbers of dropped lines are gathered, at most one document's.
        by_row = found.withColumn("late", late).groupBy("row", "doc_id").agg(
            F.count(F.lit(1)).alias("n_lines"), F.sum(F.coalesce("links", F.lit(0))).alias("n_links"), F.sort_array(F.collect_list("late")).alias("dropped")
        )
        return keep(written(by_row, "line-decisions"))


def line_dedup(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """``doc_id, n_lines, n_dropped, n_links, dropped`` of every row of ``docs``."""
    rows = keyed(documents(docs))
    found = decisions(rows, edits, per_edit).withColumnRenamed("doc_id", "own_id")
    out = rows.select("doc_id", "row").join(found, (rows["row"] == found["row"]) & rows["doc_id"].eqNullSafe(found["own_id"]), "left")
    return out.select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """All rows and columns of ``docs``, with ``text`` cut to the lines that stay; ``n_dropped``, a new or replaced column, is the number of those dropped."""
    found = decisions(keyed(documents(docs)), edits, per_edit).filter(F.size("dropped") > 0)
    found = found.select(F.col("row").alias("__row"), F.col("doc_id").alias("__id"), F.col("dropped").alias("__dropped"))
    text, own_id = F.coalesce(F.col("text"), F.lit("")), docs["doc_id"].cast("long")
    joined = docs.join(found, (F.xxhash64(own_id, text) == F.col("__row")) & own_id.eqNullSafe(F.col("__id")), "left")
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    cut = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    kept = [c for c in docs.columns if c not in ("text", "n_dropped")]
    return joined.select(*(docs[c] for c in kept), F.when(F.col("__dropped").isNull(), docs["text"]).otherwise(cut).alias("text"), F.coalesce(F.size("__dropped"), F.lit(0)).alias("n_dropped"))
