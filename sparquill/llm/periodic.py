"""Periodic runs of words, by the runs theorem.

A run is a stretch of words with a smallest period q that no neighbouring word extends. Every run
with an exponent of two or more has a Lyndon root: under one of the two opposite orders of the words,
each occurrence of that root is the longest Lyndon word at its place. So the candidates of a text are
two for each word, and a run is found by extending each root to both sides.

* Words become numbers in the order of their hashes, equal hashes verified byte by byte (``scan``);
  any order of the words will do. Texts of one sweep are laid out one after the other, each closed by
  a mark of its own that is smaller than all words.
* The suffix array is made by prefix doubling: three words are one sort key, then only suffixes whose
  rank is shared yet are sorted again. The ranks of each round are kept; they give the LCP array.
* The longest Lyndon word at i ends before the next suffix that is smaller than suffix i: the
  next-smaller value of the inverse suffix array. For the opposite order the next *greater* value
  of the same array does: it is taken for runs that end before a word that differs, where two suffixes
  are told apart by a word, so one order is the other turned round. Runs that end with the text are
  found under the first order, as its closing mark is smallest.
* A root at i of period p extends right by the common prefix of suffixes i and i+p: a minimum of the
  LCP array, from a sparse table. Of the roots of one run the leftmost is extended left in the same
  way in the reversed text; texts without a root that reaches far enough right are not reversed.

Memory is that of the tables, about 8 bytes x words x log2(words) of one sweep, or of a text that is
longer than a sweep.

Defined results: a null text is empty; a text without words has no runs and the collapsed text is
empty; a null ``doc_id`` stays null; repeated rows give a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.llm.columns import documents
from sparquill.llm.hashing import SLICE_BYTES
from sparquill.llm.memory import releasing
from sparquill.llm.scan import differing, range_hashes, sweeps, word_ranges

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
FIRST = 3  # words of the first sort key
JUMPS = 8  # rounds before the rest goes on by minima

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal numbers, dense from 0, for equal words."""
    hashes = range_hashes(data, starts, ends)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    twin = np.flatnonzero(same)
    if differing(data, starts, ends, order[twin], order[twin + 1]).any():  # two words of one hash: number them by their bytes
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(data[s:e].tobytes(), len(seen)) for s, e in zip(starts, ends, strict=True)], np.int64)
    out = np.empty(len(hashes), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], ~same))) if len(hashes) else order
    return out


class Suffixes:
    """Suffix array, its inverse, LCP array and its sparse table, of texts in one row of numbers.

    Each text ends with a number that occurs once and is smaller than all that are no such mark.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.symbols, self.table = np.concatenate((symbols, np.arange(-1, -FIRST, -1))), None
        s = self.symbols
        width = int(symbols.max(initial=0)) + FIRST + 1
        key = s[:n] + FIRST
        if width < 1 << 20:
            for k in range(1, FIRST):
                key = key * width + (s[k : n + k] + FIRST)
        else:  # too many different words for one number: each prefix is ranked before the next word is added
            for k in range(1, FIRST):
                key = np.unique(key, return_inverse=True)[1] * width + (s[k : n + k] + FIRST)
        self.sa = np.argsort(key, kind="stable")
        self.rank = np.empty(n, np.int64)
        self.levels: list[np.ndarray] = []
        self.split = np.zeros(n, np.int8)  # the round in which a suffix was told from the one before it, plus one
        new = np.concatenate(([True], np.diff(key[self.sa]) != 0)) if n else np.zeros(0, bool)
        self.split[new] = 1
        heads = np.flatnonzero(new)
        self.rank[self.sa] = np.repeat(heads, np.diff(np.append(heads, n)))
        self._double(n)

    def _double(self, n: int) -> None:
        shared = self.split == 0
        open_ = shared | np.append(shared[1:], False)
        at, h = np.flatnonzero(open_), FIRST
        while len(at):
            self.levels.append(self.rank.astype(np.int32 if n < 1 << 31 else np.int64))
            suffix = self.sa[at]
            # Within a group the marks make every h-prefix end before its text does, so suffix + h exists.
            key = self.rank[suffix] * n + self.rank[suffix + h]
            order = np.argsort(key, kind="stable")
            suffix, key = suffix[order], key[order]
            self.sa[at] = suffix
            new = np.concatenate(([True], key[1:] != key[:-1]))
            told = at[new & (self.split[at] == 0)]
            self.split[told] = len(self.levels) + 1
            heads = np.flatnonzero(new)
            self.rank[suffix] = np.repeat(at[heads], np.diff(np.append(heads, len(at))))
            shared = ~new
            at = at[shared | np.append(shared[1:], False)]
            h *= 2

    def _sparse(self) -> list[np.ndarray]:
        """LCP of neighbours in the suffix array, and minima over 2**k of them."""
        n = len(self.sa)
        lcp = np.zeros(n, np.int32 if n < 1 << 31 else np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            deep = np.flatnonzero(self.split > k + 1)
            a, b = self.sa[deep] + lcp[deep], self.sa[deep - 1] + lcp[deep]
            lcp[deep[self.levels[k][a] == self.levels[k][b]]] += FIRST << k
        left = np.arange(1, n)
        for _ in range(FIRST - 1):
            left = left[self.symbols[self.sa[left] + lcp[left]] == self.symbols[self.sa[left - 1] + lcp[left]]]
            lcp[left] += 1
        self.levels, table = self.levels[:1], [lcp]
        while 2 << (len(table) - 1) <= n:
            half, last = 1 << (len(table) - 1), table[-1]
            table.append(np.minimum(last[:-half], last[half:]))
        return table

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j (never the same)."""
        if self.table is None:
            self.table = self._sparse()
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        k = np.frexp(high - low)[1] - 1
        out = np.zeros(len(low), np.int64)
        for level in np.unique(k):
            of = np.flatnonzero(k == level)
            out[of] = np.minimum(self.table[level][low[of]], self.table[level][high[of] - (1 << int(level))])
        return out

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the first ``FIRST`` words of suffixes i and j are equal (no shared rank was ever split if there are no rounds)."""
        if not self.levels:
            return np.zeros(len(i), bool)
        return self.levels[0][i] == self.levels[0][j]


def next_smaller(values: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value; ``marks`` are smaller than all of their text and have themselves.

    All places jump at once: whatever lies before a place's present candidate is greater, so it may
    go on to the candidate's own candidate. Places that have many smaller steps before them would
    jump often; after ``JUMPS`` rounds they go on by minima over 2**k values, greatest k first.
    """
    n = len(values)
    out = np.arange(1, n + 1)
    out[marks] = marks
    active = np.flatnonzero(out > np.arange(n))
    for _ in range(JUMPS):
        active = active[values[out[active]] > values[active]]
        if not len(active):
            return out
        out[active] = out[out[active]]
    table = [values]
    while 2 << (len(table) - 1) <= n:
        half, last = 1 << (len(table) - 1), table[-1]
        table.append(np.minimum(last[:-half], last[half:]))
    at, least = out[active], values[active]
    for k in range(len(table) - 1, -1, -1):
        inside = at + (1 << k) <= n
        go = np.flatnonzero(inside)[table[k][at[inside]] > least[inside]]
        at[go] += 1 << k
    out[active] = at
    return out


def runs(numbers: np.ndarray, word_at: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows of (text, start, length, period), sorted, of all texts' runs with at least that length and exponent (two or more)."""
    none = np.zeros((0, 4), np.int64)
    n_texts, sizes = len(word_at) - 1, np.diff(word_at)
    if not len(numbers):
        return none
    text = np.repeat(np.arange(n_texts), sizes)
    # Marks 0 .. n_texts-1, words above them.
    place = np.arange(len(numbers)) + text
    symbols = np.empty(len(numbers) + n_texts, np.int64)
    marks = word_at[1:] + np.arange(n_texts)
    symbols[marks] = np.arange(n_texts)
    symbols[place] = numbers + n_texts
    suffixes = Suffixes(symbols)
    falling = len(symbols) - suffixes.rank
    falling[marks] = -1
    found = []
    for values in (suffixes.rank, falling):
        p = next_smaller(values, marks)[place] - place
        # A run's leftmost root reaches more than (exponent - 2) periods beyond itself.
        reach = (least_exponent - 2) * p + 1
        i = np.arange(len(place))
        if least_exponent > FIRST:  # the first FIRST words must be alike then, which the first ranks tell
            i = i[suffixes.alike(place, place + p)]
        right = suffixes.common(place[i], place[i] + p[i])
        far = right >= reach[i]
        found.append(np.column_stack((text[i], place[i] + p[i] + right, p[i], place[i]))[far])
    roots = np.concatenate(found)
    if not len(roots):
        return none
    # Of the roots with one end and period the leftmost.
    roots = roots[np.lexsort((roots[:, 3], roots[:, 2], roots[:, 1]))]
    first = np.concatenate(([True], (roots[1:, 1] != roots[:-1, 1]) | (roots[1:, 2] != roots[:-1, 2])))
    t, end, p, root = roots[first].T
    # Only texts with such roots are reversed: word k of a text of m words becomes word m-1-k.
    of = np.unique(t)
    m = sizes[of]
    base = np.cumsum(m + 1) - (m + 1)  # where each begins in the reversed row
    backwards = np.empty(int(m.sum()) + len(of), np.int64)
    mark = base + m
    backwards[mark] = np.arange(len(of))
    inner = np.setdiff1d(np.arange(len(backwards)), mark, assume_unique=True)
    owner = np.repeat(np.arange(len(of)), m)
    backwards[inner] = numbers[word_at[of][owner] + m[owner] - 1 - (inner - base[owner])] + len(of)
    k = np.searchsorted(of, t)
    begin = word_at[t] + t  # of the text, in ``symbols``
    before, after = root - 1 - begin, root + p - 1 - begin  # words that must be equal, as word numbers of the text
    left = np.zeros(len(root), np.int64)
    inside = np.flatnonzero(before >= 0)
    if len(inside):
        reversed_ = Suffixes(backwards)
        back = lambda w: base[k[inside]] + m[k[inside]] - 1 - w[inside]
        left[inside] = reversed_.common(back(before), back(after))
    start = root - begin - left
    length = end - begin - start
    out = np.column_stack((t, start, length, p))[(length >= least_length) & (length >= least_exponent * p)]
    return np.unique(out, axis=0)


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, size: int = SLICE_BYTES) -> DataFrame:
    """``doc_id, n_words, runs`` (by start, then period) and ``collapsed``: the text's words but those in a run after its first period, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in sweeps(batch.column(1), size):
                n = len(at) - 1
                starts, ends, word_at = word_ranges(data, at)
                found = runs(word_numbers(data, starts, ends), word_at, least_length, least_exponent)
                cut = np.searchsorted(found[:, 0], np.arange(n + 1))
                raw, collapsed = data.tobytes(), []
                for i in range(n):
                    words = raw[at[i] : at[i + 1]].split()  # bytes split at just the white space that ends words
                    if cut[i] < cut[i + 1]:
                        depth = np.zeros(len(words) + 1, np.int64)
                        of = found[cut[i] : cut[i + 1]]
                        np.add.at(depth, of[:, 1] + of[:, 3], 1)
                        np.add.at(depth, of[:, 1] + of[:, 2], -1)
                        words = [words[w] for w in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
                    collapsed.append(b" ".join(words))
                fields = [pa.array(found[:, c]) for c in (1, 2, 3)]
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first : first + n], pa.array(np.diff(word_at)), lists, pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return documents(docs).mapInArrow(releasing(run), SCHEMA)


def strongest(runs: Column) -> Column:
    """The run of greatest exponent, the first of equals; null if there is none."""

    def better(best: Column, x: Column) -> Column:
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def run_lines(runs: Column) -> Column:
    """One line ``start,length,period`` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with a tail of a period of its own in a tenth of the texts, by the crc32 of the id: for measuring the operator on a corpus without runs."""
    rows = documents(docs)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size("words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    words = F.array_remove(F.split("text", r"[ \t-\r]+"), "")
    repeated = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", a + (i - a) % p)))
    chosen = rows.withColumn("words", F.when(h % 10 == 0, words))
    return chosen.select("doc_id", F.when(F.size("words") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
