"""Matches without those that cannot be among the best of their query.

BM25 and cosine need no positions, and proximity is at least 0, at most a fixed value a query, and 0
in a document without the query's first term. So each task adds up the first two for its documents,
holds the k-th best sum of every variant, and lets go of the pairs of variant and document that stay
below it even with the most that proximity could add; for what is left it finds the proximity. The
pairs that may be among the best of a task go on with their positions and are scored as any other
match, so the rows are those of full scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.operators.index import TASK_ROWS, Index, tasks
from sparquill.operators.lookup import gathered
from sparquill.operators.ranking import B, B_PROXIMITY, BROADCAST_TERMS, COSINE_WEIGHT, COSINE_WEIGHT_STEMMED, K1, TOP, VARIANT, best, distinct_terms, of_terms, score_of, scored

#: More than rounding a score to three places and adding it up in another order can change it by.
MARGIN = 0.01
#: Pairs of document and variant that a task adds up at a time.
PAIRS = 2_000_000
#: Pairs that a task keeps until it has seen all of its documents.
HELD = 200_000

HITS = pa.list_(pa.struct([("qpos", pa.int32()), ("tf", pa.int32()), ("df", pa.int64()), ("idf", pa.float64()), ("weight", pa.float64()), ("positions", pa.list_(pa.int32()))]))
HITS_SQL = "hits array<struct<qpos:int,tf:int,df:bigint,idf:double,weight:double,positions:array<int>>>"


class Asked:
    """The terms of all variants as arrays, by term: ``known`` are rows of ``query_id, variant_id, qpos, term, weight, df, idf``."""

    def __init__(self, known: list, index: Index):
        numbers: dict = {}
        variant = np.array([numbers.setdefault((r.query_id, r.variant_id), len(numbers)) for r in known], np.int64)
        self.terms = sorted({r.term for r in known if r.df is not None})
        at = {t: i for i, t in enumerate(self.terms)}
        found = [i for i, r in enumerate(known) if r.df is not None]
        term = np.array([at[known[i].term] for i in found], np.int64)
        by_term = np.argsort(term, kind="stable")
        own = [known[found[i]] for i in by_term]
        self.uses = np.bincount(term, minlength=len(at))
        self.first_use = np.cumsum(self.uses) - self.uses
        self.variant = variant[found][by_term]
        self.qpos, self.weight = np.array([r.qpos for r in own], np.int32), np.array([r.weight for r in own], float)
        self.df, self.idf = np.zeros(len(at), np.int64), np.zeros(len(at))
        for r in own:
            self.df[at[r.term]], self.idf[at[r.term]] = r.df, r.idf
        self.rarity = np.log2((index.n_docs - self.df + 0.5) / (self.df + 0.5))
        idfs: list = [[] for _ in numbers]
        for v, r in zip(variant, known):
            idfs[v].append((r.qpos, r.idf))
        w2 = np.bincount(variant, [float(r.weight) ** 2 for r in known], len(numbers))
        self.caps = np.zeros((len(numbers), max(map(len, idfs))))
        for v, own_idfs in enumerate(idfs):
            self.caps[v, : len(own_idfs)] = [min(1.0, x) for _, x in sorted(own_idfs)]
        self.most = (K1 + 1) * self.caps.sum(axis=1)
        self.own_idf = np.array([r.idf for r in own], float)
        self.length = np.sqrt(w2)
        self.cosine_weight = COSINE_WEIGHT_STEMMED if index.stem else COSINE_WEIGHT
        self.avg_dl = float(index.avg_dl)
        self.variants = [(v, *key, [x for _, x in sorted(idfs[v])], float(w2[v])) for key, v in numbers.items()]


def contending(rows: pa.Table, asked: Asked, top: np.ndarray) -> tuple[np.ndarray, pa.RecordBatch, np.ndarray]:
    """The pairs of some whole documents that may be among the best, with about their scores, and ``top``, the best scores of each variant so far, with theirs."""
    n = len(asked.length)
    ids, places = rows["doc_id"].combine_chunks(), rows["positions"].combine_chunks().cast(pa.list_(pa.int32()))
    term, tf, n_terms, norm = (rows[c].to_numpy() for c in ("number", "tf", "n_terms", "doc_norm"))
    starts = np.concatenate([[0], 1 + np.flatnonzero(differs_from_last(ids))]).astype(np.int64)
    doc = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(ids)))
    uses = asked.uses[term]
    row = np.repeat(np.arange(len(term)), uses)
    use = np.arange(len(row)) - np.repeat(np.cumsum(uses) - uses, uses) + asked.first_use[term][row]
    pair = doc[row] * n + asked.variant[use]
    with np.errstate(divide="ignore", invalid="ignore"):
        bm25 = asked.rarity[term] * (K1 + 1) * tf / (K1 * (1 - B + B * n_terms / asked.avg_dl) + tf)
        share = np.where(norm > 0, tf / n_terms * asked.idf[term] / norm, 0.0) * asked.cosine_weight
        score = np.bincount(pair, bm25[row] + share[row] * (asked.weight / asked.length[asked.variant])[use], len(starts) * n)
    hits = np.bincount(pair, minlength=len(score))
    paired = (np.bincount(pair[asked.qpos[use] == 0], minlength=len(score)) > 0) & (hits > 1)

    def best_of(values: np.ndarray) -> np.ndarray:
        both = np.concatenate([top, np.where((hits > 0) & ~np.isnan(values), values, -np.inf).reshape(-1, n)])
        return np.partition(both, len(both) - len(top), axis=0)[len(both) - len(top) :]

    most = (score.reshape(-1, n) + np.where(paired.reshape(-1, n), asked.most, 0.0)).ravel()
    left = (hits > 0) & ~below(most, best_of(score), np.arange(len(most)) % n)
    near = np.flatnonzero((left & paired)[pair])
    near = near[np.lexsort((asked.qpos[use[near]], pair[near]))]
    pairs, at, of = np.unique(pair[near], return_index=True, return_inverse=True)
    score[pairs] += proximity(places, tf, row[near], use[near], of, at, pairs % n, n_terms[starts[pairs // n]], asked)
    top = best_of(score)
    left &= ~below(score, top, np.arange(len(score)) % n)
    chosen = np.flatnonzero(left[pair])
    chosen = chosen[np.lexsort((asked.qpos[use[chosen]], pair[chosen]))]
    pairs, at = np.unique(pair[chosen], return_index=True)
    r, u, heads = row[chosen], use[chosen], starts[pairs // n]
    values = [pa.array(asked.qpos[u], pa.int32()), pa.array(tf[r], pa.int32()), pa.array(asked.df[term[r]]), pa.array(asked.idf[term[r]]), pa.array(asked.weight[u]), places.take(pa.array(r))]
    listed = pa.ListArray.from_arrays(pa.array(np.append(at, len(chosen)), pa.int32()), pa.StructArray.from_arrays(values, fields=list(HITS.value_type)))
    columns = [ids.take(pa.array(heads)), pa.array(pairs % n, pa.int64()), pa.array(n_terms[heads], pa.int64()), pa.array(norm[heads], pa.float64()), listed]
    return score[pairs], pa.RecordBatch.from_arrays(columns, names=["doc_id", "variant", "n_terms", "doc_norm", "hits"]), top


def below(score: np.ndarray, top: np.ndarray, variant: np.ndarray) -> np.ndarray:
    """Whether a score is surely not among the best of its variant."""
    return score < top.min(axis=0)[variant] - MARGIN


def proximity(places: pa.ListArray, tf: np.ndarray, row: np.ndarray, use: np.ndarray, of: np.ndarray, at: np.ndarray, variant: np.ndarray, n_terms: np.ndarray, asked: Asked) -> np.ndarray:
    """What ``ranking.with_proximity`` gives, but for the order of its sums, by pair: of all pairs of some documents at once.

    The hits ``row, use`` are sorted by pair and place in the query; ``of`` is the number of their pair, ``at`` the first of each.
    """
    value = np.zeros(len(at))
    if not len(at):
        return value
    q, idf, n = asked.qpos[use].astype(np.int64), asked.own_idf[use], tf[row].astype(np.int64)
    prefix = np.bincount(of[q == np.arange(len(of)) - at[of]], minlength=len(at))[of]
    flat, first = places.flatten().to_numpy().astype(np.int64), (places.offsets.to_numpy() - places.offsets[0].as_py())[row]
    low, high, far = flat[first], flat[first + n - 1], 1 << 32
    # Of each hit: the last place of the terms behind it in the query, the first place of those before it that may begin a pair.
    last = np.maximum.accumulate(((len(at) - of) * far + high)[::-1])[::-1] - (len(at) - of) * far
    same = of[1:] == of[:-1]
    last = np.append(np.where(same, last[1:], -1), -1)
    least = far - 1 - (np.maximum.accumulate(of * far + np.where(q < prefix, far - 1 - low, 0)) - of * far)
    least = np.append(far, np.where(same, least[:-1], far))
    hit = np.repeat(np.arange(len(row)), n)
    place = flat[np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + first[hit]]
    counts = ((q < prefix)[hit] & (last[hit] > place)) | (least[hit] < place)
    hit, place = hit[counts], place[counts]
    order = np.argsort(of[hit] * far + place)
    hit, place = hit[order], place[order]
    a, b = hit[:-1], hit[1:]
    kept = (of[a] == of[b]) & (q[a] < q[b]) & (q[a] < prefix[a])
    a, b, gain = a[kept], b[kept], 1.0 / np.diff(place)[kept].astype(float) ** 2
    gain *= idf[a] + idf[b]
    width = asked.caps.shape[1]
    some, which = np.unique(of[a], return_inverse=True)
    k = K1 * (1 - B_PROXIMITY + B_PROXIMITY * n_terms / asked.avg_dl)
    at_once = max(1, PAIRS // width)
    for i in range(0, len(some), at_once):
        mine = slice(*np.searchsorted(which, (i, i + at_once)))
        own, cell = some[i : i + at_once], (which[mine] - i) * width
        added = np.bincount(cell + q[a[mine]], gain[mine], len(own) * width) + np.bincount(cell + q[b[mine]], gain[mine], len(own) * width)
        sums = np.cumsum(added.reshape(-1, width), axis=1)
        value[own] = (asked.caps[variant[own]] * sums / (sums + k[own, None])).sum(axis=1) * (K1 + 1)
    return value


def differs_from_last(ids: pa.Array) -> np.ndarray:
    """Whether an id is not the one before it, from the second on."""
    return pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)


def contenders(index: Index, query_terms: DataFrame, k: int = TOP, languages: list[str] | None = None) -> DataFrame | None:
    """The rows of ``ranking.matches`` that may be among the ``k`` best of their query; ``None`` if the terms are too many to gather."""
    small = gathered(distinct_terms(query_terms), BROADCAST_TERMS)
    if small is None or not small[1] or not index.avg_dl:
        return None
    spark, q = index.docs.sparkSession, small[0]
    terms = {r.term for r in small[1]}
    known = q.join(of_terms(index.dictionary, terms), "term", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0))).select(*VARIANT, "qpos", "term", "weight", "df", "idf").collect()
    asked = Asked(known, index)
    total = sum(int(x) for x in asked.df)
    numbers = spark.createDataFrame(list(zip(asked.terms, range(len(asked.terms)))), "term string, number int")
    docs = index.docs.filter(F.col("lang").isin(*languages)) if languages else index.docs
    own = of_terms(index.postings, terms).join(F.broadcast(numbers), "term").select("doc_id", "number", "tf", "positions")
    dealt = own.repartition(tasks(spark, total, TASK_ROWS), "doc_id").join(docs.select("doc_id", "n_terms", "doc_norm"), "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, rest, docs_at_once = np.full((k, len(asked.length)), -np.inf), None, max(1, PAIRS // len(asked.length))
        kept: list = []

        def left() -> list:
            """Of what was kept, what may still be among the best."""
            stays = [(s, ~below(s, top, b["variant"].to_numpy()), b) for s, b in kept]
            return [(s[m], b.filter(pa.array(m))) for s, m, b in stays if m.any()]

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            changes = np.flatnonzero(differs_from_last(rows["doc_id"].combine_chunks())) + 1
            whole = [*changes[docs_at_once - 1 : -1 : docs_at_once], *changes[-1:]]
            for low, high in zip([0, *whole], whole):
                scores, made, top = contending(rows.slice(low, high - low), asked, top)
                kept.append((scores, made))
            rest = rows.slice(whole[-1]) if whole else rows  # the last document may go on in the next batch
            if sum(len(s) for s, _ in kept) > HELD:
                kept = left()
                if sum(len(s) for s, _ in kept) > HELD // 2:
                    yield from (b for _, b in kept)
                    kept = []
        if rest is not None:
            scores, made, top = contending(rest, asked, top)
            kept.append((scores, made))
        yield from (b for _, b in left())

    kind = index.docs.schema["doc_id"].dataType.simpleString()
    left = dealt.mapInArrow(run, f"doc_id {kind}, variant bigint, n_terms bigint, doc_norm double, {HITS_SQL}")
    kinds = ", ".join(f"{c} {q.schema[c].dataType.simpleString()}" for c in VARIANT)
    return left.join(F.broadcast(spark.createDataFrame(asked.variants, f"variant bigint, {kinds}, idfs array<double>, w2 double")), "variant").drop("variant")


def search(index: Index, query_terms: DataFrame, k: int = TOP, languages: list[str] | None = None) -> DataFrame:
    """The rows of ``best(scored(...), k)``; only matches that may be among them are scored whole."""
    rows = contenders(index, query_terms, k, languages)
    return best(scored(index, query_terms, languages) if rows is None else score_of(index, rows), k)
