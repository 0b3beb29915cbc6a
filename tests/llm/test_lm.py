"""Language-model scores: base columns against brute force, the network against its definition, all texts learned from."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquill.llm import gru, lm_score
from sparquill.llm.columns import documents

DOCS = [(500, None), (501, "Unseen WORDS"), (502, ""), (503, " \t\n"), (None, "w1 w2"), (504, "w3 " * 3000), (505, "w1 w2"), (505, "w1 w2")]


def training():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(11)
    docs = [(i, " ".join(r.choices([f"w{k}" for k in range(40)], k=r.randrange(30)))) for i in range(80)] + DOCS
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("symbols", F.lit(1)).withColumn("training", F.lit(None).cast("string"))
    return docs, documents(df)


def test_base_columns(corpus):
    docs, df = corpus
    c = Counter(w for i, t in docs if not is_held(i) for w in [*(t or "").lower().split(), "\n"])
    n, v = sum(c.values()), len(c)

    def expected(i, t):
        own = [*(t or "").lower().split(), "\n"]
        return (i if i is not None else -1, len(own), sum(c[w] > 0 for w in own), n, is_held(i), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), 6))

    for hot, symbols, tokens in ((1000, 64, 10**6), (10, 6, 300)):
        rows = lm_score.scores(df, training(), hot=hot, symbols=symbols, classes=4, hidden=4, replica_tokens=tokens).collect()
        got = [(x.doc_id if x.doc_id is not None else -1, x.n_tokens, x.n_known, x.train_tokens, x.held_out, round(x.base_score, 6)) for x in rows]
        assert sorted(got) == sorted(expected(*d) for d in docs)
        assert all(x.score < 0 for x in rows) and len({x.score for x in rows if x.doc_id == 505}) == 1


def test_without_training_texts_and_without_texts(corpus):
    docs, df = corpus
    nothing = lm_score.scores(df, F.lit(False)).collect()
    assert len(nothing) == len(docs) and {x.train_tokens for x in nothing} == {0} and {x.n_known for x in nothing} == {0}
    assert lm_score.scores(df.filter("false"), F.lit(True)).count() == 0


def test_every_training_text_is_read_once_whatever_the_partitions(spark, monkeypatch):
    df = spark.createDataFrame([(i if i % 9 else None, f"text{i} " * (1 + i % 5)) for i in range(200)], "doc_id long, text string")
    read = []

    def trained(texts, weights, replicas):
        read.append(sorted((x.replica, x.place, bytes(x.symbols)) for x in texts.collect()))
        return weights

    monkeypatch.setattr(lm_score, "trained", trained)
    runs = []
    for parts in (1, 7):
        read.clear()
        lm_score.scores(df.repartition(parts), F.col("text") != "text7 text7 text7 ", symbols=300, classes=4, hidden=4, replica_tokens=50)
        runs.append([*read])
    assert runs[0] == runs[1] and len(runs[0]) > 1 and sum(map(len, runs[0])) == 199
    numbers = [{r for r, _, _ in some} for some in runs[0]]
    assert all(max(a) < min(b) for a, b in zip(numbers, numbers[1:], strict=False))


def test_rounds_cover_all_replicas():
    for n in range(1, 300):
        got = lm_score.rounds(n)
        assert got[0][0] == 0 and got[-1][1] == n and all(a[1] == b[0] and b[1] - b[0] > a[1] - a[0] for a, b in zip(got, got[1:], strict=False))


def test_held_out_scores_beat_the_base(spark):
    """Words follow each other by a rule that the base can't see."""
    r = random.Random(3)

    def text():
        at, out = r.randrange(20), []
        for _ in range(r.randrange(20, 200)):
            at = (3 * at + r.randrange(2)) % 20
            out.append(f"w{at}")
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string")
    held = lm_score.scores(df, training(), symbols=32, classes=5, replica_tokens=30_000).filter("held_out").collect()
    gain = sum(x.score - x.base_score for x in held) / sum(x.n_tokens for x in held)
    assert len(held) > 100 and gain > 0.2


def ragged(longest):
    r = np.random.default_rng(0)
    return [np.append(r.integers(1, 5, longest), 0), *(np.append(r.integers(1, 5, r.integers(0, 9)), 0) for _ in range(255))]


def test_streams_hold_every_document_once_and_state_starts_anew():
    docs = ragged(100)
    streams = gru.Streams(docs, 7, 16)
    got = [[] for _ in docs]
    for y, x, owner in streams.windows(8):
        assert y.shape == x.shape == owner.shape and y.shape[0] <= 8
        for s in range(y.shape[1]):
            for t in np.flatnonzero(y[:, s] >= 0):
                assert x[t, s] == (got[owner[t, s]][-1] if got[owner[t, s]] else 7)
                got[owner[t, s]].append(int(y[t, s]))
    assert [d.tolist() for d in docs] == got


def test_memory_follows_the_symbols_not_the_longest_text():
    import tracemalloc

    p = gru.initial(5, 2, 4, np.ones(5))
    docs = ragged(100_000)
    tracemalloc.start()
    total = gru.score(p, docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(total) == 256 and (total < 0).all() and peak < 20_000_000  # longest x streams would be 300 MB


def test_gradients_are_those_of_the_loss(monkeypatch):
    r = np.random.default_rng(1)
    monkeypatch.setattr(gru, "F32", np.float64)
    p = {k: v + r.standard_normal(v.shape) * 0.1 for k, v in gru.initial(11, 3, 4, np.arange(11) + 1.0).items()}
    x, y, h = r.integers(0, 12, (5, 3)), r.integers(0, 11, (5, 3)), r.standard_normal((3, 4))
    y[3:, 2], x[3:, 2] = -1, 11  # a stream that has ended
    g = {k: np.zeros_like(v) for k, v in p.items()}
    _, _, n = gru.gradients(p, x, y, h, 11, g)
    assert n == 13
    for k, v in p.items():
        for at in r.choice(v.size, min(20, v.size), replace=False):
            loss = []
            for step in (1e-6, -1e-6):
                moved = {a: b.copy() for a, b in p.items()}
                moved[k].flat[at] += step
                loss.append(gru.gradients(moved, x, y, h, 11, {a: np.zeros_like(b) for a, b in p.items()})[1])
            assert (loss[0] - loss[1]) / 2e-6 / n == pytest.approx(g[k].flat[at], abs=1e-7)


def test_recurrent_model_is_a_distribution_and_learns():
    r = np.random.default_rng(0)
    docs = [np.array([*np.tile([1, 2, 3], r.integers(3, 9)), 0], np.int32) for _ in range(60)]
    p = gru.initial(5, 2, 6, np.bincount(np.concatenate(docs), minlength=5))
    state = r.standard_normal((1, 6)).astype(np.float32)
    assert sum(np.exp(gru.log_probabilities(p, state, np.array([s])))[0] for s in range(5)) == pytest.approx(1, abs=1e-4)
    before = gru.score(p, docs).sum()
    for _ in range(30):
        p, _, _ = gru.train(p, docs, rate=0.03, n=8)
    after = gru.score(p, docs)
    assert after.sum() > before / 2
    assert gru.score(p, docs, steps=3, n=4) == pytest.approx(after, rel=1e-3)  # windows and streams change nothing
