"""Language identification and quality ratios against plain computations from their definitions."""

import math
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparquill.llm import language_id, quality


def splitmix(x):
    m = (1 << 64) - 1
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
    return x ^ x >> 31


def grams(text, dimensions):
    """Counts of the hashed 1-, 2- and 3-grams of the letters, runs of all else being one space."""
    plain = " " + " ".join("".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text).lower().split()) + " "
    c, out = [ord(x) for x in plain], {}
    if len(c) >= 3:
        pairs = [a << 21 | b for a, b in zip(c, c[1:])]
        for g in [*c, *pairs, *(((p << 21) & ((1 << 64) - 1)) ^ z ^ 1 << 63 for p, z in zip(pairs, c[2:]))]:
            k = (splitmix(g) >> 20) % dimensions
            out[k] = out.get(k, 0) + 1
    return out


def test_language_scores_from_their_definition(spark):
    r = random.Random(21)
    say = {"aa": "the thing with and water".split(), "bb": "der nicht für straße und".split()}
    rows = [(i, " ".join(r.choices(say[lang], k=r.randrange(3, 40))) + r.choice(["", " 42!", " Ünd"]), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 34", "aa"), (103, "the thing", None), (None, "with water", "aa"), (104, "thing " * 30_000, "bb"), (0, rows[0][1], "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("rejected", F.lit(1))
    dimensions = 512
    model = language_id.fit(docs, F.lit(True), clusters=2, dimensions=dimensions)
    learned = [grams(t, dimensions) for i, t, lang in rows if i is not None and lang is not None and t is not None]
    df = np.zeros(dimensions)
    for g in learned:
        df[list(g)] += 1
    assert model["idf"] == pytest.approx(np.log((1 + len(learned)) / (1 + df)) + 1, rel=1e-5)
    assert sorted(set(model["langs"])) == ["aa", "bb"] and len(model["langs"]) == 4

    def expected(text):
        g = grams(text or "", dimensions)
        if not any(map(str.isalpha, text or "")):
            return "und", 0.0, True
        x = np.zeros(dimensions)
        for k, n in g.items():
            x[k] = math.log(1 + n) * model["idf"][k]
        cosine = model["centres"] @ (x / np.linalg.norm(x))
        best = int(cosine.argmax())
        floor = model["floors"][best, int(math.log2(max(sum(g.values()) / 3, 1)))]
        return model["langs"][best], min(1.0, max(0.0, float(cosine[best]))), bool(cosine[best] < floor)

    found = language_id.identify(docs.select("doc_id", "text"), model).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], round(x[2], 3))
    got, want = sorted([(x.doc_id, x.lang_pred, x.score, x.rejected) for x in found], key=key), sorted([(i, *expected(t)) for i, t, _ in rows], key=key)
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-4)
    assert language_id.identify(docs.select("doc_id", "text").filter("false"), model).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*values):
    """A chain of xxHash64, each value's hash being the next one's seed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return signed(seed)


def gram_buckets(text, n):
    words = [hashed(w) for w in (text or "").split()]
    return [h % n for h in words] + [hashed(a, b) % n for a, b in zip(words, words[1:])]


def test_quality_ratio_and_verdict_from_their_definition(spark):
    r = random.Random(22)
    texts = {i: " ".join(r.choices([f"w{k}" for k in range(30)] if i % 3 else [f"z{k}" for k in range(40)], k=r.randrange(40, 90))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "one", 103: "w1 w2 w3 " * 20_000}
    rows = [*texts.items(), (0, texts[0]), (None, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ratio", F.lit("x")).withColumn("words", F.lit(1))
    trusted = {i for i in range(60) if i % 3 == 1}
    labels = spark.createDataFrame([(i, int(i in trusted)) for i in range(60)] + [(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    buckets = 64
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for i, t in rows:
        for b in gram_buckets(t, buckets):
            raw[b] += 1
            target[b] += i in trusted
    ratios = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    found = quality.quality_rules(docs, labels, buckets=buckets, threshold=0.01).collect()
    assert len(found) == len(rows) and {x.kept for x in found} == {True, False}
    for x in found:
        own = gram_buckets(dict(rows)[x.doc_id], buckets)
        expected = ratios[own].mean() if own else 0.0
        assert x.ratio == pytest.approx(expected, abs=1e-9)
        assert x.kept == (not x.base_failed and expected >= 0.01)
    assert quality.quality_rules(docs.filter("false"), labels).count() == 0
