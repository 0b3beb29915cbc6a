"""Filter audit, periodic runs and token files, against brute force, SQL and the public library."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparquill.llm import filter_audit, periodic, queries, scan, token_files
from sparquill.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Ab ab Ab\x1cx #"), (4, "Ab ab Ab\x1cx #"), (None, "Ab ab Ab\x1cx #"), (5, "x" * 3000), (6, "<|endoftext|> ça Σ ñ é 漢字 😀  \n#$% a  b"), (7, "word " * 5000), (8, ""), (9, "word " * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    named = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") == 5, ""))
    return named.withColumn("mask", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("words", F.lit(2)).withColumn("tie", F.lit(3)).withColumn("start", F.lit("s"))


def random_texts(r, n):
    some = ["a", "b", "Ab", "é", "c#", "D", "\n", "  ", " ", "漢"]
    return [" ".join(r.choices(some[: r.randrange(1, len(some))], k=r.choice([0, 3, 199, 200, 201, 260]))) for _ in range(n)]


def test_words_and_counts_of_a_sweep():
    r = random.Random(1)
    texts = ["", " ", "x", *random_texts(r, 40), "y" * 5000, "y" * 5000]
    for column in (pa.array(texts), pa.array(["skipped", *texts], pa.large_string()).slice(1)):
        seen = 0
        for first, data, at in scan.sweeps(column, 2000):
            starts, ends, word_at = scan.word_ranges(data, at)
            assert first == seen
            for i in range(len(at) - 1):
                words = [data[s:e].tobytes().decode() for s, e in zip(starts[word_at[i] : word_at[i + 1]], ends[word_at[i] : word_at[i + 1]], strict=True)]
                assert words == WORD.findall(texts[first + i])
            assert scan.counts(data == ord("a"), at).tolist() == [t.count("a") for t in texts[first : first + len(at) - 1]]
            assert filter_audit.distinct_words(data, starts, ends, word_at).tolist() == [len(set(WORD.findall(t))) for t in texts[first : first + len(at) - 1]]
            seen += len(at) - 1
        assert seen == len(texts)


def test_equal_hashes_are_verified(monkeypatch):
    """With hashes that tell nothing apart the counts and numbers stay right."""
    column = pa.array(["a b c a", "longer-than-eight longer-than-nine longer-than-eight"])
    for module in (filter_audit, periodic):
        monkeypatch.setattr(module, "range_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    _, data, at = next(scan.sweeps(column))
    starts, ends, word_at = scan.word_ranges(data, at)
    assert filter_audit.distinct_words(data, starts, ends, word_at).tolist() == [3, 2]
    numbers = periodic.word_numbers(data, starts, ends).tolist()
    assert numbers[0] == numbers[3] and numbers[4] == numbers[6] and len(set(numbers)) == 5


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    failing = []
    for d, text, lang in docs:
        text = text or ""
        w = WORD.findall(text)
        f = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": d is not None and any(o is not None and o < d and (t or "") == text for o, t, _ in docs),
        }
        failing.append((lang or "", f, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in failing}:
        rows = [x for x in failing if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                gone = lambda f, k=k, order=order: any(f[y] for y in order[:k])
                removed = [row for row in rows if row[1][x] and not gone(row[1])]
                shapley[x] += len(removed)
                out[part, "".join(order), k + 1] = [
                    sum(not row[1][x] and not gone(row[1]) for row in rows), len(removed), sum(row[1][x] and gone(row[1]) for row in rows),
                    sum(row[1][x] and sum(row[1].values()) == 1 for row in rows), sum(row[2] for row in removed), sum(row[3] for row in removed),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_brute_force_and_sql(spark, odd):
    r = random.Random(2)
    texts = random_texts(r, 60)
    docs = [(20 + i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(120)] + [(None, texts[0], "de"), (None, texts[0], "de"), (20, texts[1], "fr"), (20, texts[1], "fr")]
    docs += [tuple(x) for x in odd.select("doc_id", "text", "lang").collect()]
    labels = [(d, r.choice([0, 1, None]), r.choice([0, 1])) for d, *_ in docs if d is not None] + [(21, 1, 0), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("good", F.lit("x")).withColumn("n", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    got = {(x.part, x.filter_order, x.step): [x[c] for c in COUNTS] for x in filter_audit.audit(frame, marks).collect()}
    assert got == brute_audit(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})
    assert filter_audit.audit(frame.filter("false"), marks).count() == 0
    assert filter_audit.audit(frame, marks.filter("false")).agg(F.sum("good_lost")).first()[0] == 0
    assert filter_audit.audit(odd, marks).count() == 1200
    db = duckdb.connect()
    db.register("documents", frame.select("doc_id", "text", "lang").toPandas().astype({"doc_id": "Int64"}))
    db.register("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int").toPandas().astype("Int64"))
    sql = {(x["part"], x["filter_order"], x["step"]): [x[c] for c in COUNTS] for x in db.sql(filter_audit.SQL).df().to_dict("records")}
    assert sql == got


def brute_runs(w, least_length=6, least_exponent=4):
    out = []
    for q in range(1, len(w) // least_exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if n >= max(least_length, least_exponent * q) and not any(all(w[x] == w[x + d] for x in range(s, s + n - d)) for d in range(1, q)):
                out.append((s, n, q))
            i = max(i, s + 1)
    return sorted(out)


@pytest.mark.parametrize(("least_length", "least_exponent"), [(6, 4), (2, 2), (5, 3), (1, 6)])
def test_runs_equal_brute_force(least_length, least_exponent):
    r = random.Random(least_exponent)
    for _ in range(150):
        texts = []
        for _ in range(r.randrange(1, 6)):
            n, k = r.randrange(0, 60), r.choice([1, 2, 3, 5, 40])
            w = [r.randrange(k) for _ in range(n)]
            a = r.randrange(n) if n else 0
            p = 1 + (n - a) // (3 + r.randrange(8))
            texts.append([w[i] if i < a or r.random() < 0.02 else w[a + (i - a) % p] for i in range(n)])
        got = periodic.runs(np.array([x for t in texts for x in t], np.int64), np.concatenate(([0], np.cumsum([len(t) for t in texts]))), least_length, least_exponent)
        assert [tuple(x) for x in got.tolist()] == [(i, *x) for i, t in enumerate(texts) for x in brute_runs(t, least_length, least_exponent)]


def test_periodic_query_against_its_definition(spark, odd, tmp_path):
    r = random.Random(5)
    docs = [(i, " ".join(r.choices(["a", "b", "A", "é\n", "c"][: r.randrange(1, 6)], k=r.choice([0, 1, 5, 6, 40, 300])))) for i in range(150)] + [(151, "a " * 20000)] + ODD
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for d, text in docs:
        w = WORD.findall(text or "")
        n = len(w)
        h = None if d is None else zlib.crc32(str(d).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w) if n < 1000 else [(0, n, 1)]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        dropped = {i for s, n_, q in runs for i in range(s + q, s + n_)}
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        expected.append((d, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join("%d,%d,%d\n" % x for x in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped))))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[-1])
    assert sorted([tuple(x) for x in got], key=key) == sorted(expected, key=key)
    assert periodic.periodic_runs(odd.filter("false")).count() == 0 and periodic.periodic_runs(odd).count() == len(ODD)


def test_packed_ids_come_back():
    r = random.Random(3)
    for _ in range(200):
        n, bits = r.choice([0, 1, 59, 4095, 4096, 4097, 9000]), [r.choice([0, 1, 2, 8, 12, 15, 16, 20, 33, 60, 61, 64]) for _ in range(3)]
        ids = np.array([r.getrandbits(k) if (k := r.choice(bits)) else 0 for _ in range(n)], np.uint64)
        words, block_at, escapes = token_files.packed(ids)
        assert (token_files.unpacked(words, block_at, escapes, n) == ids).all()
        assert len(escapes) == int((ids >= 1 << 60).sum())
        segment = token_files.Segment(np.arange(2), np.array([n // 3, n - n // 3]), words.tobytes(), block_at, escapes.tobytes())
        assert (segment.document(1) == ids[n // 3 :]).all()
        for _ in range(5):
            i, j = sorted((r.randrange(n + 1), r.randrange(n + 1)))
            assert (segment.ids(i, j) == ids[i:j]).all()


def test_every_token_encodes_to_itself():
    """With ids in the order of merges, this makes merging by the rank of the merged bytes the same as by pairs."""
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    assert all([x.id for x in library.model.tokenize(t)] == [i] for t, i in library.get_vocab().items() if t not in special)


def test_encoder_equals_the_library():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    own = token_files.Encoder(vocabulary("byte_bpe_50k.json"))
    r = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "1", "é", "漢", "!", "'s", "<|endoftext|>", "​", "　", "😀", "\x0b", "\r", "word", "İ"]
    texts = ["".join(r.choices(parts, k=r.randrange(30))) for _ in range(3000)]
    # Every code point, behind and before others.
    texts += ["".join(f"a{chr(c)} {chr(c)}b  {chr(c)} !{chr(c)}\n" for c in range(at, at + 64)) for at in range(0, 0x110000, 64) if not 0xD800 <= at < 0xE000]
    for at in range(0, len(texts), 500):
        for text, e in zip(texts[at : at + 500], library.encode_batch(texts[at : at + 500], add_special_tokens=False), strict=True):
            assert own.encode(text).tolist() == e.ids


def test_token_files(spark, odd, tmp_path):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    r = random.Random(6)
    docs = [(i, " ".join(r.choices(["a", "lorem", "Ab", "é\n", "漢"], k=r.choice([0, 1, 40, 3000])))) for i in r.sample(range(-50, 500), 200)] + ODD
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("sizes", F.lit(1)).repartition(7)
    path = token_files.write_token_files(frame, vocabulary("byte_bpe_50k.json"), 2)
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in docs}
    rows = token_files.read_documents(spark, path).orderBy("start").collect()
    assert [x.doc_id for x in rows] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d))
    at, by_id = 0, {}
    for x in rows:
        assert x.start == at and x.n_tokens == len(x.tokens)
        at += x.n_tokens
        by_id.setdefault(x.doc_id, []).append(x.tokens)
    assert at == sum(len(ids[t]) for _, t in docs)
    for d in {d for d, _ in docs}:
        assert sorted(by_id[d]) == sorted(ids[t] for k, t in docs if k == d)
    sums = {(x.start, x.n_tokens, x.ids_crc32) for x in token_files.read_checksums(spark, path).collect()}
    assert sums == {(x.start, x.n_tokens, zlib.crc32(np.array(x.tokens, "<u4").tobytes())) for x in rows}
    empty = token_files.write_token_files(odd.filter("false"), vocabulary("byte_bpe_50k.json"), 2)
    assert token_files.read_documents(spark, empty).count() == 0
