"""Near-duplicate and line operators and the pipeline, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sparquill.llm import components, frequent, line_dedup, near_dedup

ODD = [(900, None), (901, ""), (902, " \n "), (903, "two words"), (904, "Two Words"), (None, "no id at all here"), (None, "no id at all here")]


def classes(links, nodes):
    least = {n: n for n in nodes}
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def test_components(spark):
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(30)] + [(7, 7), (None, 3)]
    real = [(a, b) for a, b in edges if a is not None and a != b]
    for local in (1000, 60, 0):  # in one task, by contraction and one task, by contraction alone
        got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
        assert got == classes(real, {x for e in real for x in e})
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(spark, n):
    r = random.Random(n)
    base = [[f"v{r.randrange(500)}" for _ in range(r.randrange(20, 90))] for _ in range(8)]
    docs = []
    for i in range(160):  # a few large groups of copies, changed more and more
        w = list(base[min(7, i // 15)])
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        docs.append((i, " ".join(w)))
    docs += ODD
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("component", F.lit(1))
    sets = {d: shingles(t, n) for d, t in docs if d is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = classes(links, sets)
    rows = near_dedup.near_duplicates(df, n=n).collect()
    assert len(rows) == len(docs)
    for x in rows:
        if x.doc_id is None:
            assert x.kept and x.component_id is None
        else:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), expected[x.doc_id], expected[x.doc_id] == x.doc_id)
    assert near_dedup.near_duplicates(df.filter("false")).count() == 0


def test_leftover_buckets_are_resolved_in_blocks(spark):
    import numpy as np

    sets = {i: np.array(sorted({*range(i * 3, i * 3 + 40)}), np.uint64) for i in range(30)}
    stored = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "doc_id long, shingles binary")
    for block, known in ((256, 1), (4, 1), (4, 3), (4, 10), (4, 15)):  # the first ones of a bucket are already known as components of ``known`` documents
        component = {i: i // known * known if i < 20 else i for i in sets}
        members = spark.createDataFrame([(1, i, component[i]) for i in sets] + [(2, i, 0) for i in (3, 9)], "key long, doc_id long, component long")
        links = [(x.a, x.b) for x in near_dedup.block_links(members, stored, 80, block).collect()]
        assert set(classes([*links, *component.items()], sets).values()) == {0}
        assert all(component[a] != component[b] and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])) for a, b in links)


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def near_lines(a, b):
    """Within an edit for each 12 characters of the shorter line, two at most."""
    most = min(2, min(len(a), len(b)) // 12)
    return abs(len(a) - len(b)) <= most and (a in b or b in a or len(a) < 1000 and edit_distance(a, b) <= most)


def changed(r, s, most):
    s = list(s)
    for _ in range(r.randrange(most + 1)):
        i, op = r.randrange(len(s) + 1), r.randrange(3)
        if op == 0:
            s.insert(i, r.choice("abc"))
        elif s and op == 1:
            del s[i % len(s)]
        elif s:
            s[i % len(s)] = r.choice("abc")
    return "".join(s)


def test_edit_distance_and_segments():
    r = random.Random(1)
    for _ in range(4000):
        a = "".join(r.choices("abc", k=r.randrange(0, 40)))
        b, k = changed(r, a, 4), r.randrange(1, 4)
        near = edit_distance(a, b) <= k
        assert line_dedup.within(a, b, k) == near
        short, long = sorted((a, b), key=len)
        if near and len(short) > k:
            own = line_dedup.keys_of(short, line_dedup.index_plan(len(short), k, 1))
            spans, level = line_dedup.probe_plan(len(long), k, 1)
            found = [key for key, same in zip(line_dedup.keys_of(long, spans), level, strict=True) if same == (len(short) == len(long))]
            assert {*own} & {*found}


def brute_lines(docs):
    """Dropped line numbers and links of each document, over (id, text) in order."""
    split = [(d, k, x.strip()) for d, t in docs for k, x in enumerate((t or "").split("\n")) if x.strip()]
    texts = {x for *_, x in split}
    links = [(a, b) for a in texts for b in texts if a < b and near_lines(a, b)]
    of = classes(links, texts)
    seen, dropped, degree = set(), {}, {}
    for d, k, x in sorted(split, key=lambda q: (q[0], q[1])):
        if of[x] in seen:
            dropped.setdefault(d, []).append(k)
        seen.add(of[x])
        degree[d] = degree.get(d, 0) + sum(x in e for e in links)
    return dropped, degree


def line_docs():
    r = random.Random(3)
    pool = ["".join(r.choices("abcdefgh ", k=r.randrange(4, 60))).strip() or "z" for _ in range(25)]
    docs = [(i, "\n".join(changed(r, r.choice(pool), 3) if r.random() < 0.5 else r.choice(pool) for _ in range(r.randrange(1, 8)))) for i in range(30)]
    long = "".join(r.choices("abcdefgh ", k=50_000)).strip("z ") + "z"
    return [*docs, (40, None), (41, ""), (42, "\n \n"), (43, pool[0] + "\n\n" + pool[0]), (44, long), (45, "x" + long)]


def test_lines(spark):
    docs = line_docs()
    dropped, degree = brute_lines(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("r")).withColumn("line", F.lit(0))
    rows = {x.doc_id: x for x in line_dedup.line_dedup(df).collect()}
    assert len(rows) == len(docs)
    for d, _ in docs:
        assert (rows[d].dropped, rows[d].n_links) == (dropped.get(d, []), degree.get(d, 0))
    cut = {x.doc_id: x for x in line_dedup.without_repeated_lines(df).collect()}
    for d, t in docs:
        lines = (t or "").split("\n")
        expected = t if d not in dropped else "\n".join(x for k, x in enumerate(lines) if k not in dropped[d])
        assert cut[d].text == expected and cut[d].row == "r"
    assert line_dedup.line_dedup(df.filter("false")).count() == 0
    twice = df.unionAll(df)
    assert line_dedup.line_dedup(twice).count() == 2 * len(docs)


def test_lines_of_rows_without_id_and_of_one_id(spark):
    docs = [(None, "first line of all here"), (3, "first line of all here\nown"), (5, "own\nother"), (5, "other\nfurther"), (5, "other\nfurther")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_dropped", F.lit("mine"))
    got = sorted((x.doc_id or 0, x.n_lines, x.dropped) for x in line_dedup.line_dedup(df).collect())
    assert [g for g in got if g[0] != 5] == [(0, 1, [0]), (3, 2, [])]  # a null id comes last
    mine = [g[2] for g in got if g[0] == 5]
    assert sorted(map(len, mine)) in ([0, 0, 2], [1, 1, 1]) and mine.count(max(mine)) >= 1  # two texts of one id are two documents, equal rows fare alike
    assert {type(x.n_dropped) for x in line_dedup.without_repeated_lines(df).collect()} == {int}


def test_joins_by_frequency(spark):
    left = spark.createDataFrame([(1 if i < 700 else i, i) for i in range(1000)], "k long, x long")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top")).filter("k <> 900")
    for level in (10_000, 100, 1):
        frequent.FREQUENT, before = level, frequent.FREQUENT
        try:
            got = {(r.x, r.top) for r in frequent.joined_by_frequency(left, counts, ["k"], "n", 1000).collect()}
        finally:
            frequent.FREQUENT = before
        assert got == {(i, 699 if i < 700 else None if i == 900 else i) for i in range(1000)}


def test_tables_in_between_are_removed(spark):
    import os

    from sparquill import storage

    df = spark.createDataFrame(line_docs(), "doc_id long, text string")
    folder = storage.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    line_dedup.line_dedup(df).count()
    assert {x.split("-")[0] + "-" + x.split("-")[1] for x in set(os.listdir(folder)) - before} == {"line-decisions"}
    with storage.passing(spark) as keep:
        kept = keep(storage.written(df, "kept"))
        storage.written(df, "gone")
    assert kept.count() == df.count() and not any(x.startswith("gone-") for x in os.listdir(folder))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    texts = [" ".join(word() for _ in range(80)) for _ in range(40)]
    item = " ".join(word() for _ in range(30))
    docs = [(i, t) for i, t in enumerate(texts)] + [(50, texts[0]), (51, texts[1] + " " + word()), (52, texts[2] + " " + item), (53, None), (54, "123 456"), (3, texts[3]), (3, texts[3])]
    table = spark.createDataFrame([(d, t, "en" if d % 3 else None, "src", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage, names = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        names.append(name)
        assert stage.columns == corpus_pipeline.COLUMNS
    assert names == ["language", "lines", "near_duplicates", "decontamination"]
    out = sorted(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert out == list(range(40))
    table.filter("false").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shared_passages_lose_their_repeated_lines(spark):
    import corpus_pipeline

    r = random.Random(12)
    line = lambda: " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(9))
    docs = {i: [line() for _ in range(10)] for i in range(12)}
    for i in range(20, 26):  # half, or two lines, of one other document: under 0.8
        docs[i] = docs[i - 20][: 5 if i % 2 else 2] + [line() for _ in range(5)]
    docs[30] = docs[7] + ["one more"]  # 0.8 and over
    sets = {i: shingles(" ".join(x), 5) for i, x in docs.items()}
    near = {j for i in docs for j in docs if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert near == {30}
    seen, expected = set(), {}
    for i in sorted(docs.keys() - near):
        expected[i] = [x for x in docs[i] if x not in seen]
        seen.update(docs[i])
    df = spark.createDataFrame([(i, "\n".join(x), "en", "src", 0) for i, x in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    found = {x.doc_id: x.text.split("\n") for x in corpus_pipeline.by_lines(spark, df, "").collect()}
    assert found == expected
    again = line_dedup.line_dedup(corpus_pipeline.by_lines(spark, df, ""))
    assert again.agg(F.sum("n_dropped")).first()[0] == 0


def test_lines_that_share_half_a_hash_stay_apart(spark):
    from sparquill.llm.line_dedup import line_components

    for second in ((1, 2), (1, 3)):  # with and without a shared first half
        ids = [(second[0], 1), (second[1] if second[1] != 2 else 1, 2), (5, 0), (6, 0)]
        lines = spark.createDataFrame(ids, "id long, id2 long")
        links = spark.createDataFrame([(*ids[0], *ids[2]), (*ids[1], *ids[3])], "a long, a2 long, b long, b2 long")
        got = {(r.id, r.id2): r.component for r in line_components(links, lines).collect()}
        assert set(got) == set(ids) and got[ids[0]] == got[ids[2]] != got[ids[1]] == got[ids[3]]


def test_items_are_dealt_by_number(spark):
    from sparquill.llm import decontaminate

    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "nothing of it")], "doc_id long, text string")
    rows = [(1, "three four five six seven")] * 6 + [(i, f"item number {i} is not there at all") for i in range(2, 9)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    seen = []
    block = decontaminate._block

    def counted(docs, items, *more):
        seen.append(items.count())
        return block(docs, items, *more)

    decontaminate._block = counted
    try:
        found = decontaminate.contained(docs, items, block_items=4).collect()
    finally:
        decontaminate._block = block
    assert sum(seen) == len(rows) and max(seen) == 4  # equal rows do not fall into one block
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1)}


def test_repeated_documents_of_a_label_are_one_text(spark):
    from pyspark.sql import functions as F

    from sparquill.llm import toxicity

    docs = [(i, "bad awful word" if i % 2 else "fine good text") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    more = frame.unionByName(frame.withColumn("text", F.concat("text", F.lit(" zz"))))
    plain, repeated = (toxicity.fit(d, labels, {"toxic": "toxic = 1"}) for d in (frame, more))
    assert [w.tolist() for w in plain["models"]] == [w.tolist() for w in repeated["models"]]
