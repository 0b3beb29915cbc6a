"""Pruned lookups, field postings, index segments, streams, and postings as text."""

import random

import pytest
from pyspark.sql import functions as F

from sparquill.operators import expansion, index, ranking
from sparquill.operators.index import Index
from sparquill.operators.lookup import gathered, in_ranges, one_of
from sparquill.operators.segments import Segments
from sparquill.sources import exports
from sparquill.streaming.ingest import ingest


def texts(n, seed, words=300):
    r = random.Random(seed)
    vocabulary = ["the", "walking", "walks", "walked", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(words))]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(r.choices(vocabulary, weights, k=r.randrange(0, 60))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, header string")


def documents(n, seed, first=0):
    return [(first + i, t, ["en", "de"][i % 2], " ".join(t.split()[:3])) for i, t in enumerate(texts(n, seed))]


def leaf_rows(df):
    """Rows that the scans of a plan without shuffles gave."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    leaves = execution.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Postings of many terms in pages of few rows."""
    path = str(tmp_path_factory.mktemp("large") / "ix")
    docs = frame(spark, documents(400, 1))
    Index.build(docs, path)
    table = spark.read.parquet(f"{path}/postings")
    small = str(tmp_path_factory.mktemp("large") / "small")
    table.repartitionByRange(12, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(small)
    return Index.open(spark, path), spark.read.parquet(small), docs


def test_lookup_reads_the_row_groups_of_its_terms(spark, large):
    ix, postings, _ = large
    df = {r.term: r.df for r in ix.dictionary.collect()}
    total = postings.count()
    rare = {t for t in sorted(df, key=df.get)[:2]}
    looked = ranking.of_terms(postings, rare)
    plan = looked._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and all(f"EqualTo(term,{t})" in plan for t in rare)
    assert looked.count() == sum(df[t] for t in rare)
    read = leaf_rows(looked)
    assert sum(df[t] for t in rare) <= read < total / 2  # two of twelve files at most, and one of their edges
    every = ranking.of_terms(postings, set(df))
    assert every.count() == total and leaf_rows(every) == total


def test_ranges(spark):
    numbers = spark.range(2000).withColumnRenamed("id", "x")
    r = random.Random(2)
    for n in (0, 1, 5, 128, 129, 500):
        values = set(r.sample(range(2000), n))
        assert {x.x for x in numbers.filter(one_of("x", values)).collect()} == values
        ranges = [(v, v + 3) for v in values]
        inside = {x.x for x in numbers.filter(in_ranges("x", ranges)).collect()}
        wanted = {v + k for v in values for k in range(4) if v + k < 2000}
        assert wanted <= inside and (n > 128 or inside == wanted)
    assert gathered(numbers, 1999) is None and len(gathered(numbers, 2000)[1]) == 2000


def test_scores_are_those_of_unpruned_plans(spark, large, monkeypatch):
    ix, *_ = large
    q = expansion.plain(expansion.parsed(spark.createDataFrame([(1, "walking waax wbax"), (2, "missing wcax")], "query_id int, text string")))
    required = spark.createDataFrame([(1, "waax")], "query_id int, term string")
    pruned = sorted(ranking.scored(ix, q).collect()), sorted(ranking.with_all_terms(ranking.scored(ix, q), ix, required).collect())
    monkeypatch.setattr(ranking, "gathered", lambda *a: None)
    assert pruned == (sorted(ranking.scored(ix, q).collect()), sorted(ranking.with_all_terms(ranking.scored(ix, q), ix, required).collect()))
    near = sorted(expansion.neighbours(q, ix.dictionary, least=0.1).collect())
    monkeypatch.setattr(expansion, "gathered", lambda *a: None)
    assert near == sorted(expansion.neighbours(q, ix.dictionary, least=0.1).collect()) and near


def test_neighbours_are_read_by_place(spark, large):
    """The lookup of places is a range filter of the scan, which the dictionary is sorted by."""
    ix, *_ = large
    asked = spark.createDataFrame([("walking",), ("missing",)], "term string")
    place = {r.term: r.place for r in ix.dictionary.collect()}["walking"]
    plan = expansion.neighbours(asked, ix.dictionary)._jdf.queryExecution().toString()
    assert f"GreaterThanOrEqual(place,{place - 2})" in plan and f"LessThanOrEqual(place,{place + 2})" in plan


def test_header_scores(spark, large):
    ix, _, docs = large
    q = spark.createDataFrame([(1, "walk"), (1, "waax"), (2, "nothing")], "query_id int, term string")
    headers = {r.doc_id: " ".join(w for w in (r.header or "").split() if w not in index.STOP_WORDS) for r in docs.collect()}
    average = sum(map(len, headers.values())) / len(headers)
    occurs = lambda h, w: sum(h.startswith(w, i) for i in range(len(h)))
    expected = {d: sum(occurs(h, w) for w in ("walk", "waax")) / (1 + len(h) / average - 1) for d, h in headers.items() if any(w in h for w in ("walk", "waax"))}
    got = {r.doc_id: r.header_score for r in ranking.header_scores(ix, q).collect()}
    assert got == pytest.approx(expected) and ix.avg_header == pytest.approx(average)
    plan = ranking.header_scores(ix, q)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ranking.header_scores(ix, q.filter("false")).count() == 0


def test_header_score_has_every_document(spark, tmp_path):
    from sparquill.plans import catalog, fixtures

    word = fixtures.QUERY[0]
    rows = [(1, f"{word} other\nrest", "en"), (2, "nothing here", "en"), (3, None, None), (4, f"\n{word}", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.header_score for r in catalog.header_score(spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 2, 3, 4} and got[1] > 0 and got[2] == got[3] == got[4] == 0


def test_occurrences_in_one_pass(spark):
    cases = [("aaaa", "aa"), ("", "x"), ("", ""), ("abc", ""), ("a.b.c a.b", "a.b"), (r"x\Ey\E", r"\E"), ("é😀é😀", "😀é"), ("abc", "d"), ("a" * 100_000, "aaa")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, w string")
    got = {r.i: r.n for r in df.select("i", ranking.occurrences(F.col("t"), F.col("w")).alias("n")).collect()}
    assert got == {i: sum(t.startswith(w, k) for k in range(max(len(t), 1))) for i, (t, w) in enumerate(cases)}
    assert "substring" not in df.select(ranking.occurrences(F.col("t"), F.col("w")))._jdf.queryExecution().toString()


def test_postings_are_made_in_the_row(spark):
    rows = [(1, ["b", "a", "b", "é", "b"]), (2, []), (3, None), (4, [f"w{i % 997}" for i in range(50_000)])]
    made = index.with_posts(spark.createDataFrame(rows, "doc_id long, terms array<string>"), "terms", "posts")
    got = {(r.doc_id, p.term): (p.tf, p.positions) for r in made.collect() for p in r.posts or ()}
    expected: dict = {}
    for d, words in rows:
        for i, w in enumerate(words or ()):
            expected.setdefault((d, w), []).append(i)
    assert got == {k: (len(v), v) for k, v in expected.items()}
    assert {tuple(r) for r in index.doc_stats(made).collect()} == {(1, 5, 3, 3), (2, 0, 0, 0), (3, 0, 0, 0), (4, 50_000, 997, 51)}
    for table in (index.doc_stats(made), made):
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_file_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', 50) AS text")
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    monkeypatch.setattr(index, "TASK_CHARS", 10_000)
    dealt = index.spread(spark.read.parquet(str(tmp_path / "one")))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 8 and sum(sizes) == 400 and max(sizes) < 100
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with index.sized(spark, 100 * index.TASK_ROWS):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "100"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_stemmed_build_shuffles_no_tokens_for_stems(spark):
    from sparquill.functions.porter import stem, stemmed

    rows = spark.createDataFrame([(1, ["walking", "5 m", "été", "walking"]), (2, []), (3, None)], "doc_id long, terms array<string>")
    assert {r.doc_id: r.s for r in rows.select("doc_id", stemmed("terms").alias("s")).collect()} == {1: [stem("walking"), "5 m", "été", stem("walking")], 2: [], 3: []}
    plan = index.tokenised(frame(spark, documents(5, 3)), stem=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_frequent_terms_are_broadcast(spark, large, monkeypatch):
    ix, *_ = large
    expected = sorted(ix.docs.select("doc_id", "doc_norm").filter("n_terms > 0").collect())
    assert sorted(index.doc_norms(ix.postings, ix.dictionary, ix.docs).collect()) == expected
    for frequent in (1, 10):  # one: no term has all postings
        monkeypatch.setattr(index, "FREQUENT", frequent)
        assert sorted(index.doc_norms(ix.postings, ix.dictionary, ix.docs).collect()) == expected


def contents(ix):
    out = {t: sorted(map(str, getattr(ix, t).select(*cols).collect())) for t, cols in (
        ("postings", ["term", "doc_id", "tf", "positions"]), ("dictionary", ["term", "df", "cf", "idf", "place"]), ("next_words", ["term", "rank", "next_term", "cnt"]),
        ("fields", ["term", "doc_id", "field", "tf"]), ("docs", ["doc_id", "n_terms", "n_distinct", "max_tf", "doc_norm", "lang", "header"]),
    )}
    return out | {"numbers": (ix.n_docs, ix.avg_dl, ix.avg_header, ix.mode, ix.stem)}


@pytest.mark.parametrize("stem", [False, True])
def test_merged_segments_are_a_rebuilt_index(spark, tmp_path, stem):
    path = str(tmp_path / "growing")
    growing = Segments(spark, path, stem=stem)
    first, second, third = documents(30, 1), documents(20, 2, first=20), documents(10, 3, first=35)  # 20-29 and 35-39 are replaced
    growing.add(frame(spark, first))
    live = {d[0]: d for d in first}
    assert contents(Index.open(spark, path)) == contents(Index.build(frame(spark, list(live.values())), stem=stem))
    growing.add(frame(spark, second))
    growing.delete(spark.createDataFrame([(3,), (25,), (40,), (999,), (None,)], "doc_id long"))
    growing.add(frame(spark, third))  # brings 40 back
    live |= {d[0]: d for d in second}
    for d in (3, 25, 40):
        live.pop(d, None)
    live |= {d[0]: d for d in third}
    merged = Index.open(spark, path)
    assert contents(merged) == contents(Index.build(frame(spark, list(live.values())), stem=stem))
    # Merging in steps and at once is the same.
    assert Segments(spark, path).numbers() == [0, 1, 2, 3] and Segments(spark, path).merges() == [0, 3]
    growing.delete(spark.createDataFrame([(d,) for d in live], "doc_id long"))
    assert Index.open(spark, path).n_docs == 0
    growing.add(frame(spark, first))
    assert contents(Index.open(spark, path)) == contents(Index.build(frame(spark, first), stem=stem))


def test_segment_that_failed_or_is_repeated(spark, tmp_path):
    path = str(tmp_path / "growing")
    growing = Segments(spark, path)
    with pytest.raises(ValueError):
        growing.index()
    rows = documents(10, 4)
    growing.add(frame(spark, rows), 0)
    growing.add(frame(spark, documents(10, 5)), 0)  # a number is committed once
    frame(spark, rows).selectExpr("doc_id", "lang", "header", "array('lost') AS terms", "array('lost') AS field_terms").write.parquet(f"{path}/terms/number=1")  # written, not committed
    assert contents(Index.open(spark, path)) == contents(Index.build(frame(spark, rows)))
    growing.add(frame(spark, documents(5, 6, first=100)), 1)
    assert Index.open(spark, path).n_docs == 15
    exports.clear(spark, path)
    assert not (tmp_path / "growing").exists()


def test_streamed_batches_are_searchable(spark, tmp_path):
    rows = documents(40, 7)
    for k in range(4):
        frame(spark, rows[k * 10 : k * 10 + 12]).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))  # two documents come again in the next batch
    stream = spark.readStream.schema("doc_id long, text string, lang string, header string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    path = str(tmp_path / "out")
    ingest(stream, path, str(tmp_path / "cp")).awaitTermination(300)
    assert len(Segments(spark, path).numbers()) == 4
    ix = Index.open(spark, path)
    assert contents(ix) == contents(Index.build(frame(spark, rows)))
    found = expansion.search(ix, spark.createDataFrame([(1, "walking waax")], "query_id int, text string"), expand=False)
    assert found.count() > 0


def test_posting_lines_round_trip(spark, large, tmp_path, monkeypatch):
    ix, *_ = large
    monkeypatch.setattr(exports, "LINE_DOCS", 7)  # frequent terms are cut into pieces
    path = str(tmp_path / "runs")
    exports.write_posting_runs(ix, path)
    assert sorted(x.name for x in (tmp_path / "runs").iterdir() if x.is_dir()) == sorted(f"shard={s if s != '#' else '%23'}" for s in exports.SHARDS)
    back = exports.read_posting_runs(spark, path)
    own = ix.postings.select("term", F.col("doc_id").cast("string").alias("doc_id"), "tf", "positions")
    assert sorted(map(str, back.collect())) == sorted(map(str, own.collect()))


def test_old_posting_folder(spark, large, tmp_path):
    """27 files whose lines hold no term, found by the dictionary's line numbers."""
    ix, *_ = large
    (tmp_path / "old").mkdir()
    lines = {r.term: r.line for r in exports.posting_lines(ix).collect()}
    lines["5 m"] = "1 2 7 9,"
    numbers = {}
    for s in exports.SHARDS:
        own = sorted(t for t in lines if (t[0] if "a" <= t[0] <= "z" else "#") == s)
        numbers |= {t: i for i, t in enumerate(own)}
        (tmp_path / "old" / f"postings-{s}.txt").write_text("".join(lines[t] + "\n" for t in own))
    (tmp_path / "dictionary.txt").write_text("".join(f"{len(t)} {t} 1 2 0.5 {n} next word\n" for t, n in numbers.items()))
    dic = exports.read_old_dictionary(spark, str(tmp_path / "dictionary.txt"))
    assert {(r.term, r.line_no) for r in dic.collect()} == set(numbers.items()) and dic.filter("term = '5 m'").first().next_terms == ["next", "word"]
    found = exports.read_posting_files(spark, str(tmp_path / "old"), dic)
    own = {str(x) for x in ix.postings.select("term", F.col("doc_id").cast("string").alias("doc_id"), "tf", "positions").collect()}
    assert {str(x) for x in found.filter("term <> '5 m'").collect()} == own
    assert [(x.doc_id, x.tf, x.positions) for x in found.filter("term = '5 m'").collect()] == [("1", 2, [7, 9])]


def test_bounded_search_gives_the_same_rows_from_fewer_postings(spark, tmp_path):
    from sparquill.operators.bounds import Bounds

    r = random.Random(9)
    rare = [f"rare{chr(97 + i)}" for i in range(6)]
    # Documents on one subject have neighbouring ids; everything else is noise.
    rows = [(i, f"{t} {' '.join(r.choices(rare, k=6)) if 300 <= i < 360 else ''}", "en", "") for i, t in enumerate(texts(1200, 10))]
    ix = Index.build(frame(spark, rows), str(tmp_path / "ix"))
    bounds = Bounds.build(ix, str(tmp_path / "bounds"), block_docs=32)
    for text, k in (("rarea rareb walking", 10), ("rarec", 5), ("walking waax", 3), ("rarea missing", 2000), ("missing", 5)):
        q = expansion.plain(expansion.parsed(spark.createDataFrame([(1, text), (2, "rared")], "query_id int, text string")))
        assert sorted(bounds.search(q, k).collect()) == sorted(ranking.best(ranking.scored(ix, q), k).collect())
    # No document exceeds the bound of its block.
    q = expansion.plain(expansion.parsed(spark.createDataFrame([(1, "rarea rareb walking the waax")], "query_id int, text string")))
    places = {d: i for i, d in enumerate(sorted(x.doc_id for x in ix.docs.filter("n_terms > 0").collect()))}
    bound = {x.block: x.bound for x in bounds.of_blocks(q).collect()}
    assert all(x.score <= bound[places[x.doc_id] // 32] for x in ranking.scored(ix, q).collect())
    q = expansion.plain(expansion.parsed(spark.createDataFrame([(1, "rarea rareb walking")], "query_id int, text string")))
    terms = {"rarea", "rareb", "walking"}
    left = ranking.of_terms(bounds.left_to_score(q, 10).postings, terms)
    assert left.count() < ranking.of_terms(ix.postings, terms).count() / 3
    assert "PushedFilters" in left._jdf.queryExecution().toString() and "LessThanOrEqual(doc_id" in left._jdf.queryExecution().toString()


def test_posts_of_slices_with_nulls_and_offsets():
    import pyarrow as pa

    rows = [["x"], ["b", "a", "b", "é", "b"], None, [], ["a", "😀", "a"]]
    got = index.posts_of_slice(pa.array(rows, pa.list_(pa.string()))[1:]).to_pylist()
    assert [[(p["term"], p["tf"], p["positions"]) for p in r] for r in got] == [[("a", 1, [1]), ("b", 3, [0, 2, 4]), ("é", 1, [3])], [], [], [("a", 2, [0, 2]), ("😀", 1, [1])]]
    assert index.posts_of_slice(pa.array([None, []], pa.list_(pa.string()))).to_pylist() == [[], []]


def test_an_index_without_next_words_has_the_same_other_tables(spark, tmp_path):
    rows = frame(spark, documents(30, 4))
    bare, whole = Index.build(rows, str(tmp_path / "bare"), next_words=False), Index.build(rows, str(tmp_path / "whole"))
    assert bare.next_words is None and not (tmp_path / "bare" / "next_words").exists()
    for t in ("postings", "dictionary", "fields", "docs"):
        assert sorted(map(str, getattr(bare, t).collect())) == sorted(map(str, getattr(whole, t).collect()))


def test_norms_take_frequent_terms_from_documents(spark, large, monkeypatch):
    ix, *_ = large
    monkeypatch.setattr(index, "FREQUENT", 10)
    expected = sorted(index.doc_norms(ix.postings, ix.dictionary, ix.docs).collect())
    assert sorted(index.doc_norms(ix.postings, ix.dictionary, ix.docs, ix.postings.repartition("doc_id")).collect()) == expected


def test_postings_meet_their_documents_before_their_queries(spark, large):
    """Hits of many queries are not shuffled: one exchange takes the postings to their documents, none has a query's columns before the best are ranked."""
    ix, *_ = large
    rows = [(i, "0", k, r.term, 1) for i in range(20) for k, r in enumerate(ix.dictionary.orderBy("term").limit(3).collect())]
    plan = ranking.matches(ix, spark.createDataFrame(rows, "query_id int, variant_id string, qpos int, term string, weight int"))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("hashpartitioning(doc_id" in e for e in exchanges) and not any("doc_id" in e and "query_id" in e for e in exchanges)


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of what is written, by path."""
    kind, found = type(spark.range(1).write), {}
    before = kind.parquet

    def parquet(self, path, *args, **kw):
        found[path] = self._df._jdf.queryExecution().executedPlan().toString()
        return before(self, path, *args, **kw)

    monkeypatch.setattr(kind, "parquet", parquet)
    return found


def test_bounds_are_made_where_the_postings_are_read(spark, tmp_path, plans):
    from sparquill.operators.bounds import UNIT_BM25, UNIT_SHARE, Bounds

    rows = documents(300, 12)
    ix = Index.build(frame(spark, rows), str(tmp_path / "ix"), next_words=False)
    bounds = Bounds.build(ix, str(tmp_path / "bounds"), block_docs=16)
    assert "Exchange" not in plans[str(tmp_path / "bounds" / "bounds")] and "Join" not in plans[str(tmp_path / "bounds" / "bounds")]
    places = {d: i // 16 for i, d in enumerate(sorted(x.doc_id for x in ix.docs.filter("n_terms > 0").collect()))}
    lengths, most = {x.doc_id: x.n_terms for x in ix.docs.collect()}, {}
    for p in ix.postings.collect():
        n, at = lengths[p.doc_id], (p.term, places[p.doc_id])
        made = (ranking.K1 + 1) * p.tf / (ranking.K1 * (1 - ranking.B + ranking.B * n / ix.avg_dl) + p.tf), p.tf / n
        most[at] = tuple(map(max, most.get(at, made), made))
    got = {(x.term, x.block): (x.bm25 / UNIT_BM25, x.share / UNIT_SHARE) for x in bounds.bounds.groupBy("term", "block").agg(F.max("bm25").alias("bm25"), F.max("share").alias("share")).collect()}
    assert got.keys() == most.keys() and all(0 <= g - m <= 0.00101 for at in most for g, m in zip(got[at], most[at]))


def test_bounds_of_merged_postings_and_of_named_documents(spark, tmp_path):
    from sparquill.operators.bounds import Bounds

    growing = Segments(spark, str(tmp_path / "growing"))
    growing.add(frame(spark, documents(120, 13)))
    named = frame(spark, documents(120, 13)).withColumn("doc_id", F.concat(F.lit("é-"), "doc_id"))
    q = expansion.plain(expansion.parsed(spark.createDataFrame([(1, "walking waax"), (2, "missing")], "query_id int, text string")))
    for k, ix in enumerate((growing.index(), Index.build(named, str(tmp_path / "named"), next_words=False))):
        found = Bounds.build(ix, str(tmp_path / f"bounds-{k}"), block_docs=8).search(q, 5)
        assert sorted(found.collect()) == sorted(ranking.best(ranking.scored(ix, q), 5).collect()) != []


def test_postings_are_counted_as_they_are_written(spark, tmp_path, plans):
    """One shuffle makes postings, and norms join no posting by its term, whichever terms are dealt out as frequent."""
    ix = Index.build(frame(spark, documents(200, 14)), str(tmp_path / "ix"), next_words=False)
    assert plans[str(tmp_path / "ix" / "postings")].count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plans[str(tmp_path / "ix" / "postings")]
    termed = index.with_stats(index.tokenised(frame(spark, documents(200, 14)))).persist()
    assert sorted(termed.select("doc_id", "n_terms", "n_distinct", "max_tf").collect()) == sorted(index.doc_stats(termed).collect())
    df = {x.term: x.df for x in ix.dictionary.collect()}
    expected = sorted(ix.postings.collect(), key=lambda p: (p.term, p.doc_id))
    norms = sorted(index.doc_norms(ix.postings, ix.dictionary, ix.docs).collect())
    for k, frequent in enumerate(([], sorted(df, key=df.get)[-3:], sorted(df))):
        path = str(tmp_path / f"counted-{k}")
        index.write_counted_postings(termed, path, frequent)
        made = spark.read.parquet(path)
        assert sorted(made.select("term", "doc_id", "tf", "positions").collect(), key=lambda p: (p.term, p.doc_id)) == expected
        assert {(x.term, x.df) for x in made.collect()} == {(t, None if t in frequent else n) for t, n in df.items()}
        assert sorted(index.counted_norms(made, ix.dictionary, ix.docs, frequent).collect()) == norms
        for name in made.inputFiles():
            keys = [(x.term, x.doc_id) for x in spark.read.parquet(name).coalesce(1).collect()]
            assert keys == sorted(keys)
    termed.unpersist()


def test_large_tables_of_a_build_are_compressed_well(spark, tmp_path):
    from pyarrow import parquet

    from sparquill.operators.bounds import Bounds

    Bounds.build(Index.build(frame(spark, documents(20, 15)), str(tmp_path / "ix"), next_words=False), str(tmp_path / "bounds"))
    for table in ("ix/postings", "bounds/bounds"):
        assert {parquet.ParquetFile(f).metadata.row_group(0).column(0).compression for f in (tmp_path / table).glob("*.parquet") if parquet.ParquetFile(f).num_row_groups} == {"ZSTD"}
