"""SQL for DuckDB that gives the same rows as the queries of ``catalog``."""

from __future__ import annotations

from sparquill.functions import tokenize
from sparquill.functions.dialect import DUCKDB
from sparquill.operators.index import STOP_WORDS
from sparquill.plans import fixtures, rules, stems


def values(rows: list[tuple], columns: str) -> str:
    def one(x: object) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    body = ", ".join(f"({', '.join(map(one, r))})" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def kept_words(x: str) -> str:
    return f"list_filter({tokenize.words(x, DUCKDB)}, lambda s: s NOT IN ({STOP}))"


ALL_WORDS = tokenize.words("text", DUCKDB)
WORDS = kept_words("text")
HEADER_WORDS = kept_words("split_part(text, chr(10), 1)")

INDEX = f"""
words AS (SELECT doc_id, lang, array_to_string({HEADER_WORDS}, ' ') AS header, {WORDS} AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM words),
post AS (SELECT term, doc_id, CAST(count(*) AS INT) AS tf, list(pos ORDER BY pos) AS positions FROM tok GROUP BY term, doc_id),
sizes AS (SELECT d.doc_id, d.lang, d.header, CAST(coalesce(sum(tf), 0) AS BIGINT) AS n_terms, count(tf) AS n_distinct, CAST(coalesce(max(tf), 0) AS BIGINT) AS max_tf
  FROM words d LEFT JOIN post p ON d.doc_id = p.doc_id GROUP BY d.doc_id, d.lang, d.header),
corpus AS (SELECT count(*) AS n_docs, CAST(floor(sum(n_terms) / count(*)) AS BIGINT) AS avg_dl FROM sizes),
dict AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, round_even(log2(n_docs // count(*)), 2) AS idf FROM post, corpus GROUP BY term, n_docs),
norms AS (SELECT doc_id, round_even(sqrt(sum(pow(idf * tf / n_terms, 2))), 4) AS doc_norm FROM post JOIN dict USING (term) JOIN sizes USING (doc_id) GROUP BY doc_id),
docs AS (SELECT s.*, coalesce(doc_norm, 0.0) AS doc_norm FROM sizes s LEFT JOIN norms USING (doc_id))
"""

SCORES = """
known AS (SELECT q.*, df, coalesce(idf, 0.0) AS idf FROM qt q LEFT JOIN dict USING (term)),
per_query AS (SELECT query_id, variant_id, count(*) AS n, CAST(sum(weight * weight) AS DOUBLE) AS w2 FROM qt GROUP BY query_id, variant_id),
hits AS (SELECT query_id, variant_id, doc_id, qpos, p.tf, k.df, k.idf, weight, positions FROM post p JOIN known k USING (term)),
base AS (SELECT query_id, variant_id, doc_id,
    sum(log2((n_docs - df + 0.5) / (df + 0.5)) * (2.2 * tf) / (1.2 * (0.25 + 0.75 * n_terms / avg_dl) + tf) ORDER BY qpos) AS bm25,
    CASE WHEN doc_norm > 0 THEN sum(tf / n_terms * idf * weight ORDER BY qpos) / (doc_norm * sqrt(w2)) ELSE 0.0 END AS cosine,
    len(list_filter(list(qpos ORDER BY qpos), lambda x, i: x = i - 1)) AS prefix, n, n_terms
  FROM hits JOIN docs USING (doc_id) JOIN per_query USING (query_id, variant_id), corpus
  GROUP BY query_id, variant_id, doc_id, doc_norm, w2, n, n_terms, n_docs),
places AS (SELECT query_id, variant_id, doc_id, qpos, unnest(positions) AS pos FROM hits),
ends AS (SELECT query_id, variant_id, doc_id, qpos, list_min(positions) AS lo, list_max(positions) AS hi FROM hits),
paired AS (SELECT p.*, prefix FROM places p JOIN base USING (query_id, variant_id, doc_id)
  WHERE (p.qpos < prefix AND EXISTS (SELECT 1 FROM ends e WHERE e.query_id = p.query_id AND e.variant_id = p.variant_id AND e.doc_id = p.doc_id AND e.qpos > p.qpos AND e.hi > p.pos))
     OR EXISTS (SELECT 1 FROM ends e WHERE e.query_id = p.query_id AND e.variant_id = p.variant_id AND e.doc_id = p.doc_id AND e.qpos < p.qpos AND e.qpos < prefix AND e.lo < p.pos)),
steps AS (SELECT query_id, variant_id, doc_id, prefix, qpos AS a, lead(qpos) OVER w AS b, lead(pos) OVER w - pos AS gap
  FROM paired WINDOW w AS (PARTITION BY query_id, variant_id, doc_id ORDER BY pos)),
gains AS (SELECT s.query_id, s.variant_id, doc_id, a, b, (x.idf + y.idf) / (CAST(gap AS DOUBLE) * gap) AS gain FROM steps s
  JOIN known x ON x.query_id = s.query_id AND x.variant_id = s.variant_id AND x.qpos = a
  JOIN known y ON y.query_id = s.query_id AND y.variant_id = s.variant_id AND y.qpos = b WHERE a < b AND a < prefix),
sums AS (SELECT g.query_id, g.variant_id, g.doc_id, k.qpos, least(1.0, k.idf) AS top, sum(gain * (CAST(a <= k.qpos AS INT) + CAST(b <= k.qpos AS INT))) AS acc
  FROM gains g JOIN known k ON k.query_id = g.query_id AND k.variant_id = g.variant_id GROUP BY ALL),
near AS (SELECT query_id, variant_id, doc_id, sum(top * acc * 2.2 / (acc + 1.2 * (0.5 + 0.5 * n_terms / avg_dl))) AS proximity
  FROM sums JOIN docs USING (doc_id), corpus GROUP BY query_id, variant_id, doc_id),
scores AS (SELECT query_id, variant_id, doc_id, bm25, cosine, CASE WHEN n > 1 THEN coalesce(proximity, 0.0) ELSE 0.0 END AS proximity,
    round_even(bm25 + 0.5 * cosine + CASE WHEN n > 1 THEN coalesce(proximity, 0.0) ELSE 0.0 END, 3) AS score
  FROM base LEFT JOIN near USING (query_id, variant_id, doc_id))
"""

BEST = """SELECT query_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, max(score) AS score FROM scores GROUP BY query_id, doc_id)) WHERE rank <= 50"""

LITERAL = "qt AS " + values([(1, "0", i, t, 1) for i, t in enumerate(fixtures.QUERY)], "query_id, variant_id, qpos, term, weight")
BATCH = f"""
parsed AS (SELECT item_id AS query_id, {WORDS} AS w FROM benchmark),
firsts AS (SELECT query_id, term, min(p) AS p FROM (SELECT query_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM parsed) GROUP BY query_id, term),
qt AS (SELECT query_id, '0' AS variant_id, row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS qpos, term, 1 AS weight FROM firsts)
"""


def index_sql(select: str, *more: str) -> str:
    return f"WITH {', '.join([INDEX, *more])} {select}"


def grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x})), lambda i: substring({x}, i, 2)))"


def jaccard(a: str, b: str) -> str:
    x, y = grams(a), grams(b)
    return f"coalesce(len(list_intersect({x}, {y})) / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0.0)"


NEIGHBOURS = f"""
around AS (SELECT term, [lag(term, 2) OVER w, lag(term, 1) OVER w, lead(term, 1) OVER w, lead(term, 2) OVER w] AS c FROM dict WINDOW w AS (ORDER BY term)),
near_pairs AS MATERIALIZED (SELECT term, unnest(c) AS candidate, unnest([-2, -1, 1, 2]) AS step FROM around WHERE term IN (SELECT term FROM qt)),
near_terms AS (SELECT term, candidate, step FROM near_pairs WHERE candidate IS NOT NULL AND {jaccard("term", "candidate")} >= 0.71)
"""
VARIANTS = """
cand AS (SELECT DISTINCT term, candidate FROM near_terms UNION SELECT term, term FROM qt),
swaps AS (SELECT query_id, qpos AS place, candidate, qpos || ':' || candidate AS variant_id FROM qt JOIN cand USING (term)),
rewritten AS (SELECT s.query_id, s.variant_id, q.qpos, CASE WHEN q.qpos = s.place THEN s.candidate ELSE q.term END AS term FROM swaps s JOIN qt q USING (query_id)),
full_qt AS (SELECT query_id, variant_id, qpos, term, 1 AS weight FROM rewritten r WHERE NOT EXISTS
  (SELECT 1 FROM rewritten o WHERE o.query_id = r.query_id AND o.variant_id = r.variant_id GROUP BY o.term HAVING count(*) > 1))
"""


PAGE_TITLE = r"lower(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)))"
PAGE_LANG = r"""nullif(regexp_replace(lower(trim(regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1))), '\P{L}$', ''), '')"""


# The literal query with all its expansions: neighbours, stems, words the thesaurus does not know alone and with double weight.
EXPANDED = (
    LITERAL.replace("qt AS", "qt0 AS"),
    NEIGHBOURS.replace("FROM qt)", "FROM qt0)"),
    stems.stems_sql("qt0"),
    "stem_terms AS (SELECT term, stem AS candidate FROM stems WHERE stem <> term AND stem IN (SELECT term FROM dict))",
    VARIANTS.replace("FROM qt ", "FROM qt0 ").replace("FROM qt)", "FROM qt0)").replace("JOIN qt q", "JOIN qt0 q").replace("FROM near_terms", "FROM near_terms UNION SELECT term, candidate FROM stem_terms"),
    f"known_words AS (SELECT query_id, term FROM qt0 WHERE term NOT IN ({', '.join(repr(t) for t in fixtures.THESAURUS)}))",
    "every_variant AS (SELECT query_id, variant_id, qpos, term FROM full_qt UNION ALL SELECT query_id, 'word:' || term, 0, term FROM known_words)",
    "qt AS (SELECT e.query_id, e.variant_id, e.qpos, e.term, CASE WHEN k.term IS NULL THEN 1 ELSE 2 END AS weight FROM every_variant e LEFT JOIN known_words k ON k.query_id = e.query_id AND k.term = e.term)",
    SCORES,
)


# Tokens by their stems, without those whose stem is a stop word, counted again; stems of the query likewise.
STEMMED_TOP = index_sql(BEST, LITERAL.replace("qt AS", "qt0 AS"), "qt AS (SELECT query_id, variant_id, qpos, stem AS term, weight FROM qt0 JOIN stems USING (term))", SCORES.replace("0.5 * cosine", "1.0 * cosine"))
STEMMED_TOP = STEMMED_TOP.replace("tok AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM words)", f"""said AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS nth FROM (SELECT doc_id, {ALL_WORDS} AS w FROM documents)),
{stems.stems_sql(f"(SELECT term FROM said UNION SELECT unnest({list(fixtures.QUERY)}))")},
tok AS (SELECT doc_id, stem AS term, row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS pos FROM said JOIN stems USING (term) WHERE stem NOT IN ({STOP}))""")


def all_sql() -> dict[str, str]:
    q = {
        "tokens_basic": index_sql("SELECT doc_id, pos, term FROM tok"),
        "tokens_clean": f"SELECT doc_id, array_to_string(list_filter({tokenize.terms('text', DUCKDB)}, lambda s: s NOT IN ({STOP})), '|') AS terms FROM documents",
        "postings": index_sql("SELECT term, doc_id, tf FROM post"),
        "positions": index_sql("SELECT term, doc_id, array_to_string(positions, ' ') AS positions FROM post"),
        "doc_stats": index_sql("SELECT doc_id, n_terms, n_distinct, max_tf FROM docs"),
        "corpus_stats": index_sql("SELECT n_docs, avg_dl, (SELECT count(*) FROM dict) AS n_terms FROM corpus"),
        "dictionary": index_sql("SELECT term, df, cf, idf FROM dict"),
        "doc_norm": index_sql("SELECT doc_id, doc_norm FROM docs"),
        "bigram_counts": index_sql("SELECT term, next_term, count(*) AS cnt FROM (SELECT term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS next_term FROM tok) WHERE next_term IS NOT NULL GROUP BY ALL"),
        "dictionary_listing": index_sql("SELECT CASE WHEN regexp_matches(term, '^[a-z]') THEN term[1] ELSE 'Numbers and Symbols' END AS heading, term, term || ' : ' || cf AS entry FROM dict"),
        "dictionary_display": index_sql("SELECT term || ' : ' || cf AS value FROM dict UNION ALL SELECT DISTINCT CASE WHEN regexp_matches(term, '^[a-z]') THEN term[1] ELSE 'Numbers and Symbols' END FROM dict"),
        "postings_shards": index_sql("SELECT CASE WHEN regexp_matches(term, '^[a-z]') THEN term[1] ELSE '#' END AS shard, count(*) AS n_postings, count(DISTINCT term) AS n_terms FROM post GROUP BY 1"),
        "posting_lines": index_sql("SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM post"),
        "streamed_index": index_sql("SELECT term, df, cf, idf, row_number() OVER (ORDER BY term) - 1 AS place FROM dict"),
        "trimmed_titles": "SELECT doc_id, lower(trim(trim('<H3> <TI>' || split_part(coalesce(text, ''), chr(10), 1) || '</TI></H3>', '<H3> TI'), '</TIH3<>')) AS title FROM documents",
        "stop_word_table": index_sql("SELECT doc_id, pos, term FROM tok WHERE term NOT IN (SELECT term FROM dict, corpus WHERE df * 4 >= n_docs)"),
        "stemmed_top50": STEMMED_TOP,
        "merged_segments": index_sql("SELECT term, df, cf, idf, row_number() OVER (ORDER BY term) - 1 AS place FROM dict").replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"),
        "bm25_top50": index_sql("SELECT doc_id, score, rank FROM (SELECT doc_id, round_even(bm25, 3) AS score, row_number() OVER (ORDER BY round_even(bm25, 3) DESC, doc_id) AS rank FROM scores) WHERE rank <= 50", LITERAL, SCORES),
        "cosine": index_sql("SELECT doc_id, round_even(cosine, 4) AS cosine FROM scores", LITERAL, SCORES),
        "proximity": index_sql("SELECT doc_id, round_even(proximity, 4) AS proximity FROM scores", LITERAL, SCORES),
        "combined_top50": index_sql(BEST, LITERAL, SCORES),
        "bounded_top50": index_sql(BEST, LITERAL, SCORES),
        "equal_scores": index_sql(f"SELECT query_id, score, string_agg(doc_id, ' ' ORDER BY doc_id) AS docs FROM ({BEST}) GROUP BY query_id, score", LITERAL, SCORES),
        "batch_queries": index_sql(BEST, BATCH, SCORES),
        "trec_run": index_sql(f"SELECT query_id || ' 0 ' || doc_id || ' ' || score || ' 1 3' AS value FROM ({BEST})", LITERAL, SCORES),
        "language_filter": index_sql(BEST.replace("FROM scores", "FROM scores JOIN docs USING (doc_id) WHERE lang IN ('en', 'es')"), LITERAL, SCORES),
        "all_terms_filter": index_sql(f"SELECT query_id, doc_id, score FROM scores JOIN (SELECT doc_id FROM post WHERE term IN ({', '.join(repr(t) for t in fixtures.QUERY)}) GROUP BY doc_id HAVING count(*) = {len(fixtures.QUERY)}) USING (doc_id)", LITERAL, SCORES),
        "language_facet": "SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL",
        "language_normalise": rules.LANGUAGE_SQL,
        "important_words": index_sql(f"SELECT query_id, CAST(qpos AS INT) AS qpos, term FROM qt WHERE NOT EXISTS (SELECT 1 FROM dict WHERE dict.term = qt.term AND df >= {fixtures.KNOWN_DF})", BATCH),
        "porter_stem": index_sql("SELECT term, stem FROM stems", stems.stems_sql("dict")),
        "stemmed_index": f"""WITH words AS (SELECT doc_id, unnest({ALL_WORDS}) AS term FROM documents), {stems.stems_sql("words")},
          kept AS (SELECT doc_id, stem FROM words JOIN stems USING (term) WHERE stem NOT IN ({STOP}))
          SELECT stem AS term, count(DISTINCT doc_id) AS df, count(*) AS cf, round_even(log2((SELECT count(*) FROM documents) // count(DISTINCT doc_id)), 2) AS idf FROM kept GROUP BY stem""",
        "search_expanded": index_sql(BEST, *EXPANDED),
        "ngram_jaccard": index_sql(f"SELECT term, next_term, round_even({jaccard('term', 'next_term')}, 4) AS similarity FROM (SELECT term, lead(term) OVER (ORDER BY term) AS next_term FROM dict WHERE length(term) > 1) WHERE next_term IS NOT NULL AND {jaccard('term', 'next_term')} >= 0.71"),
        "vocab_neighbours": index_sql("SELECT term, candidate, step FROM near_terms", "qt AS (SELECT term FROM dict)", NEIGHBOURS),
        "expand_variants": index_sql("SELECT query_id, variant_id, qpos, term, weight FROM full_qt", LITERAL, NEIGHBOURS, VARIANTS),
        "variant_merge": index_sql(BEST, LITERAL.replace("qt AS", "qt0 AS"), NEIGHBOURS.replace("FROM qt)", "FROM qt0)"), VARIANTS.replace("FROM qt ", "FROM qt0 ").replace("FROM qt)", "FROM qt0)").replace("JOIN qt q", "JOIN qt0 q").replace("full_qt AS", "qt AS"), SCORES),
        "title_lang_from_pages": f"SELECT page_id, {PAGE_TITLE} AS title, {PAGE_LANG} AS lang FROM pages",
        "sgml_parse": "SELECT 'D-' || doc_id AS doc_id, 'title ' || doc_id AS title, lang, array_to_string(list_transform(list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda x: x <> ''), lambda x: ' ' || lower(x)), '') AS text FROM documents",
        "tf_over_maxtf": index_sql(f"SELECT doc_id, round_even(tf / max_tf, 5) AS score FROM post JOIN docs USING (doc_id) WHERE term = '{fixtures.QUERY[0]}'"),
    }
    top = "SELECT term, CAST(rank AS INT) AS rank, next_term, cnt FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY cnt DESC, next_term) AS rank FROM bi) WHERE rank <= 5"
    bi = "bi AS (SELECT term, next_term, count(*) AS cnt FROM (SELECT term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS next_term FROM tok) WHERE next_term IS NOT NULL GROUP BY ALL)"
    q["top5_next"] = index_sql(top, bi)
    q["autocomplete"] = index_sql(f"SELECT rank, next_term FROM ({top}) WHERE term = '{fixtures.QUERY[0]}'", bi)
    tf = lambda w: f"len(list_filter(range(1, greatest(length(header), 1) + 1), lambda i: substring(header, i, {len(w)}) = '{w}'))"
    q["header_score"] = index_sql(
        "SELECT 1 AS query_id, doc_id, CASE WHEN htf > 0 THEN round_even(htf / (1.0 + (length(header) / avg_len - 1.0)), 4) ELSE 0.0 END AS header_score FROM (SELECT doc_id, header, " + " + ".join(map(tf, fixtures.QUERY)) + " AS htf FROM docs), (SELECT avg(length(header)) AS avg_len FROM docs)"
    )
    htf = f"len(list_filter(range(1, greatest(length(header), 1) + 1), lambda i: substring(header, i, length(k.term)) = k.term))"  # noqa: F541
    q["bm25f"] = index_sql(
        f"""SELECT doc_id, round_even(sum(CASE WHEN idf > 0 THEN mix / (1.2 + mix) * log2(n_docs / idf) ELSE 0.0 END), 4) AS bm25f FROM (
          SELECT p.doc_id, k.idf, n_docs, p.tf / (n_terms / CAST(avg_dl AS DOUBLE)) * p.tf * 0.6 + CASE WHEN length(header) > 0 THEN {htf} / (length(header) / avg_len) ELSE 0.0 END * {htf} * 0.4 AS mix
          FROM post p JOIN known k USING (term) JOIN docs USING (doc_id), corpus, (SELECT avg(length(header)) AS avg_len FROM docs)) GROUP BY doc_id""",
        LITERAL,
        SCORES,
    )
    return q | {f"rule_{name}": rules.sql(name) for name in rules.RULES}


