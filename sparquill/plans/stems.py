"""The suffix stemmer as SQL for DuckDB, by patterns over the letters, apart from ``functions.porter``.

With C for a run of consonants and V for one of vowels a stem's measure is told by patterns: over zero
if it holds VC, one if it is (C)VC(V), over one if it holds VCVC. A y is a vowel behind a consonant.
"""

from __future__ import annotations

C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
START = f"^({C}{V}|[aeiou]+)"  # a leading y is a consonant
OVER_0, ONE, OVER_1, VOWEL = f"{START}{C}", f"{START}{C}({V})?$", f"{START}{C}{V}{C}", f"^({C}[aeiouy]|[aeiou])"
SHORT = f"^{C}[aeiouy][^aeiouwxy]$"

# Suffixes and what they become, longest first where one ends in another.
SECOND = "ational ate, tional tion, enci ence, anci ance, izer ize, bli ble, alli al, entli ent, eli e, ousli ous, ization ize, ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble, logi log"
THIRD = "icate ic, ative -, alize al, iciti ic, ical ic, ful -, ness -"
FOURTH = "ement, ment, ent, al, ance, ence, er, ic, able, ible, ant, ion, ou, ism, ate, iti, ous, ive, ize"


def _is(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _without(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def _swaps(x: str, rules: str) -> str:
    pairs = sorted((r.split() for r in rules.split(", ")), key=lambda r: -len(r[0]))
    cases = (f"WHEN suffix({x}, '{a}') THEN CASE WHEN {_is(_without(x, len(a)), OVER_0)} THEN {_without(x, len(a))} || '{b.replace('-', '')}' ELSE {x} END" for a, b in pairs)
    return f"CASE {' '.join(cases)} ELSE {x} END"


def _drops(x: str) -> str:
    cases = []
    for a in sorted(FOURTH.split(", "), key=lambda a: -len(a)):
        stem = _without(x, len(a))
        able = _is(stem, OVER_1) + (f" AND {_is(stem, '[st]$')}" if a == "ion" else "")
        cases.append(f"WHEN suffix({x}, '{a}') THEN CASE WHEN {able} THEN {stem} ELSE {x} END")
    return f"CASE {' '.join(cases)} ELSE {x} END"


def stems_sql(source: str) -> str:
    """CTEs that end in ``stems(term, stem)`` for the distinct terms of ``source(term)``."""
    cut = "CASE WHEN suffix(w, 'ed') THEN left(w, length(w) - 2) WHEN suffix(w, 'ing') THEN left(w, length(w) - 3) END"
    mended = f"CASE WHEN {_is('c', '(at|bl|iz)$')} THEN c || 'e' WHEN length(c) > 1 AND right(c, 1) = c[-2] AND ({_is('c', '[^aeioulszy]$')} OR {_is('c', '((^|[aeiou])y|[^aeiouy])(yy)+$')}) THEN left(c, length(c) - 1) WHEN {_is('c', ONE)} AND {_is('c', SHORT)} THEN c || 'e' ELSE c END"
    return f"""
s0 AS (SELECT DISTINCT term, term AS w, regexp_matches(term, '^[a-z]+$') AND length(term) > 2 AS s FROM {source}),
s1 AS (SELECT term, s, CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN left(w, length(w) - 2) WHEN suffix(w, 'ss') THEN w WHEN suffix(w, 's') THEN left(w, length(w) - 1) ELSE w END AS w FROM s0 WHERE s),
s2 AS (SELECT term, w, CASE WHEN suffix(w, 'eed') THEN NULL ELSE {cut} END AS c FROM s1),
s3 AS (SELECT term, CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_is(_without('w', 3), OVER_0)} THEN left(w, length(w) - 1) ELSE w END
  WHEN c IS NOT NULL AND {_is('c', VOWEL)} THEN {mended} ELSE w END AS w FROM s2),
s4 AS (SELECT term, CASE WHEN suffix(w, 'y') AND {_is(_without('w', 1), VOWEL)} THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM s3),
s5 AS (SELECT term, {_swaps('w', SECOND)} AS w FROM s4),
s6 AS (SELECT term, {_swaps('w', THIRD)} AS w FROM s5),
s7 AS (SELECT term, {_drops('w')} AS w FROM s6),
s8 AS (SELECT term, CASE WHEN suffix(w, 'e') AND ({_is(_without('w', 1), OVER_1)} OR ({_is(_without('w', 1), ONE)} AND NOT {_is(_without('w', 1), SHORT)})) THEN left(w, length(w) - 1) ELSE w END AS w FROM s7),
s9 AS (SELECT term, CASE WHEN suffix(w, 'll') AND {_is('w', OVER_1)} THEN left(w, length(w) - 1) ELSE w END AS w FROM s8),
stems AS (SELECT term, w AS stem FROM s9 UNION ALL SELECT term, term FROM s0 WHERE NOT s)
"""
