"""Phrases for the token rules, made from every row of ``documents``, and what the rules make of them.

A rule has several forms: an SQL expression of a phrase, in the part of SQL that Spark and DuckDB
share, and one of its terms, written down apart from the tokenizer: arithmetic and text functions on the row's
own values. A document takes the form that its id gives and has the phrase behind its text.
"""

from __future__ import annotations

from sparquill.sources.corpus import LANGUAGE_FIXES

#: Stands between a document's own text and its phrase.
MARK = "qqmark"

D, N, LANG = "doc_id", "n_chars", "coalesce(lang, 'xx')"
MONTHS = "january february march april may june july august september october november december"


def s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def two(x: str) -> str:
    return f"lpad({s(x)}, 2, '0')"


def cut(whole: str, part: str, digits: int) -> str:
    """A decimal without trailing zeros, for DuckDB, from its whole part and its ``digits`` decimals."""
    return rf"regexp_replace(printf('%d.%0{digits}d', {whole}, {part}), '\.?0+$', '')"


def amount(v: str) -> str:
    return f"CASE WHEN {v} >= 1000000 THEN {cut(f'({v}) // 1000000', f'({v}) % 1000000', 6)} || ' m' ELSE {s(v)} END"


ONE, MORE = f"({D} + 1)", f"({N} * 1000)"
HOUR = f"(1 + {D} % 12)"
DAY, LATE_DAY, MONTH, YEAR, SHORT_YEAR = f"(1 + {D} % 28)", f"(13 + {D} % 16)", f"(1 + CAST(floor({D} / 28) AS BIGINT) % 12)", f"(1950 + {D} % 70)", f"(30 + {D} % 60)"
NAME = f"split_part('{MONTHS}', ' ', CAST({MONTH} AS INT))"
AFTERNOON = f"{s(f'CASE WHEN {HOUR} < 12 THEN {HOUR} + 12 ELSE 12 END')}"
MORNING = f"{s(f'CASE WHEN {HOUR} = 12 THEN 0 ELSE {HOUR} END')}"
DATE = f"{s(YEAR)} || '-' || {two(MONTH)} || '-' || {two(DAY)}"

RULES: dict[str, list[tuple[str, str]]] = {
    "numbers": [
        (s(N), amount(N)),
        (s(MORE), amount(MORE)),
        (f"{s(D)} || '.50'", f"{s(D)} || '.5'"),
        (f"{s(ONE)} || ',000'", amount(f"({ONE} * 1000)")),
        (f"'f' || {s(D)}", f"'f' || {s(D)}"),
    ],
    "percent": [
        (f"{s(D)} || ' percent'", f"{s(D)} || '%'"),
        (f"{s(D)} || '%'", f"{s(D)} || '%'"),
        (f"{s(D)} || '.5 percentage'", f"{s(D)} || '.5%'"),
        ("'percent'", "'percent'"),
        (f"{s(D)} || ' percent ' || {s(N)} || ' percent'", f"{s(D)} || '%|' || {s(N)} || '%'"),
    ],
    "money": [
        (f"'$' || {s(N)}", f"{amount(N)} || ' dollars'"),
        (f"'$' || {s(ONE)} || ' million'", f"{s(ONE)} || ' m dollars'"),
        (f"{s(ONE)} || ' million dollars'", f"{s(ONE)} || ' m dollars'"),
        (f"{s(MORE)} || ' dollars'", f"{amount(MORE)} || ' dollars'"),
        (f"'$' || {s(D)} || '.50'", f"{s(D)} || '.5 dollars'"),
        ("'dollars'", "'dollars'"),
    ],
    "magnitude": [
        (f"{s(ONE)} || ' million'", f"{s(ONE)} || ' m'"),
        (f"{s(ONE)} || ' billion'", f"{s(f'{ONE} * 1000')} || ' m'"),
        (f"{s(ONE)} || '.5 trillion'", f"{s(f'{ONE} * 1000000 + 500000')} || ' m'"),
        ("'million'", "'million'"),
    ],
    "bn": [
        (f"{s(ONE)} || 'bn'", f"{s(f'{ONE} * 1000')} || ' m'"),
        (f"{s(ONE)} || '.25bn'", f"{s(f'{ONE} * 1000 + 250')} || ' m'"),
        ("'bn'", "'bn'"),
    ],
    "between": [
        (f"'between ' || {s(D)} || ' and ' || {s(N)}", f"{s(D)} || '-' || {s(N)}"),
        ("'between us'", "'between|us'"),
        (f"'between ' || {s(D)} || ' and'", f"'between|' || {amount(D)} || '|and'"),
    ],
    "km": [
        (f"{s(D)} || ' kilometers'", f"{s(D)} || ' km'"),
        (f"{s(D)} || '.5 km'", f"{s(D)} || '.5 km'"),
        ("'km'", "'km'"),
    ],
    "ampm": [
        (f"{s(HOUR)} || ' pm'", f"{AFTERNOON} || ':00'"),
        (f"{s(HOUR)} || ':05 pm'", f"{AFTERNOON} || ':05'"),
        (f"{s(HOUR)} || ' am'", f"{MORNING} || ':00'"),
        (f"{s(HOUR)} || '.30 am'", f"{MORNING} || ':30'"),
        ("'pm'", "'pm'"),
        (f"{s(f'(25 + {D} % 70)')} || ' pm'", f"{s(f'(25 + {D} % 70)')} || ' pm'"),
    ],
    "fraction": [
        (f"{s(D)} || ' ' || {s(f'(1 + {D} % 3)')} || '/4'", cut(D, f"(1 + {D} % 3) * 25", 2)),
        (f"{s(D)} || '/4'", cut(f"{D} // 4", f"({D} % 4) * 25", 2)),
        (f"{s(ONE)} || '/0'", f"{s(ONE)} || '/0'"),
        ("'1/3'", "'0.33'"),
    ],
    "date_numeric": [
        (f"{s(DAY)} || '.' || {s(MONTH)} || '.' || {s(YEAR)}", DATE),
        (f"{s(MONTH)} || '/' || {s(LATE_DAY)} || '/' || {s(YEAR)}", f"{s(YEAR)} || '-' || {two(MONTH)} || '-' || {two(LATE_DAY)}"),
        (f"{s(DAY)} || '/' || {s(MONTH)} || '/' || {s(SHORT_YEAR)}", f"'19' || {two(SHORT_YEAR)} || '-' || {two(MONTH)} || '-' || {two(DAY)}"),
        (f"{s(DAY)} || '.' || {s(MONTH)} || '.15'", f"'2015-' || {two(MONTH)} || '-' || {two(DAY)}"),
        ("'99/99/99'", "'99/99/99'"),
    ],
    "date_text": [
        (f"{s(DAY)} || ' ' || {NAME} || ' ' || {s(YEAR)}", DATE),
        (f"{s(DAY)} || 'th ' || {NAME} || ' ' || {s(SHORT_YEAR)}", f"'19' || {two(SHORT_YEAR)} || '-' || {two(MONTH)} || '-' || {two(DAY)}"),
        (f"{NAME} || ' ' || {s(YEAR)}", f"{s(YEAR)} || '-' || {two(MONTH)}"),
        (f"{NAME} || ' ' || {s(DAY)}", f"{two(MONTH)} || '-' || {two(DAY)}"),
        (f"{NAME} || ' ' || {s(DAY)} || ', ' || {s(YEAR)}", DATE),
        (f"{s(DAY)} || ' ' || substring({NAME}, 1, 3)", f"{two(MONTH)} || '-' || {two(DAY)}"),
        ("'may'", "'may'"),
        (f"'45 ' || {NAME}", f"'45 ' || {NAME}"),
        ("'3rd of may'", "'3rd|of|may'"),
    ],
    "punct": [
        (f"'far-' || {LANG}", f"'far-' || {LANG} || '|far|' || {LANG}"),
        ("'a-b-c'", "'a-b-c'"),
        (f"'\"' || {LANG} || ',\"'", LANG),
        ("'u.s.'", "'u.s|u|s'"),
        ("'---'", "''"),
        ("'o' || chr(39) || 'clock'", "'o' || chr(39) || 'clock|o|clock'"),
    ],
    "tags": [
        (f"'<b' || {s(D)} || '>'", "''"),
        ("'[text]'", "''"),
        (f"'<f p=' || {s(D)} || '>'", "''"),
        (f"'<p>' || {LANG}", LANG),
    ],
}


def choice(forms: list[str]) -> str:
    """The form that a document's id gives."""
    return f"CASE {D} % {len(forms)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(forms)) + " END"


def phrase(rule: str) -> str:
    return choice([p for p, _ in RULES[rule]])


def sql(rule: str) -> str:
    return f"SELECT doc_id, {phrase(rule)} AS phrase, {choice([t for _, t in RULES[rule]])} AS terms FROM documents"


_NAME, _RIGHT = (f"split_part('{' '.join(x)}', ' ', CAST(1 + {D} % {len(LANGUAGE_FIXES)} AS INT))" for x in (LANGUAGE_FIXES.keys(), LANGUAGE_FIXES.values()))
#: A raw language from each document: its own, or a misspelt one, with what files put around them.
RAW_LANGUAGE = choice([f"upper({_NAME})", f"{_NAME} || ' text'", f"{_NAME} || 'language'", f"{LANG} || ' language'", f"upper({LANG}) || 'Language'", "''"])
LANGUAGE_SQL = f"SELECT doc_id, {RAW_LANGUAGE} AS raw, {choice([_RIGHT, _RIGHT, _RIGHT, LANG, LANG, chr(39) * 2])} AS lang FROM documents"
