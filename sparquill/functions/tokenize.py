"""The clean tokenizer as SQL expressions, all of them inside Catalyst.

1. ``normalised``: lower case, line ends to spaces, one leading space, tags out, edge punctuation
   off each token; tokens then stand between single spaces of their own (two between neighbours),
   so that phrase patterns can match side by side.
2. ``phrased``: phrase rules join the tokens of an amount, time or date into one, marked by MARK.
3. ``term``: per token, marked tokens and numbers take their final form.
4. ``terms``: hyphen compounds add their parts; what has neither letter nor digit goes.

``words`` is the plain variant used by ranking: tokens with a letter, no digit, no punctuation.
"""

from __future__ import annotations

from sparquill.functions.dialect import SPARK, Spark

MARK = "\x01"

# Month names and their numbers.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4,
    "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9,
    "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}

EDGE = r"(^[^\p{L}\p{Nd}%#$]+)|([^\p{L}\p{Nd}%#$]+$)"
TAG = r"<[^ ]*>|\[text\]|<f [^ ]*"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
DAY = r"(\d{1,2})(?:th|st|nd|rd)?"
MONTH = "(" + "|".join(sorted(MONTHS, key=lambda m: (-len(m), m))) + ")"
SCALE = "(million|billion|trillion)"

#: (pattern, replacement) in order of application, over text whose tokens are spaced on both sides.
PHRASES = [
    (rf" (\$?{NUMBER})  {SCALE}  dollars ", f" $1{MARK}$2{MARK}dollars "),
    (rf" (\$?{NUMBER})  {SCALE} ", f" $1{MARK}$2 "),
    (rf" ({NUMBER})  dollars ", f" $1{MARK}dollars "),
    (rf" ({NUMBER})  (?:percent|percentage) ", " $1% "),
    (rf" ({NUMBER})  (?:kilometers|kilometer|km) ", f" $1{MARK}km "),
    (r" between  (\d+)  and  (\d+) ", " $1-$2 "),
    (r" (\d{1,2}(?:[:.]\d{1,2})?)  (pm|am|p\.m|a\.m) ", f" $1{MARK}$2 "),
    (rf" {DAY}  {MONTH}  (\d{{4}}|\d{{1,2}}) ", f" $1{MARK}$2{MARK}$3{MARK}dmy "),
    (rf" {MONTH}  {DAY}  (\d{{4}}) ", f" $2{MARK}$1{MARK}$3{MARK}dmy "),
    (rf" {MONTH}  (\d{{4}}) ", f" {MARK}$1{MARK}$2{MARK}my "),
    (rf" {DAY}  {MONTH} ", f" $1{MARK}$2{MARK}{MARK}dm "),
    (rf" {MONTH}  {DAY} ", f" $2{MARK}$1{MARK}{MARK}dm "),
    (r" (\d+)  (\d+)/(\d+) ", f" $1{MARK}$2/$3 "),
]


#: White space between tokens; what is taken from a token's ends, and what a plain word may hold inside.
SPACE = r" \n\r\t"
EDGES, INSIDE = r"[^\p{L}\p{Nd}%#$ \n\r\t]", r"[^\p{Nd}\p{P}\p{S} \n\r\t]"
#: A plain word with the edges around it, from one white space to the next. Edges are not given back, so a token is tried once.
WORD = rf"(?<![^ \n\r\t]){EDGES}*+(\p{{L}}(?:{INSIDE}*\p{{L}})?){EDGES}*+(?![^ \n\r\t])"
#: Every token without the edges around it, and those only that have a letter or a digit.
ENDS = r"[\p{L}\p{Nd}%#$]"
TOKEN, SPOKEN = (rf"(?<![^{SPACE}]){EDGES}*+({first}(?:[^{SPACE}]*{ENDS})?){EDGES}*+(?![^{SPACE}])" for first in (ENDS, rf"(?:[\p{{L}}\p{{Nd}}]|[%#$](?=[^{SPACE}]*[\p{{L}}\p{{Nd}}]))"))
#: Punctuation inside a token.
INNER = rf"(?<=[^{SPACE}])\p{{P}}(?=[^{SPACE}])"
#: A text with tokens between spaces of their own, cut into stretches without a digit or mark, and those around digits and
#: marks. A phrase begins one token before its first digit at most, goes on for two behind one, and has one between two.
PLAIN = rf" [^0-9{MARK}]* (?=(?: [^ 0-9{MARK}]+ ){{2}}|\z)"
NEAR = rf"(?:(?: [^ 0-9{MARK}]+ ){{0,2}}+ [^ 0-9{MARK}]*+[0-9{MARK}][^ ]*+ (?: [^ 0-9{MARK}]+ ){{0,3}}+)++"


def untagged(x: str, d: Spark = SPARK) -> str:
    """The lower-cased text without tags, in Spark's form."""
    low = f"lower(coalesce({x}, ''))"
    bare = d.replaced(d.replaced(f"concat(' ', {low})", r"[\n\r\t]+", " "), TAG, "")
    return f"CASE WHEN contains({x}, '<') OR contains({x}, '[') THEN {bare} ELSE {low} END"


def normalised(x: str, d: Spark = SPARK) -> str:
    if d is SPARK:
        return f"concat(' ', {d.joined(d.every(untagged(x, d), TOKEN), '  ')}, ' ')"
    flat = d.replaced(f"concat(' ', lower(coalesce({x}, '')))", r"[\n\r\t]+", " ")
    tokens = d.mapped(d.split(d.replaced(flat, TAG, ""), " "), "t", d.replaced("t", EDGE, ""))
    return f"concat(' ', {d.joined(d.kept(tokens, 'u', chr(117) + " <> ''"), '  ')}, ' ')"


def phrased(x: str, d: Spark = SPARK) -> str:
    for pattern, by in PHRASES:
        x = d.replaced(x, pattern, by)
    return x


def plain_number(x: str, d: Spark = SPARK) -> str:
    """A decimal as text, without trailing zeros."""
    return d.replaced(f"CAST({x} AS VARCHAR(40))" if d.name == "duckdb" else f"CAST({x} AS STRING)", r"\.?0+$", "")


def amount(x: str, d: Spark = SPARK) -> str:
    """Numbers of a million and more in millions: 1500000 is '1.5 m'."""
    whole = f"CAST({x} AS DECIMAL(38,6))"
    millions = f"CAST(CAST({x} AS DECIMAL(30,6)) * CAST('0.000001' AS DECIMAL(7,6)) AS DECIMAL(38,6))"
    return f"CASE WHEN {x} >= 1000000 THEN concat({plain_number(millions, d)}, ' m') ELSE {plain_number(whole, d)} END"


def _clean_number(x: str, d: Spark) -> str:
    return d.number(f"replace(replace({x}, ',', ''), '$', '')")


def _part(t: str, k: int, d: Spark) -> str:
    return d.element(d.split(t, MARK), k)


def _year(y: str) -> str:
    """Two-digit years: 1-9 are 200y, 10-20 are 20yy, others 19yy."""
    n = f"CAST({y} AS INT)"
    return f"CASE WHEN length({y}) = 4 THEN {y} WHEN {n} BETWEEN 1 AND 20 THEN CAST(2000 + {n} AS VARCHAR(4)) ELSE concat('19', lpad({y}, 2, '0')) END"


def _month(m: str) -> str:
    return f"CASE {m} " + " ".join(f"WHEN '{name}' THEN '{n:02}'" for name, n in MONTHS.items()) + " END"


def term(t: str, d: Spark = SPARK) -> str:
    """Final form of one token; marked tokens that make no sense (day 45) fall back to their words."""
    m = MARK
    like = lambda p: d.like(t, p)
    p1, p2, p3 = (_part(t, k, d) for k in (1, 2, 3))
    scaled = f"({_clean_number(p1, d)} * CASE {p2} WHEN 'million' THEN 1000000 WHEN 'billion' THEN 1000000000 ELSE 1000000000000 END)"
    hour, minute = f"CAST({d.group(t, r'^(\d+)')} AS INT)", f"lpad(coalesce(nullif({d.group(t, r'^\d+[:.](\d+)')}, ''), '00'), 2, '0')"
    hour24 = f"CASE WHEN {like('p\\.?m$')} AND {hour} < 12 THEN {hour} + 12 WHEN {like('a\\.?m$')} AND {hour} = 12 THEN 0 ELSE {hour} END"
    top, bottom = d.group(t, r"(\d+)/\d+$"), d.group(t, r"/(\d+)$")
    a, b, y = (d.group(t, rf"^(\d+)[./](\d+)[./](\d+)$", k) for k in (1, 2, 3))
    day = lambda x: f"(CAST({x} AS INT) BETWEEN 1 AND 31)"
    month = lambda x: f"(CAST({x} AS INT) BETWEEN 1 AND 12)"
    fraction = f"(coalesce({d.number(f"nullif({d.group(t, f'^(\\d+){m}')}, '')")}, 0) + CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0))"
    rounded = f"{'bround' if d.name == 'spark' else 'round_even'}({fraction}, 2)"
    date = r"^\d{1,4}[./]\d{1,2}[./](\d{4}|\d{1,2})$"
    # Every rule needs a digit or a mark; plain words, nearly all tokens, are through with one test.
    return f"""CASE
  WHEN NOT {like(f'[0-9{m}]')} THEN {t}
  WHEN {like(f'{m}dollars$')} AND {like(f'{m}(million|billion|trillion){m}')} THEN concat({amount(scaled, d)}, ' dollars')
  WHEN {like(f'{m}dollars$')} THEN concat({amount(_clean_number(p1, d), d)}, ' dollars')
  WHEN {like(f'{m}(million|billion|trillion)$')} THEN concat({amount(scaled, d)}, CASE WHEN {like(r'^\$')} THEN ' dollars' ELSE '' END)
  WHEN {like(f'{m}km$')} THEN concat({plain_number(_clean_number(p1, d), d)}, ' km')
  WHEN {like(f'{m}(pm|am|p\\.m|a\\.m)$')} THEN CASE WHEN {hour} <= 24 THEN concat(CAST({hour24} AS VARCHAR(4)), ':', {minute}) ELSE replace({t}, '{m}', ' ') END
  WHEN {like(f'{m}dmy$')} THEN CASE WHEN {day(p1)} THEN concat({_year(p3)}, '-', {_month(p2)}, '-', lpad({p1}, 2, '0')) ELSE concat({p1}, ' ', {p2}, ' ', {p3}) END
  WHEN {like(f'{m}my$')} THEN concat({p3}, '-', {_month(p2)})
  WHEN {like(f'{m}dm$')} THEN CASE WHEN {day(p1)} THEN concat({_month(p2)}, '-', lpad({p1}, 2, '0')) ELSE concat({p1}, ' ', {p2}) END
  WHEN {like(rf'^(\d+{m})?\d{{1,9}}/\d{{1,9}}$')} THEN coalesce({plain_number(f'CAST({rounded} AS DECIMAL(38,6))', d)}, {t})
  WHEN {like(date)} AND {day(a)} AND {month(b)} THEN concat({_year(y)}, '-', lpad({b}, 2, '0'), '-', lpad({a}, 2, '0'))
  WHEN {like(date)} AND {day(b)} AND {month(a)} THEN concat({_year(y)}, '-', lpad({a}, 2, '0'), '-', lpad({b}, 2, '0'))
  WHEN {like(rf'^\${NUMBER}$')} THEN coalesce(concat({amount(_clean_number(t, d), d)}, ' dollars'), {t})
  WHEN {like(r'^\d+(\.\d+)?bn$')} THEN coalesce({amount(f"({d.number(d.group(t, r'^(\d+(?:\.\d+)?)bn$'))} * 1000000000)", d)}, {t})
  WHEN {like(rf'^{NUMBER}%$')} THEN replace({t}, ',', '')
  WHEN {like(rf'^{NUMBER}$')} THEN coalesce({amount(_clean_number(t, d), d)}, {t})
  ELSE {t} END"""


def parts(t: str, d: Spark = SPARK) -> str:
    """A term, or the compound and its two parts where letters stand on both sides of a single mark of punctuation."""
    pair = r"^([^\p{P}]*\p{L}[^\p{P}]*)\p{P}+([^\p{P}]*\p{L}[^\p{P}]*)$"
    # Without punctuation the pair would be sought in vain, at the cost of its backtracking.
    plain = f"WHEN NOT {d.like(t, r'\p{P}')} THEN {d.array(t)} " if d is SPARK else ""
    return f"CASE {plain}WHEN {d.like(t, pair)} THEN {d.array(t, d.group(t, pair, 1), d.group(t, pair, 2))} ELSE {d.array(t)} END"


def terms(x: str, d: Spark = SPARK) -> str:
    """Array of the clean terms of a text, in order."""

    def made(text: str, ruled: bool) -> str:
        tokens = d.kept(d.split(text, " "), "s", "s <> ''")
        finals = d.mapped(tokens, "v", term("v", d)) if ruled else tokens
        split = d.flat(d.mapped(finals, "w", parts("w", d)))
        return d.kept(split, "z", d.like("z", r"[\p{L}\p{Nd}]"))

    if d is not SPARK:
        return made(phrased(normalised(x, d), d), True)

    def plain(text: str, raw: str) -> str:
        """Of text without digits: compounds are sought only where a token has punctuation inside, which lower case does not change."""
        spoken = d.every(text, SPOKEN)
        return f"CASE WHEN {d.like(raw, INNER)} THEN {d.flat(d.mapped(spoken, 'w', parts('w', d)))} ELSE {spoken} END"

    # All rules for phrases and tokens need a digit or a mark; most texts have none, others only in a few places.
    stretches = f"regexp_extract_all({normalised(x, d)}, {d.text(f'{NEAR}|{PLAIN}')}, 0)"
    mixed = d.flat(d.mapped(stretches, "p", f"CASE WHEN {d.like('p', f'[0-9{MARK}]')} THEN {made(phrased('p', d), True)} ELSE {plain('p', 'p')} END"))
    return f"CASE WHEN {d.like(f'coalesce({x}, {chr(39) * 2})', f'[0-9{MARK}]')} THEN {mixed} ELSE {plain(untagged(x, d), x)} END"


def words(x: str, d: Spark = SPARK) -> str:
    """Array of the plain words of a text: with a letter, without digit or inner punctuation."""
    if d is SPARK:
        return d.every(f"lower(coalesce({x}, ''))", WORD)
    flat = d.replaced(f"concat(' ', lower(coalesce({x}, '')))", r"[\n\r\t]+", " ")
    tokens = d.mapped(d.split(flat, " "), "t", d.replaced("t", EDGE, ""))
    return d.kept(tokens, "u", f"({d.like('u', r'\p{L}')} AND NOT {d.like('u', r'[\p{Nd}\p{P}\p{S}]')})")
