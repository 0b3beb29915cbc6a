"""The compatibility tokenizer: the original term rules with all their quirks.

The rules are sequential: they read tokens that earlier rules rewrote, look ahead at raw tokens and
take back emitted terms. So they run as an Arrow-batched function, one text at a time. The clean
tokenizer (``tokenize``) is the default everywhere; this one is for matching old indexes.

Quirks kept: digit tokens that no rule knows vanish; magnitudes emit nothing by themselves; money in
words loses two-token look-back at the start of a text; numeric dates are not padded; month words
that match nothing vanish; minutes under ten are padded on the right in pm times.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.functions.tokenize import MONTHS

#: Texts of a batch whose tokens are Python objects at one time.
SLICE = 256
TOKENS = pa.list_(pa.string())

SCALES = {"million": 1e6, "billion": 1e9, "trillion": 1e12}
_FLOAT = re.compile(r"[+-]?(\d[\d,]*\.?\d*|\.\d+)(e[+-]?\d+)?")
_INT = re.compile(r"[+-]?\d{1,10}")
_EDGE = "%#$"


def as_float(token: str) -> float | None:
    return float(token.replace(",", "")) if _FLOAT.fullmatch(token) else None


def as_int(token: str) -> int | None:
    return int(token) if _INT.fullmatch(token) and -(2**31) <= int(token) < 2**31 else None


def shown(x: float) -> str:
    """A number as the original printed it: up to 15 digits, none after a whole number."""
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.15g}"


def magnitude(x: float) -> str:
    if x < 1e6:
        return shown(x)
    if x == 1e6:
        return "1 m"
    while x > 1e6:
        x = x / 1e6 + x % 1e6
    return shown(x) + " m"


def stripped(token: str) -> str:
    """Without edge characters other than letters, digits and the three signs."""
    keep = [i for i, ch in enumerate(token) if ch.isalpha() or ch.isdecimal() or ch in _EDGE]
    return token[keep[0] : keep[-1] + 1] if keep else ""


def is_mark(ch: str) -> bool:
    import unicodedata

    return unicodedata.category(ch).startswith("P")


def day_of(token: str) -> str | None:
    number = as_int(re.sub(r"(?<=.)(th|st|nd|rd)$", "", token)) if token else None
    return f"{number:02}" if number is not None and 1 <= number <= 31 else None


def year_of(n: int) -> str:
    return str(n) if 1000 <= n <= 9999 else f"200{n}" if 0 < n <= 9 else f"20{n}" if 9 < n <= 20 else f"19{n}"


class _Text:
    """One pass over the tokens of a text."""

    def __init__(self, text: str, stop: frozenset[str]):
        self.slots, self.out, self.stop = text.split(" "), [], stop

    def emit(self, term: str, at: int | None = None, *blank: int) -> None:
        self.out.append(term)
        if at is not None:
            self.slots[at] = term
        for b in blank:
            self.slots[b] = ""

    def take_back(self) -> None:
        if self.out:
            self.out.pop()

    def before(self, at: int, least: int = 1) -> str | None:
        return self.slots[at - 1] if at >= least else None

    def run(self) -> list[str]:
        for at in range(len(self.slots)):
            token = self.slots[at]
            if not any(ch.isalpha() or ch.isdecimal() for ch in token):
                self.slots[at] = ""
                continue
            if (token[0] == "<" and token[-1] == ">") or token == "[text]":
                token = ""
            elif token == "<f":
                token = ""
                self.slots[at + 1 : at + 2] = [""] * len(self.slots[at + 1 : at + 2])
            token = self.slots[at] = stripped(token)
            if (number := as_float(token)) is not None:
                self.emit(magnitude(number))
            if token in MONTHS:
                self.month(at)
            elif any(map(str.isdecimal, token)):
                self.digits(at)
            elif any(map(is_mark, token)):
                self.marks(at)
            elif not self.special(at) and token:
                if token in self.stop:
                    self.slots[at] = ""
                else:
                    self.emit(token)
        return [t for t in self.out if t]

    # Tokens with digits.

    def digits(self, at: int) -> None:
        token = self.slots[at]
        if "$" in token:
            if (x := as_float(token.strip("$"))) is not None:
                self.emit(f"{magnitude(x)} dollars", at)
            return
        if "bn" in token:
            if (x := as_float(token.strip("bn"))) is not None:
                self.emit(magnitude(x * 1e9), at)
                return
        elif token.endswith("m"):
            return
        elif "/" in token or "." in token:
            self.numeric_date(at, "/" if "/" in token else ".")
        if "/" in token:
            self.fraction(at)

    def numeric_date(self, at: int, mark: str) -> None:
        fields = [as_int(f) or 0 for f in self.slots[at].split(mark)]
        if len(fields) != 3 or min(fields) <= 0:
            return
        for day, month in (fields[:2], fields[1::-1]):
            if day <= 31 and month <= 12:
                self.emit(f"{year_of(fields[2])}-{month}-{day}", at)
                return

    def fraction(self, at: int) -> None:
        fields = self.slots[at].split("/")
        whole = as_int(self.slots[at - 1]) if at else None
        if whole is not None:
            self.slots[at - 1] = ""
            self.take_back()
        numbers = [as_int(f) for f in ([str(whole)] if whole is not None else []) + fields]
        if len(numbers) not in (2, 3) or None in numbers or numbers[-1] == 0:
            return
        value = (numbers[0] if len(numbers) == 3 else 0) + numbers[-2] / numbers[-1]
        self.emit(shown(float(Decimal(value).quantize(Decimal("0.01"), ROUND_HALF_EVEN))), at)

    # Month words.

    def month(self, at: int) -> None:
        has_next = at + 1 < len(self.slots)
        name = f"{MONTHS[self.slots[at]]:02}" if has_next else ""
        comma, after = False, None
        if has_next:
            comma = self.slots[at + 1].endswith(",")
            self.slots[at + 1] = stripped(self.slots[at + 1])
            after = as_int(self.slots[at + 1])
        previous = self.before(at, 2)
        day = day_of(previous) if previous is not None else None
        numeric_before = previous is not None and as_int(previous) is not None
        year = None
        if after is not None:
            # Without a token to look back at, the original takes the empty day for a match.
            if 1000 <= after <= 2025:
                year = str(after)
            elif numeric_before or previous is None or day is not None:
                year = year_of(after) if not 1000 <= after <= 9999 else f"19{after}"
        if year is not None and previous is not None:
            if day is not None:
                self.take_back()
                self.emit(f"{year}-{name}-{day}", at, at - 1, at + 1)
            else:
                self.emit(f"{year}-{name}", at, at + 1)
        elif year is None and day is not None:
            self.emit(f"{name}-{day}", at, at - 1)
        elif year is None and after is not None and (own := day_of(self.slots[at + 1])) is not None:
            if comma and at + 2 < len(self.slots):
                far = as_int(self.slots[at + 2])
                if far is not None and 1000 <= far <= 2025:
                    self.emit(f"{far}-{name}-{own}", at, at + 1, at + 2)
            else:
                self.emit(f"{name}-{own}", at, at + 1)

    # Words with punctuation inside.

    def marks(self, at: int) -> None:
        token = self.slots[at]
        run = re.search("".join(f"[{re.escape(''.join(sorted(set(filter(is_mark, token)))))}]+"), token)[0]
        if token.find(run) != token.rfind(run):
            self.emit(token)
            return
        fields = re.split(f"[{re.escape(run)}]", token)
        if all(any(map(str.isalpha, f)) for f in (fields[0], fields[-1])):
            self.slots[at] = ""
            for f in (fields[0], fields[-1]):
                if f not in self.stop:
                    self.emit(stripped(f))

    # Words with a meaning of their own: true if the word is dealt with.

    def special(self, at: int) -> bool:
        word, previous = self.slots[at], self.before(at)
        number = as_float(previous) if previous is not None else None
        if word in ("percent", "percentage"):
            if number is not None:
                self.take_back()
                self.emit(f"{shown(number)}%", at, at - 1)
            return True
        if word in SCALES and previous is not None:
            if number is not None:
                self.slots[at - 1], self.slots[at] = "", magnitude(number * SCALES[word])
                if self.slots[at + 1 : at + 2] and self.slots[at + 1] in SCALES:
                    self.slots[at + 1] = ""
            elif "dollars" in previous and (x := as_float(previous.strip(" dolars"))) is not None:
                self.take_back()
                self.emit(f"{magnitude(x * SCALES[word])} dollars", at, at - 1)
            return True
        if word == "dollars":
            if at > 1:
                if any(map(str.isdecimal, previous)):
                    self.take_back()
                    self.emit(previous if "dollars" in previous else f"{previous} dollars", at, at - 1)
                else:
                    self.emit(word)
            return True
        if word == "between" and at < len(self.slots) - 3:
            low, link, high = self.slots[at + 1 : at + 4]
            if link == "and" and as_int(low) is not None and as_int(high) is not None:
                self.emit(f"{as_int(low)}-{as_int(high)}", at, at + 1, at + 2, at + 3)
            return True
        if word in ("kilometers", "km") and number is not None:
            self.take_back()
            self.emit(f"{shown(number)} km", at, at - 1)
            return True
        if word in ("am", "pm") and previous:
            if (clock := self.clock(previous, word == "pm")) is not None:
                self.emit(clock, at, at - 1)
                return True
        return False

    @staticmethod
    def clock(token: str, pm: bool) -> str | None:
        fields = [as_int(f) for f in token.replace(".", ":").split(":")]
        if None in fields or len(fields) > 2:
            return None
        hour = fields[0]
        if len(fields) == 2:
            minute = fields[1]
            if not 0 <= minute <= 60:
                return None
            return f"{hour + 12 * (hour < 12)}:{minute}{'0' if minute < 10 else ''}" if pm else f"{hour}:{minute}"
        return f"{hour + 12 * pm}:00" if hour <= 12 else f"{hour}:00" if hour <= 24 and pm else None


def compat_tokens(text: str, stop: frozenset[str] = frozenset()) -> list[str]:
    """Terms of one text; documents start with a space, queries do not."""
    return _Text(text, stop).run()


def compat_terms(text: Column, stop_words: tuple[str, ...] = (), leading: bool = True) -> Column:
    """Array of compat terms of a text column; line ends count as spaces, as lines are joined by them."""
    stop = frozenset(stop_words)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        # Tokens are Python objects only for a slice of the batch at a time.
        slices = (texts[i : i + SLICE].to_pylist() for i in range(0, len(texts), SLICE))
        return pa.concat_arrays([pa.array([], TOKENS), *(pa.array([compat_tokens(t, stop) for t in s], TOKENS) for s in slices)])

    return run(F.concat(F.lit(" " if leading else ""), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\r\n]+", " ")))
