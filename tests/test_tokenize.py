import re

import pytest
from pyspark.sql import functions as F

from sparquill.functions import tokenize
from sparquill.functions.compat import compat_tokens
from sparquill.functions.porter import stem

# phrase: (compat terms, clean terms), each inside "x ... y".
CASES = {
    "1,000": (["1000"], ["1000"]),
    "2000000": (["2 m"], ["2 m"]),
    "1500000": (["500001.5 m"], ["1.5 m"]),
    "10 percent": (["10%"], ["10%"]),
    "10%": ([], ["10%"]),
    "$100": (["100 dollars"], ["100 dollars"]),
    "$5 million": (["5 m dollars"], ["5 m dollars"]),
    "5 million dollars": (["5 m dollars"], ["5 m dollars"]),
    "5 million": (["5"], ["5 m"]),
    "5bn": (["5000 m"], ["5000 m"]),
    "between 5 and 9": (["5-9"], ["5-9"]),
    "7 kilometers": (["7 km"], ["7 km"]),
    "5 pm": (["5", "17:00"], ["17:00"]),
    "5:05 pm": (["17:50"], ["17:05"]),
    "3 1/2": (["3.5"], ["3.5"]),
    "1.8.15": (["2015-8-1"], ["2015-08-01"]),
    "16 january 1993": (["1993-01-16"], ["1993-01-16"]),
    "june 1994": (["1994-06"], ["1994-06"]),
    "june 5": (["06-05"], ["06-05"]),
    "may": ([], ["may"]),
    "far-east": (["far", "east"], ["far-east", "far", "east"]),
    "a-b-c": (["a-b-c"], ["a-b-c"]),
    "f16": ([], ["f16"]),
    "<b>": ([], []),
}


def test_clean_phrases(spark):
    df = spark.createDataFrame([(p,) for p in CASES], "p string").select("p", F.expr(tokenize.terms("concat('x ', p, ' y')")).alias("t"))
    got = {r.p: r.t for r in df.collect()}
    assert got == {p: ["x", *clean, "y"] for p, (_, clean) in CASES.items()}


@pytest.mark.parametrize("phrase", CASES)
def test_compat_phrases(phrase):
    assert compat_tokens(f" x {phrase} y") == ["x", *CASES[phrase][0], "y"]


@pytest.mark.parametrize(("phrase", "terms"), [("on 16th january 1993", ["1993-01-16"]), ("7 1/8/2015", ["7"]), ("in may", ["in"]), ("12 pm", ["12", "24:00"]), ("5 u.s. dollars", ["5", "u", "s", "dollars"]), ("5:00 am", ["5:0"])])
def test_compat_quirks(phrase, terms):
    assert compat_tokens(f" x {phrase} y") == ["x", *terms, "y"]


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("  \n ",), ("--- !!",)], "p string")
    for made in (tokenize.terms("p"), tokenize.words("p")):
        assert [r[0] for r in df.select(F.expr(made)).collect()] == [[], [], [], []]
    assert compat_tokens(" ") == []


def test_stop_words_go_before_positions(spark):
    from sparquill.operators import index

    rows = index.tokens(index.terms(spark.createDataFrame([(1, "The cat and the dog")], "doc_id long, text string"))).orderBy("pos").collect()
    assert [(r.pos, r.term) for r in rows] == [(0, "cat"), (1, "dog")]


@pytest.mark.parametrize(
    ("word", "expected"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("sensibiliti", "sensibl"), ("adoption", "adopt"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("analogousli", "analog")],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_whole_text_patterns_are_those_of_single_tokens(spark):
    """The patterns over a whole text give what each token by itself gives (any other dialect object takes that way)."""
    import random

    from sparquill.functions.dialect import Spark

    r = random.Random(11)
    parts = ["a", "B", "é", "e\u0301", "\u0301", "1", "$", "%", "#", "-", ".", "'", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\xa0", "漢", "😀", "<b", ">", "[text]", "between", "5", "and", "june", "٣", "ǅ", "_"]
    texts = ["".join(r.choices(parts, k=r.randrange(0, 40))) for _ in range(4000)] + [None, "", " ", "x" * 5000 + "$", "-" * 5000, "a-" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    for made in (tokenize.words, tokenize.normalised, tokenize.terms):
        rows = df.select("p", F.expr(made("p")).alias("whole"), F.expr(made("p", Spark())).alias("single")).collect()
        for row in rows:
            assert row.whole == row.single, (made.__name__, row.p)


def test_rules_see_only_what_stands_near_digits(spark):
    """A long text with one phrase is cut into stretches that give it back; those with digits, which the rules go over, stay short."""
    texts = ["word " * 300 + "between 5 and 7 " + "and may million " * 200, "may 5 2010 " + "x " * 50 + "3 million dollars y 4", "a b 5", "a", "5", "x 1\x012 a b c d e 7 km"]
    cut = f"regexp_extract_all(n, r'{tokenize.NEAR}|{tokenize.PLAIN}', 0)"
    rows = spark.createDataFrame([(t,) for t in texts], "p string").select("p", F.expr(tokenize.normalised("p")).alias("n")).select("p", "n", F.expr(cut).alias("s")).collect()
    for r in rows:
        assert "".join(r.s) == r.n
        assert all(len(s.split()) <= 10 for s in r.s if re.search("[0-9\x01]", s))
    made = spark.createDataFrame([(t,) for t in texts], "p string").select(F.expr(tokenize.terms("p")).alias("t")).collect()
    assert made[0].t[299:302] == ["word", "5-7", "and"] and made[1].t[0] == "2010-05-05" and made[1].t[-3:] == ["3 m dollars", "y", "4"] and made[5].t[-1] == "7 km"


def test_stems_sort_no_rules_for_a_word():
    """The rules stand in order: stemming a word takes less than bringing them into order for it."""
    import time

    from sparquill.functions import porter

    words = [f"{a}{b}{c}" for a in ("walk", "rel", "hop", "cry", "gener") for b in ("ation", "iv", "al", "w") for c in "abcdefghijklmnopqrstuvwxyz"]

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            for w in words:
                f(w)
            took.append(time.process_time() - began)
        return min(took)

    ordered = lambda w: [sorted(rules, key=lambda r: -len(r)) for rules in (porter.STEP_2, porter.STEP_3, porter.STEP_4)]
    assert least(porter.stem.__wrapped__) < least(ordered)
    assert [porter.stem(w) for w in ("relational", "généralement", "sky", "skies", "yyy", "hopefulness", "controlled")] == ["relat", "généralement", "sky", "ski", "yyi", "hope", "control"]
