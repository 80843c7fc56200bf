"""What a scan spends on texts of ordinary characters, and that the cheaper forms mean the same."""

from __future__ import annotations

import math
import time

from pyspark.sql import functions as F

from veilspan.functions.predicates import is_placeholder_value
from veilspan.functions.regex import to_java
from veilspan.functions.text import shannon_entropy
from veilspan.options import ScanOptions
from veilspan.operators.scan import scan_df

# Blanks and line ends of ECMAScript.
BLANKS = {0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF}
ENDS = {0xA, 0xD, 0x2028, 0x2029}


def test_classes_hold_the_same_characters(spark):
    points = [p for p in range(0x11000) if not 0xD800 <= p < 0xE000]
    rows = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string")
    wanted = {r"^\s$": BLANKS, r"^[^\s]$": set(points) - BLANKS, r"^\S$": set(points) - BLANKS, r"^.$": set(points) - ENDS,
              r"""^[^\s"'x-z]$""": set(points) - BLANKS - {ord(c) for c in "\"'xyz"}, r"^[\s,;-]$": BLANKS | {ord(c) for c in ",;-"}}
    for pattern, held in wanted.items():
        assert {r["p"] for r in rows.where(F.rlike("c", F.lit(to_java(pattern)))).collect()} == held, pattern


def test_a_class_with_blanks_costs_no_more_than_a_plain_one(spark):
    texts = spark.range(2).select(F.repeat(F.lit("abcdefghij"), 400_000).alias("t")).cache()
    texts.count()

    def seconds(pattern):
        asked = texts.select(F.count_if(F.rlike("t", F.lit(pattern))))
        asked.collect()
        begun = time.time()
        asked.collect()
        return time.time() - begun

    plain = seconds("(?s).ZZ")
    assert min(seconds(to_java(r"[^\s]ZZ")) for _ in range(3)) < 6 * plain + 0.3
    assert min(seconds(to_java(".ZZ")) for _ in range(3)) < 6 * plain + 0.3


def test_entropy_of_characters_of_any_width(spark):
    def slow(v):
        out = 0.0
        for c in dict.fromkeys(v):
            out -= v.count(c) / len(v) * math.log2(v.count(c) / len(v))
        return out

    texts = ["", "a", "aab", "ää\U0001f600a\U0001f600", "Zürich€€", "x" * 300 + "y"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(shannon_entropy(F.col("t")).alias("e")).collect()
    assert all(abs(r["e"] - (slow(t) if t else 0.0)) < 1e-12 for r, t in zip(got, texts))


def test_stand_ins_of_one_and_two_characters(spark):
    cases = {"abababab": True, "aaab": True, "aabbc": False, "aba": False, "q1q1q1w": False, "\n\n\n\n": True, "ÄäÄä9": True, "pre_zzz9": True,
             "token key": True, "tokenkey": False, "k7QxxxxP0": True, "dont_use1": True, "p0123456789q": True, "Qkkkkkkw": True, "Qkkkkkw": False}
    got = spark.createDataFrame([(v,) for v in cases], "v string").select("v", is_placeholder_value(F.col("v")).alias("is")).collect()
    assert {r["v"]: r["is"] for r in got} == cases


def test_candidates_beside_a_rules_secret_are_still_found(spark):
    other, owned = "q9Xv2Lr8Tn4Wb6Yd1Kc3", "ghp_" + "aB3dE5fG7hJ9kL2mN4pQ6rS8tU0vWxYzC1dE"
    text = f'first = "{other}"\nowner = "{owned}"\nthird: {other[::-1]}\n'
    found = scan_df(spark.createDataFrame([(text,)], "t string"), "t", ScanOptions()).first()["findings"]
    assert [(f["match"], f["start"]) for f in found] == [(v, text.index(v)) for v in (other, owned, other[::-1])]
    assert [f["rule_id"] for f in found][::2] == ["high-entropy-string"] * 2
