"""What is asked before a name rule is implied by every match of it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspan.functions.regex import to_java
from veilspan.operators.detect import java_pattern
from veilspan.rules.catalogue import BUILTIN, IMPLIED_ASSIGNMENTS

VALUE = "q8Zr2LmX0vTt7Yb"
NAMES = ("api-key", "My.Api_Key.v2", "ACCESS_TOKEN_OLD", "passwd", "x.secret-", "export CLIENT_SECRET", "password", "credentials", "colour")


@pytest.mark.parametrize("rule_id", sorted(IMPLIED_ASSIGNMENTS))
def test_no_match_is_lost(spark, rule_id):
    texts = [f"first\n{name}{gap}{sign}{gap}{quote}{value}{quote}{end}" for name in NAMES for gap in ("", " ", "\t") for sign in ":="
             for quote in ("", '"', "'", "`") for value in (VALUE, VALUE[:11], "`" + VALUE, VALUE * 20, VALUE + "#c") for end in ("", "\r\nz", " z", " z")]
    rule = next(r for r in BUILTIN if r.id == rule_id)
    seen = spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.rlike("t", F.lit(to_java(IMPLIED_ASSIGNMENTS[rule_id], "im"))).alias("asked"), F.rlike("t", F.lit(java_pattern(rule))).alias("hit"))
    counts = {(r["asked"], r["hit"]): r["count"] for r in seen.groupBy("asked", "hit").count().collect()}
    assert (False, True) not in counts and counts[(True, True)] > 0 and counts[(False, False)] > 0
