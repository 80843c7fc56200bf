"""Names computed in the row, and the exceptions that are looked up."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import fake
from veilspan.operators import joins, redact as R
from veilspan.operators.vault import allocate, empty_vault, key_frame
from veilspan.options import ScanOptions
from veilspan.rules.custom import build_rules

KEY = b"k" * 32


def tokens(n):
    return [fake("npm_", 30) + f"{100123 + 37 * i}" for i in range(n)]


@pytest.mark.parametrize("small", [True, False])
def test_exceptions_are_looked_up_and_the_rest_is_computed(spark, monkeypatch, small):
    """600 secrets of one stem collide a few times; some are known by other names; one is found by two rules."""
    if not small:
        monkeypatch.setattr(joins, "is_small", lambda *a, **k: False)
        monkeypatch.setattr(R, "is_small", lambda *a, **k: False)
    secrets = tokens(600)
    rows = [(i % 7 if i % 3 else None, f"a {s} b {secrets[(i * 7) % 600]} c") for i, s in enumerate(secrets)] + [(None, "plain"), (None, None), (1, "")]
    docs = spark.createDataFrame(rows, "k int, text string").withColumn("inner_pad", F.lit("own")).withColumn("key_id", F.lit("own"))
    vault = spark.createDataFrame([("MASKED_OLD_KEY_1", secrets[5]), ("MASKED_NPM_TOKEN_ABCDEF12", secrets[6])], "placeholder string, secret string")
    out, added = R.redact_df(docs, "text", ["k"], vault, key_frame(spark, KEY))
    names = {r["secret"]: r["placeholder"] for r in vault.unionByName(added).collect()}
    assert len(names) == 600 == len(set(names.values())) and len({len(n) for n in names.values()}) > 2
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["k", "text", "inner_pad", "key_id", "replacements", "redacted"]
    for r in got:
        want = r["text"]
        for word in (want or "").split():
            want = want.replace(word, names.get(word, word))
        assert r["redacted"] == want
        assert [x["value"] for x in r["replacements"]] == [names[w] for w in (r["text"] or "").split() if w in names]


def test_lengths_follow_what_most_names_of_a_stem_have(spark):
    names = spark.createDataFrame([(f"MASKED_A_KEY_{i:06X}",) for i in range(5)] + [("MASKED_A_KEY_0001",), ("MASKED_B_TOKEN_0001",), ("odd",)], "placeholder string")
    assert R.usual_lengths(names) == {"MASKED_A_KEY": 6, "": 3}


def test_texts_without_hits_do_not_move(spark, monkeypatch):
    """User rules, broadcasts off: only the key is broadcast, nothing is exchanged."""
    rules, problems = build_rules(spark, [{"id": "own", "provider": "own", "description": "d", "regex": "own-[0-9]{6}"}])
    assert not problems
    monkeypatch.setattr(joins, "is_small", lambda *a, **k: False)
    monkeypatch.setattr(R, "is_small", lambda *a, **k: False)
    docs = spark.createDataFrame([(1, "own-123456 x"), (2, "plain")], "i int, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, added = R.redact_df(docs, "text", ["i"], empty_vault(spark), key_frame(spark, KEY), ScanOptions(custom=tuple(rules)))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "SortMergeJoin" not in plan
        assert [r["redacted"][:10] for r in out.orderBy("i").collect()] == ["MASKED_OWN", "plain"] and added.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_in_row_names_equal_the_allocated_ones(spark):
    rows = [(s, "npm", "npm-access-token", i) for i, s in enumerate(tokens(50))]
    seen = spark.createDataFrame(rows, "secret string, provider string, rule_id string, first_seen int")
    named = allocate(seen, empty_vault(spark), key_frame(spark, KEY), "MASKED")
    sightings = seen.withColumn("found_by", F.array(F.struct("provider", "rule_id")))
    odd = R.exceptions_of(sightings, named, key_frame(spark, KEY), {}, "MASKED")
    short = named.where(F.length("placeholder") == len("MASKED_NPM_TOKEN_0000"))
    assert odd.count() == 50 - short.count()
