"""The labelled corpus of three kinds and how its hits are counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.operators import score as S
from veilspan.operators.scan import blocking, scan_df
from veilspan.options import ScanOptions
from veilspan.rules.catalogue import BUILTIN
from veilspan.sources.samples import LOOK_ALIKES, SHAPES, with_look_alikes, with_messages


def hits():
    return F.transform(blocking(F.col("findings"), ScanOptions()), lambda f: f["match"])


def test_every_rule_has_a_shape():
    assert {s.rule_id for s in SHAPES} == {r.id for r in BUILTIN}


def test_look_alikes_are_left_alone(spark):
    df = with_look_alikes(spark.range(len(LOOK_ALIKES) * 20).withColumn("text", F.lit("plain words")), "id")
    assert df.select("look_alike").distinct().count() == len(LOOK_ALIKES)
    assert df.select("text").distinct().count() > len(LOOK_ALIKES) * 10
    assert scan_df(df, "text").where(F.size(blocking(F.col("findings"), ScanOptions())) > 0).count() == 0


def test_messages_hold_none_to_two_credentials_and_all_are_claimed(spark):
    df = with_messages(spark.range(len(SHAPES) * 6).withColumn("text", F.lit("plain words")), "id")
    sizes = {r[0]: r[1] for r in df.groupBy(F.size("expected_secrets")).count().collect()}
    assert set(sizes) == {0, 1, 2}
    assert df.where(~F.forall("expected_secrets", lambda e: F.contains("text", e))).count() == 0
    done = S.mixed_counts(scan_df(df, "text").withColumn("hits", hits()), "hits", "expected_secrets")
    assert tuple(done.agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first()) == (sizes[1] + 2 * sizes[2], 0, 0)


def test_counts_per_kind_with_further_credentials(spark):
    df = spark.createDataFrame([("a", ["ab", "own", "zz"], "ab", ["own"]), ("a", ["own"], "ab", ["own", "lost"]), ("b", [], "ab", [])],
                               "kind string, hits array<string>, expected string, own array<string>")
    by = ("kind",)
    assert sorted(map(tuple, S.positive_counts(df, "hits", "expected", "own", by).collect())) == [("a", 0, 0, 1), ("a", 1, 1, 0), ("b", 0, 0, 1)]
    assert sorted(map(tuple, S.found_counts(df, "hits", "own", by).collect())) == [("a", 1, 0, 0), ("a", 1, 0, 1), ("b", 0, 0, 0)]
    rated = {r["kind"]: r for r in S.scores(S.positive_counts(df, "hits", "expected", "own", by), by).collect()}
    assert (rated["a"]["precision"], rated["a"]["recall"], rated["b"]["recall"], rated["b"]["precision"]) == (0.5, 0.5, 0.0, 1.0)
