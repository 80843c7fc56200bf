"""The prefix join by sorting, against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from veilspan.operators.prefixes import near_names


def by_hand(texts, names):
    return sorted({t for t in texts if t is not None and any(n is not None and (n.startswith(t) or t.startswith(n)) for n in names)})


def found(spark, texts, names):
    got = near_names(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    rows = [r["text"] for r in got.collect()]
    assert len(rows) == len(set(rows))
    return sorted(rows)


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_pairs_over_many_partitions(spark, seed):
    rng = random.Random(seed)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0 if seed else 1, 7)))
        texts, names = [word() for _ in range(150)] + [None, "zz"], [word() for _ in range([2, 20, 60, 0][seed])] + [None]
        assert found(spark, texts, names) == by_hand(texts, names)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_chains_ties_and_nothing(spark):
    chain = ["MASKED_A"[:n] for n in range(1, 9)]
    for texts, names in ((chain, ["MASK"]), (["MASK"], chain), (chain, chain), (["ab", "abd"], ["ab", "abca"]), (["abd"], ["ab", "abca", "abcab"]), ([], ["a"]), (["a"], []), (["a", "a"], ["a"])):
        assert found(spark, texts, names) == by_hand(texts, names)


def test_one_stem_is_split_evenly(spark):
    """100,000 tokens of one stem: no partition holds more than twice the median."""
    digest = F.upper(F.sha2(F.col("id").cast("string"), 256))
    ids = spark.range(100_000)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        texts = ids.select(F.concat(F.lit("MASKED_NPM_TOKEN_"), F.substring(digest, 1, 9)).alias("text"))
        names = ids.where("id % 3 = 0").select(F.concat(F.lit("MASKED_NPM_TOKEN_"), F.substring(digest, 1, 6)).alias("name"))
        near = near_names(texts, names).withColumn("part", F.spark_partition_id())
        sizes = sorted(r["count"] for r in near.groupBy("part").count().collect())
        assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8] and sum(sizes) >= 33_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
