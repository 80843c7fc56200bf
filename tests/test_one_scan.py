"""Masking reads its texts once, whatever follows; a table of one small file is dealt to many tasks; odd types pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.operators.joins import spread
from veilspan.operators.redact import redact_df, rehydrate_df
from veilspan.operators.vault import empty_vault, key_frame, refreshed

AWS = "AKIA" + "4KTNQ7VZL2WXMP3D"


def test_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.range(20).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit(f"k = {AWS} "), "id")).otherwise("plain").alias("text"))
    out, added = redact_df(rows.mapInPandas(passed, "id long, text string"), "text", ["id"], empty_vault(spark), key_frame(spark, b"k"))
    masked = out.select("id", F.col("text").alias("was"), F.col("redacted").alias("text"))
    back = rehydrate_df(masked, "text", ["id"], refreshed(empty_vault(spark), added, F.current_timestamp()))
    assert back.where("restored = was").count() == 20 and back.agg(F.sum("substituted")).first()[0] == 10
    assert read.value == 20


def test_types_that_files_do_not_know(spark):
    rows = spark.createDataFrame([(1, AWS)], "id int, text string").withColumn("none", F.lit(None)).withColumn("every", F.make_interval(F.lit(1)))
    out, _ = redact_df(rows, "text", ["id"], empty_vault(spark), key_frame(spark, b"k"))
    (r,) = out.select("id", "none", F.col("every").cast("string").alias("every"), "redacted").collect()
    assert (r["id"], r["none"], r["every"]) == (1, None, "1 years") and r["redacted"].startswith("MASKED_AWS_KEY_")


def test_few_pieces_are_spread(spark):
    one = spark.range(40_000, numPartitions=1)
    sizes = [r["count"] for r in spread(one).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 16 and max(sizes) < 5_000 and sum(sizes) == 40_000
    assert spread(one).agg(F.sum("id")).first()[0] == 40_000 * 39_999 // 2
    for kept in (spark.range(40_000, numPartitions=16), spark.range(500, numPartitions=1), spark.range(0)):
        assert spread(kept) is kept


def test_a_vault_made_of_a_scan_is_made_once(spark, tmp_path, monkeypatch):
    from veilspan.plans import masking

    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.range(12).select(F.col("id").alias("doc_id"), F.concat(F.lit('api_key = "'), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40), F.lit('"')).alias("text"))
    monkeypatch.setattr(masking, "_texts", lambda *_: rows.mapInPandas(passed, "doc_id long, text string"))
    assert masking.masking_odd_keys(spark, str(tmp_path)).agg(F.sum("replaced")).first()[0] == 12
    assert read.value == 2 * 12
