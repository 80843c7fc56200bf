"""The round trip looks for secrets in the redacted texts themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspan.plans import masking


def test_secrets_that_stay_are_counted(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"note {i}", "en", "web") for i in range(60)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    (whole,) = masking.roundtrip_mismatches(spark, str(tmp_path)).collect()
    assert whole["texts"] == 60 and whole["mismatches"] == 0 and whole["secrets_left"] == 0 and whole["findings_left"] == 0 < whole["substituted"]
    redact = masking.redact_df

    def careless(*arguments):
        out, added = redact(*arguments)
        return out.withColumn("redacted", F.when(F.col("doc_id") < 5, F.col("text")).otherwise(F.col("redacted"))), added

    monkeypatch.setattr(masking, "redact_df", careless)
    (kept,) = masking.roundtrip_mismatches(spark, str(tmp_path)).collect()
    assert kept["mismatches"] == 0 and kept["secrets_left"] >= 5 and kept["findings_left"] >= 5


def test_no_texts(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in masking.roundtrip_mismatches(spark, str(tmp_path)).collect()] == [(0, 0, 0, 0, 0)]
