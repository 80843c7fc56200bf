"""Reports over findings.  None of them shows a secret; a fingerprint stands for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import is_secrets_file
from ..functions.text import fingerprint


def report_rows(findings: DataFrame, path_col: str) -> DataFrame:
    """File, line, rule, provider, confidence of findings outside secrets files."""
    return findings.filter(~is_secrets_file(F.col(path_col))).select(
        F.col(path_col).alias("file"), "line", "rule_id", "provider", "confidence")


def provider_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings per provider of each text as one line, in order of appearance."""
    per = findings.groupBy(*keys, "provider").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "provider", "n"))), lambda p: F.when(
        p["n"] > 1, F.concat(p["n"].cast("string"), F.lit("x "), p["provider"])).otherwise(p["provider"])), ", ")
    return per.groupBy(*keys).agg(line.alias("providers"), F.sum("n").alias("findings"))


def secret_reuse(findings: DataFrame, place_cols: list[str], salt: str) -> DataFrame:
    """How often and in how many places each secret occurs."""
    return (findings.groupBy(fingerprint(F.col("match"), salt).alias("fingerprint"), *place_cols)
            .agg(F.count("*").alias("n")).groupBy("fingerprint")
            .agg(F.sum("n").alias("findings"), F.count("*").alias("places")))


def store_exposure(serious_per_file: DataFrame, ignored_paths: DataFrame, in_repository: Column) -> DataFrame:
    """Secrets files with credentials (path, credentials) and whether they would be published.

    The verdict contract is inferred from its uses: ignored, no-repo or exposed.
    """
    stores = serious_per_file.filter(is_secrets_file(F.col("path")) & (F.col("credentials") > 0))
    ignored = ignored_paths.select("path").distinct().withColumn("ignored", F.lit(True))
    status = F.when(~in_repository, "no-repo").when(F.col("ignored"), "ignored").otherwise("exposed")
    return (stores.join(ignored, "path", "left").withColumn("status", status)
            .withColumn("exposed", F.col("status") == "exposed").drop("ignored"))


def scan_totals(scanned_files: DataFrame, serious_col: str, path_col: str) -> DataFrame:
    """Files scanned, hardcoded findings and secrets files with credentials."""
    store, n = is_secrets_file(F.col(path_col)), F.size(serious_col)
    return scanned_files.agg(F.count("*").alias("scanned"),
                             F.coalesce(F.sum(F.when(~store, n)), F.lit(0)).alias("findings"),
                             F.count_if(store & (n > 0)).alias("stores"))


def has_findings(rows: DataFrame) -> bool:
    """The exit verdict of a scan; stops at the first row."""
    return not rows.isEmpty()


def rules_by_provider(rules: DataFrame) -> DataFrame:
    return (rules.groupBy("provider").agg(
        F.count("*").alias("rules"), F.array_sort(F.collect_list("id")).alias("ids")).orderBy("provider"))
