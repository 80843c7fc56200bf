"""Inputs of the registered queries: the given tables, with labelled samples derived from their ids.

Expressions are plain SQL understood by both engines, so that a query and its twin see one input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.joins import spread
from ..sources.samples import look_alike_sql, mixed_sql, sample_sql, with_look_alikes, with_messages, with_samples

# A path per document: some are tests, vendored code or secrets files.
PATH_SQL = ("source || CASE doc_id % 6 WHEN 0 THEN '/tests/' WHEN 1 THEN '/vendor/lib/' WHEN 2 THEN '/config/' "
            "ELSE '/src/app/' END || 'f' || {text} || CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' "
            "WHEN 2 THEN '.go' WHEN 3 THEN '.rb' WHEN 4 THEN '.php' WHEN 5 THEN '.sh' ELSE '/.env' END")
AS_TEXT = {"spark": "CAST(doc_id AS STRING)", "duckdb": "CAST(doc_id AS VARCHAR)"}
PRAGMA_SQL = "CASE doc_id % 3 WHEN 0 THEN '  # veilspan: allow' ELSE '' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in the pieces that its files and the session's split sizes give; no row is moved."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a sample appended, its label, a path and perhaps a pragma on its last line."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return with_samples(docs, "doc_id").withColumn("path", F.expr(PATH_SQL.format(text=AS_TEXT["spark"])))


def labelled_sql(extra: str = "''", key: str = "doc_id", name: str = "docs", columns: str = "doc_id, lang, source, path",
                 where_from: str = "documents", text: str = "text") -> str:
    """CTE ``docs``: the same rows on the checking engine."""
    sql = sample_sql(key, "duckdb")
    path = PATH_SQL.format(text=AS_TEXT["duckdb"]) if where_from == "documents" else "''"
    return (f"{name} AS (SELECT {columns}, {text} || chr(10) || ({sql['sample']}) || {extra} AS text, secret AS expected_secret, "
            f"{sql['rule_id']} AS expected_rule, {sql['provider']} AS expected_provider "
            f"FROM (SELECT *, {path} AS path, {sql['secret']} AS secret FROM {where_from}))")


def plain_sql(columns: str = "doc_id, lang", source: str = "documents") -> str:
    return f"docs AS (SELECT {columns}, text FROM {source})"


def with_prompt_samples(conversations: DataFrame) -> DataFrame:
    """Conversation turns with a row id; a user's turn carries a sample."""
    turns = spread(conversations).withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))
    done = with_samples(turns.withColumn("plain", F.col("text")), "row_id")
    return done.withColumn("text", F.when(F.col("role") == "user", F.col("text")).otherwise(F.col("plain"))).drop("plain")


def prompts_sql() -> str:
    sql = sample_sql("row_id", "duckdb")
    return (f"docs AS (SELECT row_id, conv_id, turn, role, CASE role WHEN 'user' THEN text || chr(10) || ({sql['sample']}) "
            f"ELSE text END AS text FROM (SELECT *, {sql['secret']} AS secret FROM "
            "(SELECT *, conv_id * 1000 + turn AS row_id FROM conversations)))")


# Credentials that the given documents hold of themselves, by the form in which they are written there.
OWN_CREDENTIAL = 'token = "([0-9a-f]{40})"'


def evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled texts of three kinds: documents with one credential each and ``own``, what they hold besides; turns of
    conversations with look-alikes; turns of users with messages of none to two credentials."""
    positive = labelled(spark, sf_dir).withColumn("own", F.regexp_extract_all("text", F.lit(OWN_CREDENTIAL), F.lit(1)))
    turns = spread(table(spark, sf_dir, "conversations")).withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))
    asked = F.col("role") == "user"
    negative = with_look_alikes(turns.where(~asked | F.col("role").isNull()), "row_id")
    return (positive.select("text", "expected_secret", "own"), negative.select("text", "look_alike"),
            with_messages(turns.where(asked), "row_id").select("text", "expected_secrets"))


def evaluated_sql() -> str:
    """CTE ``docs`` (id, kind, text, expected, own): the same texts on the checking engine."""
    none, mixed = look_alike_sql("row_id", "duckdb"), mixed_sql("row_id", "duckdb")
    return (f"{labelled_sql(columns='doc_id', name='positive')}, turns AS (SELECT *, conv_id * 1000 + turn AS row_id FROM conversations), "
            "docs AS (SELECT 'd' || doc_id AS id, 'sample' AS kind, text, [expected_secret] AS expected, "
            f"regexp_extract_all(text, '{OWN_CREDENTIAL}', 1) AS own FROM positive "
            f"UNION ALL SELECT 'n' || row_id, 'look-alike', text || chr(10) || {none['text']}, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) "
            "FROM turns WHERE role IS DISTINCT FROM 'user' "
            f"UNION ALL SELECT 'm' || row_id, 'message', text || chr(10) || {mixed['text']}, [first, second][1:{mixed['n']}], CAST([] AS VARCHAR[]) "
            f"FROM (SELECT *, {mixed['first']} AS first, {mixed['second']} AS second FROM turns WHERE role = 'user'))")
