"""The vault: a table of placeholder, secret and time, plus the key that names placeholders."""

from __future__ import annotations

import secrets as entropy
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import hmac_sha256_hex, key_pads
from .joins import cut_lineage

VAULT = "placeholder string, secret string, at timestamp"
TTL = timedelta(hours=12)
FIRST_LENGTH, STEP, LAST_LENGTH = 4, 2, 64
INNER, OUTER = "_veil_inner", "_veil_outer"

# The kind named in a placeholder, by the first pattern found in the rule id.
KINDS = (
    ("private-key|pem|ssh|putty", "PEM"),
    ("jwt", "JWT"),
    ("webhook", "URL"),
    ("connection-string|jdbc|basic-auth|password|passwd", "PASSWORD"),
    ("pat|token|authtoken", "TOKEN"),
    ("secret", "SECRET"),
    ("key", "KEY"),
)
DEFAULT_KIND = "SECRET"


def kind_of(rule_id: Column) -> Column:
    kind = F.when(F.rlike(rule_id, F.lit(KINDS[0][0])), F.lit(KINDS[0][1]))
    for pattern, name in KINDS[1:]:
        kind = kind.when(F.rlike(rule_id, F.lit(pattern)), F.lit(name))
    return kind.otherwise(F.lit(DEFAULT_KIND))


def provider_word(provider: Column) -> Column:
    word = F.btrim(F.regexp_replace(F.upper(provider), "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(word, F.lit("")), F.lit("UNKNOWN"))


def stem(provider: Column, rule_id: Column, prefix: str) -> Column:
    return F.concat_ws("_", F.lit(prefix), provider_word(provider), kind_of(rule_id))


def new_key() -> bytes:
    return entropy.token_bytes(32)


def key_frame(spark: SparkSession, key: bytes) -> DataFrame:
    """One row holding the key blocks.  The key is data, so no plan or log prints it."""
    inner, outer = key_pads(key)
    return spark.createDataFrame([(0, bytearray(inner), bytearray(outer))], "key_id int, inner_pad binary, outer_pad binary")


def empty_vault(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VAULT)


def live(vault: DataFrame, now: Column, ttl: timedelta = TTL) -> DataFrame:
    """Entries young enough; rows without a secret or a time are ignored."""
    return vault.filter(F.col("secret").isNotNull() & F.col("placeholder").isNotNull()
                        & (F.col("at") >= now - F.lit(ttl)))


def refreshed(vault: DataFrame, added: DataFrame, now: Column) -> DataFrame:
    """A redaction renews every live entry, so the expiry slides for the whole vault."""
    return vault.select("placeholder", "secret").unionByName(added.select("placeholder", "secret")).withColumn("at", now)


def with_pads(df: DataFrame, key: DataFrame) -> DataFrame:
    """Add the key blocks as ``INNER`` and ``OUTER``; the key frame has one row."""
    pads = key.select(F.col("key_id").alias("_veil_key"), F.col("inner_pad").alias(INNER), F.col("outer_pad").alias(OUTER))
    return df.withColumn("_veil_key", F.lit(0)).join(F.broadcast(pads), "_veil_key").drop("_veil_key")


def digests(new_secrets: DataFrame, key: DataFrame) -> DataFrame:
    """Add ``digest``, the keyed digest of ``secret``."""
    return (with_pads(new_secrets, key).withColumn("digest", hmac_sha256_hex(F.col("secret"), F.col(INNER), F.col(OUTER)))
            .drop(INNER, OUTER))


def allocate(new_secrets: DataFrame, vault: DataFrame, key: DataFrame, prefix: str) -> DataFrame:
    """Placeholders for secrets the vault does not know: rows (placeholder, secret).

    ``new_secrets`` has one row per secret: secret, provider, rule_id, first_seen (sortable).
    At each suffix length the first secret seen takes a free name and the others try the next
    length.  That equals naming them one by one: an earlier secret can only block a later one
    at a length both reach.
    """
    unknown = new_secrets.join(vault.select("secret"), "secret", "left_anti")
    pending = cut_lineage(digests(unknown, key).select(
        "secret", "digest", "first_seen", stem(F.col("provider"), F.col("rule_id"), prefix).alias("stem")))
    named = None
    for length in range(FIRST_LENGTH, LAST_LENGTH + 1, STEP):
        tried = pending.withColumn("placeholder", F.concat("stem", F.lit("_"), F.substring("digest", 1, length)))
        free = tried.join(vault.select("placeholder"), "placeholder", "left_anti")
        order = Window.partitionBy("placeholder").orderBy("first_seen", "secret")
        won = free.withColumn("turn", F.row_number().over(order)).filter("turn = 1").select("placeholder", "secret")
        named = won if named is None else named.unionByName(won)
        rest = pending.join(won.select("secret"), "secret", "left_anti")
        if rest.isEmpty():
            return named
        pending = cut_lineage(rest)
    raise ValueError("no free placeholder left for a secret")


def _versions(spark: SparkSession, path: str):
    """Hadoop file system and the numbers of the complete versions under ``path``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return fs, []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()
            and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return fs, sorted(done)


def save_vault(vault: DataFrame, path: str) -> None:
    """Write a new version; readers keep the last complete one until this one is done."""
    _, done = _versions(vault.sparkSession, path)
    vault.select("placeholder", "secret", "at").write.mode("overwrite").parquet(f"{path}/v{(done or [0])[-1] + 1}")


def extend_vault(added: DataFrame, path: str, now: Column) -> None:
    """Add entries and renew all of a stored vault that is alive, without rewriting it.

    A renewal is one row without a placeholder: it moves the expiry of every entry that was
    alive when it was written.
    """
    _, done = _versions(added.sparkSession, path)
    mark = added.sparkSession.range(1).select(F.lit(None).cast("string").alias("placeholder"), F.lit(None).cast("string").alias("secret"))
    (added.select("placeholder", "secret").unionByName(mark).withColumn("at", now)
     .write.mode("append").parquet(f"{path}/v{(done or [1])[-1]}"))


def load_vault(spark: SparkSession, path: str, now: Column | None = None, ttl: timedelta = TTL) -> DataFrame:
    """Live entries of the last version, each with the time of its last renewal."""
    _, done = _versions(spark, path)
    if not done:
        return empty_vault(spark)
    now = F.current_timestamp() if now is None else now
    stored = spark.read.schema(VAULT).parquet(f"{path}/v{done[-1]}")
    marks = stored.filter("placeholder IS NULL").agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    if marks["first"] is None:
        return live(stored, now, ttl)
    renewed = live(stored, F.lit(marks["first"]), ttl).withColumn("at", F.greatest("at", F.lit(marks["last"])))
    return live(renewed, now, ttl)


def clear_vault(spark: SparkSession, path: str) -> bool:
    """Remove every version; False when there was none."""
    fs, _ = _versions(spark, path)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(fs.delete(root, True)) if fs.exists(root) else False


def vault_status(vault: DataFrame) -> DataFrame:
    return vault.agg(F.count("*").alias("entries"), F.min("at").alias("oldest"), F.max("at").alias("newest"))
