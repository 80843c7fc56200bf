"""Mask env files at rest and restore them, with the originals kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import is_env_masked
from ..functions.text import path_key
from ..options import ScanOptions
from .joins import lookup
from .redact import redact_df, rehydrate_df

ORIGINALS = "path_key string, path string, text string, locked_as string"


def file_identity(path: Column, text: Column) -> Column:
    """What a file is and holds: files that share a path, or have none, are told apart by their text."""
    return F.sha2(F.to_json(F.struct(path.alias("path"), text.alias("text"))), 256)


def lock_files(df: DataFrame, vault: DataFrame, key: DataFrame,
               options: ScanOptions = ScanOptions()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files (path, text) with ``locked_text``, ``status`` and ``locked``; originals; new vault rows.

    An original knows the file it was locked as, so that files that share a path keep their own.  Write the originals before the locked texts: they are what survives an expired vault.
    """
    masked, added = redact_df(df, "text", ["path"], vault, key, options, "path")
    already = is_env_masked(F.col("text"), options.prefix)
    n = F.size("replacements")
    out = (masked.withColumn("status", F.when(already, "already").when(n == 0, "skipped").otherwise("locked"))
           .withColumn("locked_text", F.when(F.col("status") == "locked", F.col("redacted")).otherwise(F.col("text")))
           .withColumn("locked", F.when(F.col("status") == "locked", n).otherwise(0)))
    originals = out.filter(F.col("status") == "locked").select(
        path_key(F.col("path")).alias("path_key"), "path", "text", file_identity(F.col("path"), F.col("locked_text")).alias("locked_as"))
    return out.select("path", "text", "locked_text", "status", "locked"), originals, added


def originals_of(current: DataFrame, originals: DataFrame, newest: str | None = None) -> DataFrame:
    """Add ``original``, of the very file that was locked (``known``), else, where it was changed since, of its path.

    Of several originals of a path that of the largest ``newest``, a column of ``originals``, is taken; without such a
    column a path of different originals has none, rather than another file's text.
    """
    keyed = (current.withColumn("_file", file_identity(F.col("path"), F.col("text")))
             .withColumn("_path", path_key(F.coalesce(F.col("path"), F.lit("")))))
    last = F.col("text") if newest is None else F.struct(newest, "text")
    own = originals.groupBy(F.col("locked_as").alias("_file")).agg(F.max_by("text", last).alias("_own"))
    per = originals.where(F.col("path").isNotNull()).groupBy(F.col("path_key").alias("_path"))
    if newest is None:
        other = per.agg(F.min("text").alias("_least"), F.max("text").alias("_most")).select("_path", F.when(F.col("_least") == F.col("_most"), F.col("_most")).alias("_other"))
    else:
        other = per.agg(F.max_by("text", last).alias("_other"))
    found = lookup(lookup(keyed, own, "_file", ["_file"]), other, "_path", ["_file"])
    return found.withColumn("original", F.coalesce("_own", "_other")).withColumn("known", F.col("_own").isNotNull()).drop("_file", "_path", "_own", "_other")


def unlock_files(df: DataFrame, vault: DataFrame, originals: DataFrame,
                 options: ScanOptions = ScanOptions(), newest: str | None = None) -> DataFrame:
    """Restore from the vault when that is complete, else from the original, else in part.

    ``restored`` is -1 when the original was used; a partial restore leaves the file as it is.  A file is locked if a line
    of it says so, or if it is known as one that was: a placeholder may stand inside a longer value.
    """
    joined = originals_of(rehydrate_df(df, "text", ["path"], vault, options), originals, newest)
    locked = F.col("known") | is_env_masked(F.col("text"), options.prefix)
    clean = (F.col("substituted") > 0) & (F.size("warnings") == 0)
    used = locked & ~clean & F.col("original").isNotNull()
    source = F.when(~locked, "not locked").when(clean, "vault").when(used, "original").otherwise("partial")
    text = F.when(source == "vault", F.col("restored")).when(source == "original", F.col("original")).otherwise(F.col("text"))
    count = F.when(source == "not locked", 0).when(source == "original", -1).otherwise(F.col("substituted"))
    messages = F.transform("warnings", lambda w: w["message"])
    missing = F.array(F.lit("no original found; some values could not be restored"))
    notes = F.when(source == "partial", F.concat(messages, missing)).when(
        source == "original", messages).otherwise(F.array().cast("array<string>"))
    return joined.select("path", text.alias("unlocked_text"), source.alias("source"), count.alias("restored"),
                         used.alias("used_backup"), notes.alias("notes"))
