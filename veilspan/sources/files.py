"""Text files as rows (path, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import forward_slashes

# Folders never entered, and the size to give as ``max_bytes`` where large files are to be passed over.
SKIPPED_FOLDERS = ("node_modules", ".git", "dist", "build", "out", ".next", "vendor", "target", ".venv", "__pycache__")
OWN_STATE = ".veilspan"
MAX_BYTES = 2 * 1024 * 1024
CHANGED = ("A", "C", "M", "R")


def text_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Every admitted file below a folder: no NUL, bad bytes replaced.

    ``max_bytes``, unlimited by default, is pushed into the listing, so larger files are not read.
    """
    folders = "|".join(name.replace(".", r"\.") for name in (*SKIPPED_FOLDERS, OWN_STATE))
    base, path = root.rstrip("/") + "/", forward_slashes(F.col("path"))
    inside = F.substring(path, F.instr(path, base) + len(base), F.length(path))
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
           .option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root))
    if max_bytes is not None:
        raw = raw.filter(F.col("length") <= max_bytes)
    listed = raw.filter(~F.rlike(inside, F.lit(rf"(?:\A|/)(?:{folders})/")))
    return admitted(listed.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")))


def admitted(files: DataFrame) -> DataFrame:
    return files.filter(~F.contains("text", F.lit("\0")))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per input, for the filter use: text in, masked or restored text out."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text").withColumn("path", F.input_file_name())


def staged(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files a change list (path, status) adds, copies, modifies or renames."""
    changed = manifest.filter(F.col("status").isin(*CHANGED)).select("path").distinct()
    return admitted(files.join(changed, "path", "left_semi"))
