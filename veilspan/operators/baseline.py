"""Baseline of accepted findings: salted fingerprints with a hint where they were seen."""

from __future__ import annotations

import json
import secrets
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import fingerprint, forward_slashes
from ..options import ScanOptions
from .joins import attach, cut_lineage, lookup
from .store import SharedFiles
from .scan import BASELINE_NOTE, FINDING, FINDINGS, TEST_PATH_NOTE

BASELINE_JSON = "version int, salt string, accepted map<string,string>, _corrupt_record string"


def build_baseline(findings: DataFrame, path_col: str, salt: str) -> DataFrame:
    """One row per distinct secret; the hint is the last place in path order.

    ``findings`` are the blocking findings with ``line``, scanned without a baseline.
    """
    hint = F.concat(forward_slashes(F.col(path_col)), F.lit(":"), F.col("line").cast("string"), F.lit(" "), "rule_id")
    return (findings.groupBy(fingerprint(F.col("match"), salt).alias("fingerprint"))
            .agg(F.max_by(hint, F.struct(F.col(path_col), F.col("start"))).alias("hint")))


def load_baseline_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows (salt, fingerprint, hint) of a baseline file; a corrupt file gives none."""
    raw = spark.read.schema(BASELINE_JSON).option("multiLine", True).json(path)
    return (raw.filter((F.col("version") == 1) & F.col("salt").isNotNull() & F.col("accepted").isNotNull())
            .select("salt", F.explode("accepted").alias("fingerprint", "hint")))


class BaselineConflict(Exception):
    """Another rebuild committed first."""


class BaselineStore(SharedFiles):
    """Rebuilt baselines: FOLDER/entries/ID/ holds fingerprints and hints, FOLDER/versions/N.json names them and their salt.

    A rebuild starts anew, with a fresh salt, and never layers onto the one before.  Readers see the old version
    or the new one, whole: the version is committed by a rename, after its entries.  The last ``kept`` versions stay, so that who
    began to read one can finish.
    """

    def __init__(self, spark: SparkSession, path: str, kept: int = 2):
        super().__init__(spark, path, ("versions", "entries"))
        self.kept = max(1, kept)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._listed("versions") if n[:-5].isdigit() and n.endswith(".json"))

    def _body(self, version: int) -> dict:
        return json.loads(self._read(f"versions/{version}.json"))

    def rebuild(self, findings: DataFrame, path_col: str, salt: str | None = None) -> tuple[int, int]:
        """Version and number of distinct secrets; ``findings`` are scanned without a baseline.

        The salt is drawn by the system's generator unless one is given.  A lost executor repeats a task of the one
        write; nothing is visible before the commit.
        """
        done, salt, name = self.versions(), salt or secrets.token_hex(16), uuid.uuid4().hex
        build_baseline(findings, path_col, salt).write.parquet(f"{self.path}/entries/{name}")
        n = self.spark.read.schema("fingerprint string, hint string").parquet(f"{self.path}/entries/{name}").count()
        version = (done[-1] if done else 0) + 1
        if not self._put(f"versions/{version}.json", json.dumps({"salt": salt, "entries": name, "n": n}).encode()):
            self._files.delete(self._at(f"entries/{name}"), True)
            raise BaselineConflict(f"version {version} of the baseline exists")
        for old in self.versions()[:-self.kept]:
            self._files.delete(self._at(f"entries/{self._body(old)['entries']}"), True)
            self._files.delete(self._at(f"versions/{old}.json"), False)
        return version, n

    def load(self, version: int | None = None) -> tuple[str, DataFrame]:
        """Salt and (fingerprint, hint) of a version, the last by default; before any rebuild nothing is accepted."""
        done = self.versions()
        if not done:
            return "", self.spark.createDataFrame([], "fingerprint string, hint string")
        body = self._body(done[-1] if version is None else version)
        return body["salt"], self.spark.read.schema("fingerprint string, hint string").parquet(f"{self.path}/entries/{body['entries']}")


def mark_accepted(findings: DataFrame, baseline: DataFrame, salt: str, spread_by: list[str]) -> DataFrame:
    """Add ``accepted``: does the finding's fingerprint stand in the baseline?"""
    known = baseline.select("fingerprint").distinct().withColumn("accepted", F.lit(True))
    marked = lookup(findings.withColumn("fingerprint", fingerprint(F.col("match"), salt)), known, "fingerprint", spread_by)
    return marked.withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def new_findings(findings: DataFrame, baseline: DataFrame, salt: str, spread_by: list[str]) -> DataFrame:
    return mark_accepted(findings, baseline, salt, spread_by).filter(~F.col("accepted")).drop("accepted")


def with_baseline(scanned: DataFrame, baseline: DataFrame, salt: str, keys: list[str],
                  options: ScanOptions = ScanOptions()) -> DataFrame:
    """Move accepted findings of a scanned frame from ``findings`` to ``suppressed``.

    The scanned frame is written once, so that looking up its findings does not scan again: drop
    the texts before.  Only rows with findings are looked up.  The baseline stands before the
    test-path downgrade on the ladder; a downgraded finding that is accepted is reported with
    the confidence its rule gave it.
    """
    scanned = cut_lineage(scanned)
    rows = scanned.filter(F.size("findings") > 0).select(*keys, F.posexplode("findings").alias("_i", "_f")).select(
        *keys, "_i", F.col("_f.match").alias("match"))
    hits = (mark_accepted(rows, baseline, salt, [*keys, "_i"]).filter("accepted")
            .groupBy(*keys).agg(F.collect_set("_i").alias("_accepted")))
    given = F.from_json(F.lit(json.dumps({r.id: r.confidence for r in options.rules})), "map<string,string>")

    def rule_confidence(f: Column) -> Column:
        return F.when(f["note"] == TEST_PATH_NOTE, F.coalesce(given[f["rule_id"]], f["confidence"])).otherwise(f["confidence"])

    taken = F.coalesce("_accepted", F.array().cast("array<int>"))

    def noted(f: Column) -> Column:
        return f.withField("note", F.lit(BASELINE_NOTE)).withField("confidence", rule_confidence(f))

    return (attach(scanned, hits, keys)
            .withColumn("suppressed", F.array_sort(F.concat("suppressed", F.transform(
                F.filter("findings", lambda f, i: F.array_contains(taken, i)), noted)).cast(FINDINGS),
                lambda a, b: a["start"] - b["start"]))
            .withColumn("findings", F.filter("findings", lambda f, i: ~F.array_contains(taken, i)))
            .drop("_accepted"))


__all__ = ["FINDING", "BaselineConflict", "BaselineStore", "build_baseline", "load_baseline_json", "mark_accepted", "new_findings", "with_baseline"]
