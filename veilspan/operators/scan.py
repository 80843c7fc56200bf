"""Scan a text column: findings, suppressed findings, and the findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import empty
from ..functions.predicates import has_pragma, is_placeholder_value, is_test_path, matches_glob
from ..functions.regex import to_java
from ..functions.text import line_number, line_of
from ..options import ScanOptions
from ..rules.catalogue import ENTROPY_RULE_ID
from .detect import detection_stages

FINDING = ("struct<rule_id:string,provider:string,match:string,start:int,end:int,"
           "confidence:string,entropy:double,note:string>")
FINDINGS = f"array<{FINDING}>"

PLACEHOLDER_NOTE = "placeholder value"
ALLOW_PATTERN_NOTE = "allowlist pattern"
ALLOW_PATH_NOTE = "allowlisted path"
BASELINE_NOTE = "accepted in baseline"
TEST_PATH_NOTE = "test/fixture path"


def pragma_note(options: ScanOptions) -> str:
    return f"{options.pragma}:allow pragma"


def usable_patterns(patterns: tuple[str, ...]) -> list[str]:
    """The allowlist patterns that compile; the others are ignored."""
    session = SparkSession.active()
    compiler = session.sparkContext._jvm.java.util.regex.Pattern
    usable = []
    for pattern in patterns:
        java = to_java(pattern)
        try:
            compiler.compile(java)
        except Exception:  # noqa: BLE001 - a syntax error raised by the JVM
            continue
        usable.append(java)
    return usable


def suppression_note(match: Column, start: Column, text: Column, path: Column | None,
                     options: ScanOptions) -> Column:
    """First rung of the ladder that applies, NULL for none (baseline and downgrade excluded)."""
    note = F.when(is_placeholder_value(match, options.prefix), F.lit(PLACEHOLDER_NOTE))
    # Looking up the line of a span only pays when the pragma word occurs at all.
    note = note.when(F.contains(F.lower(text), F.lit(options.pragma.lower()))
                     & has_pragma(line_of(text, start), options.pragma), F.lit(pragma_note(options)))
    for pattern in usable_patterns(options.allow_patterns):
        note = note.when(F.rlike(match, F.lit(pattern)), F.lit(ALLOW_PATTERN_NOTE))
    if path is not None and options.allow_paths:
        note = note.when(matches_glob(path, options.allow_paths), F.lit(ALLOW_PATH_NOTE))
    return note


def _finding(span: Column, confidence: Column, note: Column) -> Column:
    return F.struct(span["rule_id"].alias("rule_id"), span["provider"].alias("provider"),
                    span["match"].alias("match"), span["start"].alias("start"), span["end"].alias("end"),
                    confidence.alias("confidence"), span["entropy"].alias("entropy"), note.alias("note"))


def _judged(spans: Column, text: Column, options: ScanOptions, path: Column | None) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s.alias("span"), suppression_note(s["match"], s["start"], text, path, options).alias("note")))


def _verdicts(judged: Column, path: Column | None) -> Column:
    """Struct of ``findings`` and ``suppressed`` from the judged spans."""
    in_test = F.lit(False) if path is None else is_test_path(path)
    active = F.transform(F.filter(judged, lambda j: j["note"].isNull()), lambda j: _finding(
        j["span"], F.when(in_test, F.lit("low")).otherwise(j["span"]["confidence"]), F.when(in_test, F.lit(TEST_PATH_NOTE))))
    stopped = F.transform(F.filter(judged, lambda j: j["note"].isNotNull()), lambda j: _finding(
        j["span"], j["span"]["confidence"], j["note"]))
    nothing = empty(FINDING)
    return F.struct(
        F.when(F.size(judged) == 0, nothing).otherwise(active.cast(FINDINGS)).alias("findings"),
        F.when(F.size(judged) == 0, nothing).otherwise(stopped.cast(FINDINGS)).alias("suppressed"))


def _generated(*columns: Column) -> Column:
    """One generated row of columns: computed once, and never merged into what follows."""
    return F.inline(F.array(F.struct(*columns)))


_BUILT: dict[tuple, list[Column]] = {}


def _scan_stages(text_col: str, options: ScanOptions, path_col: str | None) -> list[Column]:
    """The generators of a scan, built once per session: together they have thousands of nodes."""
    key = (id(SparkSession.active().sparkContext), text_col, options, path_col)
    if key not in _BUILT:
        text, path = F.col(text_col), None if path_col is None else F.col(path_col)
        stages = [*detection_stages(text, options), ("_veil_judged", _judged(F.col("_veil_spans"), text, options, path))]
        _BUILT[key] = [_generated(column.alias(name)) for name, column in stages]
        _BUILT[key].append(F.inline(F.array(_verdicts(F.col("_veil_judged"), path))))
    return _BUILT[key]


def scan_df(df: DataFrame, text_col: str, options: ScanOptions = ScanOptions(),
            path_col: str | None = None) -> DataFrame:
    """Add the array columns ``findings`` and ``suppressed``.

    A chain of one-row generators: narrow, pipelined in one stage, no shuffle.  A generator also
    keeps the optimizer from merging the scan into later filters and projections, where it
    would run once per reference.
    """
    out = df
    for stage in _scan_stages(text_col, options, path_col):
        out = out.select("*", stage)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "findings", "suppressed")


def is_blocking(finding: Column, options: ScanOptions) -> Column:
    return F.when(finding["rule_id"] == ENTROPY_RULE_ID, F.lit(options.entropy_action == "block")).otherwise(
        finding["confidence"] != "low")


def blocking(findings: Column, options: ScanOptions) -> Column:
    """Findings serious enough to act on."""
    return F.filter(findings, lambda f: is_blocking(f, options))


def findings_table(scanned: DataFrame, keys: list[str], text_col: str | None = None) -> DataFrame:
    """One row per finding of a scanned frame, active and suppressed, with its line."""
    keep = [*keys, *([text_col] if text_col else [])]
    both = F.concat(
        F.transform("findings", lambda f: F.struct(F.lit("active").alias("status"), f.alias("f"))),
        F.transform("suppressed", lambda f: F.struct(F.lit("suppressed").alias("status"), f.alias("f"))))
    rows = scanned.select(*keep, F.explode(both).alias("x")).select(*keep, "x.status", "x.f.*")
    if text_col:
        rows = rows.withColumn("line", line_number(F.col(text_col), F.col("start"))).drop(text_col)
    return rows


def self_test(spark: SparkSession, options: ScanOptions = ScanOptions()) -> bool:
    """Does the engine find a known shape, exactly once, right now?"""
    canary = "AKIA" + "4KTNQ7VZL2WXMP3D"
    found = scan_df(spark.createDataFrame([(f'aws_access_key_id = "{canary}"',)], "text string"), "text", options)
    return found.select(F.size(blocking(F.col("findings"), options)).alias("n")).first()["n"] == 1
