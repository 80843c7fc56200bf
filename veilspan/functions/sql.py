"""The scalar functions for SQL users, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import predicates as P
from .regex import to_java


def _raw(pattern: str) -> str:
    """A raw SQL string literal; a quote cannot stand in one and becomes its code point."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _words(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def placeholder_expression(prefix: str) -> str:
    low, bare = "lower(v)", "regexp_replace(lower(v), '[^a-z0-9]', '')"
    body = f"lower(regexp_replace(v, {_raw(P.PROVIDER_PREFIX)}, ''))"
    strong = "|".join(P.STRONG_WORDS)
    return " OR ".join([
        f"array_contains({_words(P.KNOWN_FAKES)}, v)",
        f"{low} RLIKE {_raw('|'.join((*P.STRONG_MARKERS, prefix.lower())))}",
        f"{low} RLIKE {_raw(rf'(?:\A|[^a-z0-9])(?:{strong})(?:\z|[^a-z0-9])')}",
        f"size(array_intersect(split({low}, '[^a-z0-9]+'), {_words(P.WEAK_WORDS)})) >= 2",
        f"array_contains({_words((*P.STRONG_WORDS, *P.WEAK_WORDS))}, {bare})",
        f"v RLIKE {_raw('(?i)' + chr(92) + 'A(?:' + '|'.join(P.REFERENCE_ROOTS) + ')[.' + chr(92) + '[]')}",
        f"v RLIKE {_raw(P.TEMPLATE_EDGE)}", f"{low} RLIKE 'x{{4,}}'",
        f"(length({body}) > 3 AND size(array_distinct(split({body}, ''))) <= 2)",
        f"{low} RLIKE {_raw('|'.join(P.SEQUENCES))}", f"v RLIKE {_raw(to_java(P.SAME_CHARACTER))}",
    ])


def register_functions(spark: SparkSession, prefix: str = "MASKED") -> None:
    """Define shannon_entropy(s), fingerprint(v, salt), is_placeholder_value(v), has_placeholders(s)."""
    part = "(length(s) - length(replace(s, c, ''))) / length(s)"
    functions = {
        "shannon_entropy(s STRING) RETURNS DOUBLE":
            f"CASE WHEN length(s) = 0 THEN 0D ELSE aggregate(array_distinct(split(s, '')), 0D, (a, c) -> a - {part} * log2({part})) END",
        "fingerprint(v STRING, salt STRING) RETURNS STRING": "substring(sha2(concat(salt, ' ', v), 256), 1, 32)",
        "is_placeholder_value(v STRING) RETURNS BOOLEAN": placeholder_expression(prefix),
        "has_placeholders(s STRING) RETURNS BOOLEAN": f"coalesce(contains(s, '{prefix}_'), false)",
    }
    for signature, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
