"""Rule selection and the rule table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .catalogue import BUILTIN, Rule

RULE_SCHEMA = (
    "ord int, id string, provider string, description string, pattern string, flags string, "
    "prefilter array<string>, grp int, entropy_min double, confidence string, validator string"
)


def assert_unique(rules: Iterable[Rule]) -> None:
    repeated = [rule_id for rule_id, n in Counter(r.id for r in rules).items() if n > 1]
    if repeated:
        raise ValueError(f"duplicate rule id: {', '.join(sorted(repeated))}")


assert_unique(BUILTIN)


def select_rules(disabled: Iterable[str] = (), custom: Sequence[Rule] = (),
                 builtin: Sequence[Rule] = BUILTIN) -> tuple[Rule, ...]:
    """Custom rules first, then the catalogue, without the disabled ids and providers."""
    drop = set(disabled)
    return tuple(r for r in (*custom, *builtin) if r.id not in drop and r.provider not in drop)


def rules_df(spark: SparkSession, rules: Sequence[Rule] = BUILTIN) -> DataFrame:
    rows = [(i, r.id, r.provider, r.description, r.pattern, r.flags, list(r.prefilter),
             r.group, r.entropy_min, r.confidence, r.validator) for i, r in enumerate(rules, 1)]
    return spark.createDataFrame(rows, RULE_SCHEMA)
