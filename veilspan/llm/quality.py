"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are column expressions.  Trees fitted on labelled rows give rules: every path from a
root is a conjunction of threshold tests.  A logistic regression with an L1 penalty over the rules
keeps a few; they are compiled into one column expression, so that scoring is a narrow JVM-side pass without a model object.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, held_out, join_measured, saved

#: At most so many labelled rows, by the hash of the id, fit the rules.
FIT_ROWS = 20_000
TREES = 12
DEPTH = 3
PENALTY = 5e-4
STATISTICS = ("chars", "words", "chars_a_word", "symbols", "upper", "digits", "different_words", "repeats", "short_words",
              "marked_words", "bars", "chars_a_line", "longest_mark_run")

Test = tuple[int, str, float]


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests (statistic, "<=" or ">", threshold) and its weight."""

    tests: tuple[Test, ...]
    weight: float = 0.0


def with_statistics(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` plus an array of doubles, in the order of ``STATISTICS``.

    Shares are of words or of code points other than blanks.  Null and empty texts have zeros.
    """
    (body, words) = fresh(docs, "_body", "_words")
    source = F.coalesce(F.col(text), F.lit(""))
    staged = docs.withColumn(body, F.regexp_replace(source, r"\s+", " "))
    staged = staged.withColumn(words, F.filter(F.split(F.col(body), " "), lambda w: w != ""))
    w, n = F.col(words), F.greatest(F.size(words), F.lit(1)).cast("double")
    solid = F.greatest(F.length(body) - F.size(words) + 1, F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return (F.length(body) - F.length(F.regexp_replace(F.col(body), pattern, ""))) / solid

    lines = F.length(source) - F.length(F.replace(source, F.lit("\n"), F.lit(""))) + 1
    repeats = F.size(F.filter(F.arrays_zip(F.slice(w, 2, 1 << 30).alias("a"), F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("b")),
                              lambda p: p["a"] == p["b"]))
    marked = F.size(F.filter(w, lambda x: F.substring(x, -2, 2).rlike(r"^[^\p{L}\p{N}]{2}$")))
    values = [F.length(source), F.size(words), F.length(body) / n, share(r"[\p{L}\p{N} ]+") * 0 + (F.length(F.regexp_replace(F.col(body), r"[\p{L}\p{N} ]+", ""))) / solid,
              share(r"\p{Lu}+"), share(r"\p{N}+"), F.size(F.array_distinct(w)) / n, repeats / n,
              F.size(F.filter(w, lambda x: F.length(x) <= 2)) / n, marked / n, share(r"\|+"), F.length(source) / lines,
              F.length(F.regexp_extract(F.col(body), r"([^\p{L}\p{N}\s])\1\1+", 0))]
    return staged.withColumn(name, F.array(*[v.cast("double") for v in values])).drop(body, words)


def paths(tree: str) -> set[tuple[Test, ...]]:
    """Conjunctions of all paths from the roots, inner nodes included, of a printed forest."""
    out: set[tuple[Test, ...]] = set()
    stack: list[Test] = []
    for line in tree.splitlines():
        found = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if line.lstrip().startswith("Tree "):
            stack, base = [], None
        elif found:
            indent = len(found[1])
            base = indent if not stack and base is None else base
            stack = stack[:indent - base]
            stack.append((int(found[2]), found[3], float(found[4])))
            out.add(_shortened(stack))
    return out


def _shortened(tests: list[Test]) -> tuple[Test, ...]:
    """Of several tests of one statistic in one direction the strictest counts."""
    best: dict[tuple[int, str], float] = {}
    for at, sign, bound in tests:
        known = best.get((at, sign), bound)
        best[(at, sign)] = min(known, bound) if sign == "<=" else max(known, bound)
    return tuple(sorted((at, sign, bound) for (at, sign), bound in best.items()))


def holds(tests: tuple[Test, ...], stats: Column) -> Column:
    out = F.lit(True)
    for at, sign, bound in tests:
        value = stats[at]
        out = out & (value <= F.lit(bound) if sign == "<=" else value > F.lit(bound))
    return out


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self, stats: Column) -> Column:
        """The compiled rules: a number between 0 and 1."""
        odds = F.lit(self.intercept)
        for rule in self.rules:
            odds = odds + F.when(holds(rule.tests, stats), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    def transform(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        (stats,) = fresh(docs, "_stats")
        return with_statistics(docs, text, stats).withColumn(name, self.score(F.col(stats))).drop(stats)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        fit_rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """Fits on at most ``fit_rows`` labelled rows whose id is not held out.

    Null labels and ids are no labels; an id labelled twice counts with its smaller label.  Without
    rows of both classes the score is the share of ones.  Repeated documents count as often as they occur.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.min(label).cast("double").alias("label"))
    known = saved(known.orderBy(F.xxhash64("id"), "id").limit(fit_rows), "labels")  # bounded, and so broadcast
    source = docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("text"))
    rows = join_measured(source, known, F.col("own_id") == F.col("id"), "inner")
    seen = saved(with_statistics(rows).select("stats", "label"), "statistics")
    ones, n = seen.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if ones in (0.0, float(n)):
        share = (ones + 0.5) / (n + 1)
        import math

        return RuleModel((), math.log(share / (1 - share)))
    as_vector = F.udf(Vectors.dense, VectorUDT())
    ready = seen.select(as_vector("stats").alias("features"), "label", "stats")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="0.5").fit(ready)
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7).fit(ready)
    found = sorted(paths(forest.toDebugString) | paths(boosted.toDebugString))
    if not found:
        share = ones / n
        import math

        return RuleModel((), math.log(share / (1 - share)))
    flags = seen.select("label", F.array(*[holds(t, F.col("stats")).cast("double") for t in found]).alias("flags"))
    sparse = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
    lasso = sparse.fit(flags.select(as_vector("flags").alias("features"), "label"))
    rules = tuple(Rule(t, float(w)) for t, w in zip(found, lasso.coefficients.toArray()) if abs(w) > 1e-6)
    return RuleModel(rules, float(lasso.intercept))
