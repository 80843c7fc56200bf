"""Detection: which spans of a text are credentials.

Everything happens per row, inside one projection: no shuffle, no Python worker.  A text first
passes literal prefilters and one find-first regex per remaining rule; only rules that hit are
asked for all their matches and positions, so texts without credentials stay cheap.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from ..functions.columns import any_of, contains_any, empty, let, running
from ..functions.predicates import is_placeholder_value, mixes_classes, not_shell_variable, not_variable
from ..functions.regex import to_java
from ..functions.text import entropy_of, entropy_threshold, is_real_jwt
from ..options import ScanOptions
from ..rules.catalogue import (APART, BUILTIN, CONFIDENCE_RANK, ENTROPY_CANDIDATE, ENTROPY_PROVIDER, ENTROPY_RULE_ID,
                               IMPLIED_ASSIGNMENTS, IMPLIED_NAMES, IMPLIED_SHAPES, LONG_WORD, NAME_AHEAD, NAME_WORDS, PARTS,
                               SECRET_NAME, WHOLE_TEXT, Rule)

# ``start`` leads, so the natural order of a span is its place in the text.
SPAN = ("struct<start:int,end:int,rank:int,ord:int,seq:int,rule_id:string,provider:string,"
        "match:string,confidence:string,entropy:double>")
RULE_LITERAL = ("array<struct<id:string,provider:string,pattern:string,grp:int,entropy_min:double,"
                "confidence:string,rank:int,validator:string>>")

VALIDATORS = {
    "not-sibling-prefix": lambda s: ~F.startswith(s, F.lit("sk-ant-")),
    "not-variable": not_variable,
    "not-shell-variable": not_shell_variable,
    "mixed-classes": mixes_classes,
    "jwt": is_real_jwt,
}


def java_pattern(rule: Rule) -> str:
    trusted = rule in BUILTIN
    pattern = rule.pattern.replace(SECRET_NAME, NAME_AHEAD + SECRET_NAME) if trusted else rule.pattern
    return to_java(pattern, rule.flags, trusted)


def _shape(key: str) -> str:
    signals, rest = IMPLIED_SHAPES[key]
    return to_java(f"[{signals}]{rest}")


def _any_shape() -> str:
    """All shapes in one pattern, behind a single test for a signal character."""
    signals = "".join(s for s, _ in IMPLIED_SHAPES.values())
    branches = "|".join(f"(?<=[{s}]){rest}" for s, rest in IMPLIED_SHAPES.values())
    return to_java(f"[{signals}](?:{branches})")


def _implied(text: Column, key: str) -> Column:
    shape = F.rlike(text, F.lit(_shape(key)))
    if key in IMPLIED_NAMES:
        shape = shape & F.rlike(text, F.lit(to_java(IMPLIED_NAMES[key])))
    if key == "named-assignment":
        shape = shape & let(F.lower(text), lambda low: contains_any(low, NAME_WORDS))
    return shape


def worth_a_look(text: Column) -> Column:
    """False only when no catalogue rule and no entropy candidate can match."""
    return F.rlike(text, F.lit(_any_shape()))


def _pieces(text: Column) -> Column:
    """The runs without blanks that are long enough for a rule of one word, a line each."""
    return F.array_join(F.regexp_extract_all(text, F.lit(LONG_WORD), F.lit(0)), "\n")


def _assignments(text: Column) -> Column:
    """The lines that hold what an assignment rule asks for, in order; lines that one assignment may run over stay together."""
    shape = _shape("named-assignment")
    parts = F.filter(F.split(text, to_java(APART), -1), lambda p: contains_any(p, (":", "=")) & F.rlike(p, F.lit(shape)))
    return F.when(F.rlike(text, F.lit(shape)), F.array_join(parts, "\n")).otherwise(F.lit(""))


def rule_hits(text: Column, rules: tuple[Rule, ...], look: Column) -> Column:
    """1-based positions of the rules with at least one match in the text.

    Catalogue rules whose matches are one word, or one assignment, are asked of those parts of the text only, which
    together are far shorter than the text.
    """
    def hit(position: int, rule: Rule, part: Column | None = None) -> Column:
        within = text if part is None else part
        found = F.rlike(within, F.lit(java_pattern(rule)))
        if rule.implies and rule.id in IMPLIED_ASSIGNMENTS:
            found = F.rlike(within, F.lit(to_java(IMPLIED_ASSIGNMENTS[rule.id], "im"))) & found
        if rule.prefilter and part is None:
            found = contains_any(text, rule.prefilter) & found
        elif rule.prefilter:
            # A literal that every match holds is looked for in the part; others count wherever they stand.
            held = contains_any(text, rule.prefilter)
            found = found & held if "i" in rule.flags else contains_any(part, rule.prefilter) & found
        return F.when(found, F.lit(position))

    families: dict[tuple, list[tuple[int, Rule]]] = {}
    for position, rule in enumerate(rules, 1):
        part = PARTS.get(rule.implies) if rule in BUILTIN and rule.id not in WHOLE_TEXT else None
        families.setdefault((rule.implies, part), []).append((position, rule))
    own = F.array(*[hit(*r) for r in families.pop((None, None))]) if (None, None) in families else empty("int")

    def family(key: str, rules_of: list[tuple[int, Rule]], part: Column | None) -> Column:
        hits = F.array(*[hit(*r, part) for r in rules_of])
        if part is None and all(r.prefilter and r in BUILTIN for _, r in rules_of):
            return hits  # their literals cost less than the shape
        return F.when(_implied(text if part is None else part, key), hits).otherwise(empty("int"))

    def known(words: Column, assigned: Column) -> Column:
        part = {None: None, "word": words, "assignment": assigned}
        return F.concat(own, *[family(key, rules_of, part[kind]) for (key, kind), rules_of in families.items()])

    if not families:
        return F.array_compact(own)
    asked = let(_pieces(text), lambda words: let(_assignments(text), lambda assigned: known(words, assigned)))
    return F.array_compact(F.when(look, asked).otherwise(own))


def _rule_table(rules: tuple[Rule, ...]) -> Column:
    rows = [{"id": r.id, "provider": r.provider, "pattern": java_pattern(r), "grp": r.group,
             "entropy_min": r.entropy_min, "confidence": r.confidence,
             "rank": CONFIDENCE_RANK[r.confidence], "validator": r.validator} for r in rules]
    return F.from_json(F.lit(json.dumps(rows)), RULE_LITERAL)


# Marks put around matches: code points that Unicode keeps free of characters.
BEFORE, WITHIN, BEHIND = "\ufdd0", "\ufdd1", "\ufdd2"


def marked_copy(text: Column, pattern: Column, refer: str) -> Column:
    """The text with each match replaced by itself, its secret and marks; ``refer`` names the secret's group, as in ``$1``."""
    return F.regexp_replace(text, pattern, F.lit(f"{BEFORE}$0{WITHIN}{refer}{BEHIND}"))


def located(text: Column, pattern: Column, copy: Column, secret_of) -> Column:
    """All matches as structs (at, whole, secret); ``copy`` is the text's ``marked_copy``.

    The text is matched once, for the copy, and wholes, secrets and gaps are cut from it.  A text that holds a mark
    is matched for each of the three; ``secret_of(text, pattern)`` then picks the secrets.
    """
    def marked(pieces: Column) -> Column:
        found = F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda p: F.struct(
            F.substring_index(p, WITHIN, 1).alias("whole"), F.substring_index(F.substring_index(p, BEHIND, 1), WITHIN, -1).alias("secret"),
            F.length(F.substring_index(p, BEHIND, -1)).alias("gap")))

        def placed(ms: Column) -> Column:
            steps = F.transform(ms, lambda m: F.length(m["whole"]) + m["gap"])
            return let(running(steps, lambda a, b: a + b), lambda ends: F.transform(ms, lambda m, i: F.struct(
                (F.length(F.get(pieces, F.lit(0))) + F.get(ends, i) - F.length(m["whole"]) - m["gap"]).alias("at"),
                m["whole"].alias("whole"), m["secret"].alias("secret"))))
        return let(found, placed)
    held = contains_any(text, (BEFORE, WITHIN, BEHIND))
    return F.when(held, _located_apart(text, pattern, secret_of)).otherwise(let(F.split(copy, BEFORE, -1), marked))


def _located_apart(text: Column, pattern: Column, secret_of) -> Column:
    def with_gaps(ctx: Column) -> Column:
        # The running total of gap + match length ends where a match ends.
        steps = F.zip_with(F.slice(ctx["gaps"], F.lit(1), F.size(ctx["whole"])), ctx["whole"],
                           lambda g, w: g + F.length(w))
        return let(running(steps, lambda a, b: a + b), lambda ends: F.transform(
            ctx["whole"], lambda w, i: F.struct(
                (F.get(ends, i) - F.length(w)).alias("at"), w.alias("whole"),
                F.get(ctx["secrets"], i).alias("secret"))))
    parts = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        secret_of(text, pattern).alias("secrets"),
        F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gaps"))
    return let(parts, with_gaps)


def _span(start, secret, rank, ord_, seq, rule_id, provider, confidence, entropy) -> Column:
    return F.struct(
        start.cast("int").alias("start"), (start + F.length(secret)).cast("int").alias("end"),
        rank.cast("int").alias("rank"), ord_.cast("int").alias("ord"), seq.cast("int").alias("seq"),
        rule_id.alias("rule_id"), provider.alias("provider"), secret.alias("match"),
        confidence.alias("confidence"), entropy.alias("entropy"))


def _validated(secret: Column, validator: Column, rules: tuple[Rule, ...]) -> Column:
    used = sorted({r.validator for r in rules if r.validator})
    verdict = F.lit(True)
    for name in used:
        verdict = F.when(validator == name, VALIDATORS[name](secret)).otherwise(verdict)
    return verdict


def spans_of_hits(text: Column, hits: Column, options: ScanOptions) -> Column:
    """Every match of the rules that hit, if it passes its validator and entropy floor."""
    rules = options.rules

    def copy_for(position: Column) -> Column:
        # A literal pattern for each rule: a pattern from the table would be compiled anew whenever the rule changes.
        copy = F.lit(None).cast("string")
        for n, rule in enumerate(rules, 1):
            copy = F.when(position == n, marked_copy(text, F.lit(java_pattern(rule)), f"${rule.group}")) if n == 1 else copy.when(
                position == n, marked_copy(text, F.lit(java_pattern(rule)), f"${rule.group}"))
        return copy

    def spans_of(rule: Column, position: Column) -> Column:
        found = located(text, rule["pattern"], copy_for(position), lambda t, p: F.regexp_extract_all(t, p, rule["grp"]))
        if options.match_limit is not None:
            found = F.slice(found, F.lit(1), F.lit(options.match_limit))
        spans = F.transform(found, lambda m, i: _span(
            # The secret sits at its first occurrence inside the match.
            m["at"] + F.position(m["secret"], m["whole"]) - 1, m["secret"], rule["rank"], position, i,
            rule["id"], rule["provider"], rule["confidence"], entropy_of(m["secret"])))
        return F.filter(spans, lambda s: (F.length(s["match"]) > 0)
                        & _validated(s["match"], rule["validator"], rules)
                        & (s["entropy"] >= F.coalesce(rule["entropy_min"], F.lit(0.0))))

    table = _rule_table(rules)
    return F.when(F.size(hits) == 0, empty(SPAN)).otherwise(F.flatten(F.transform(
        hits, lambda p: let(F.get(table, p - 1), lambda rule: spans_of(rule, p)))))


def rule_spans(text: Column, options: ScanOptions) -> Column:
    """Matches of all rules over a text, overlaps included."""
    return let(rule_hits(text, options.rules, worth_a_look(text)), lambda hits: spans_of_hits(text, hits, options))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def _strongest(cluster: Column) -> Column:
    """Greedy choice: confidence, then length, then rule and match order; result by start."""
    order = F.array_sort(F.transform(cluster, lambda s: F.struct(
        (-s["rank"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["ord"].alias("c"),
        s["seq"].alias("d"), s.alias("span"))))
    kept = F.aggregate(order, empty(SPAN), lambda acc, o: F.when(
        F.exists(acc, lambda k: _overlaps(o["span"], k)), acc).otherwise(F.array_append(acc, o["span"])))
    return F.array_sort(kept)


def resolve_overlaps(spans: Column) -> Column:
    """Non-overlapping spans in text order.

    The greedy choice is made within runs of touching spans, which cannot influence each other,
    so its pairwise test never runs over all spans of a long text.
    """
    def by_runs(ordered: Column) -> Column:
        n = F.size(ordered)
        reach = running(F.transform(ordered, lambda s: s["end"]), F.greatest)

        def cut(ends: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
                F.get(ordered, i)["start"] >= F.get(ends, i - 1)))
            return let(heads, lambda hs: F.flatten(F.transform(hs, lambda h, k: let(
                F.slice(ordered, h + 1, F.coalesce(F.get(hs, k + 1), n) - h),
                lambda run: F.when(F.size(run) == 1, run).otherwise(_strongest(run))))))
        return let(reach, cut)

    return let(F.array_sort(spans), lambda o: F.when(F.size(o) <= 1, o).otherwise(by_runs(o)))


def entropy_spans(text: Column, covered: Column, options: ScanOptions) -> Column:
    """Random-looking quoted or assigned values that no rule owns."""
    if not options.entropy_enabled:
        return empty(SPAN)
    pattern = F.lit(to_java(ENTROPY_CANDIDATE))

    def values(t: Column, p: Column) -> Column:
        return F.zip_with(F.regexp_extract_all(t, p, F.lit(1)), F.regexp_extract_all(t, p, F.lit(2)),
                          lambda a, b: F.when(F.length(a) > 0, a).otherwise(b))

    def to_spans(taken: Column) -> Column:
        places = F.transform(located(text, pattern, marked_copy(text, pattern, "$1$2"), values), lambda m, i: let(
            (m["at"] + F.position(m["secret"], m["whole"]) - 1).cast("int"), lambda at: F.struct(
                at.alias("start"), (at + F.length(m["secret"])).alias("end"), m["secret"].alias("secret"), i.alias("seq"))))
        # Most candidates are what a rule owns already: entropy, which is dear, is asked of the others only.
        free = F.filter(places, lambda s: ~F.exists(taken, lambda k: _overlaps(s, k)))
        spans = F.transform(free, lambda s: _span(
            s["start"], s["secret"], F.lit(CONFIDENCE_RANK["low"]), F.lit(len(options.rules) + 1), s["seq"], F.lit(ENTROPY_RULE_ID),
            F.lit(ENTROPY_PROVIDER), F.lit("low"), entropy_of(s["secret"])))
        return F.filter(spans, lambda s: (s["entropy"] >= entropy_threshold(s["match"], options.entropy_threshold))
                        & ~is_placeholder_value(s["match"], options.prefix))

    found = F.rlike(text, F.lit(_shape("entropy"))) & F.rlike(text, pattern)
    return F.when(found, to_spans(covered)).otherwise(empty(SPAN))


def detection_stages(text: Column, options: ScanOptions) -> list[tuple[str, Column]]:
    """Named steps from text to spans; each refers to the columns of the steps before it."""
    look, hits, raw, kept, extra = (F.col(c) for c in ("_veil_look", "_veil_hits", "_veil_raw", "_veil_kept", "_veil_extra"))
    return [
        ("_veil_look", worth_a_look(text)),
        ("_veil_hits", rule_hits(text, options.rules, look)),
        ("_veil_raw", spans_of_hits(text, hits, options)),
        ("_veil_kept", F.when(F.size(raw) <= 1, raw).otherwise(resolve_overlaps(raw))),
        ("_veil_extra", F.when(look, entropy_spans(text, kept, options)).otherwise(empty(SPAN))),
        ("_veil_spans", F.when(F.size(extra) == 0, kept).otherwise(F.array_sort(F.concat(kept, extra)))),
    ]


__all__ = ["SPAN", "any_of", "detection_stages", "entropy_spans", "java_pattern", "located",
           "resolve_overlaps", "rule_hits", "rule_spans"]
