"""Replace credentials by placeholders and put them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import empty, let
from ..functions.predicates import has_placeholders
from ..functions.text import hmac_sha256_hex
from ..options import ScanOptions
from .detect import located, marked_copy
from .joins import attach, cut_lineage, is_small, lookup, settled
from .prefixes import near_names
from .scan import blocking, scan_df
from .vault import FIRST_LENGTH, INNER, OUTER, allocate, stem, with_pads

REPLACEMENT = "struct<start:int,end:int,value:string,rule_id:string,provider:string>"
WARNING = "struct<kind:string,token:string,message:string>"


# Name of the column that tells rows apart while spans are away from their texts.
ROW = "_veil_row"


def row_identity(text: Column, path: Column | None = None) -> Column:
    """What a row's findings depend on, as a digest: its text, and its path where paths count.

    Rows that share it have the same replacements.  So a row without a key, or one of several
    with the same key, gets its own replacements and never those of another text.
    """
    return F.md5(F.concat(F.coalesce(F.md5(text.cast("binary")), F.lit("-")), F.lit("") if path is None else F.coalesce(F.md5(path.cast("binary")), F.lit("-"))))


def attach_to_hits(df: DataFrame, extra: DataFrame, identity: Column, may_hit: Column) -> DataFrame:
    """Left join extras by row identity.  Texts that cannot hit take no part, so that only the others ever move."""
    if is_small(extra):
        return attach(df.withColumn(ROW, identity), extra, [ROW]).drop(ROW)
    possible = F.coalesce(may_hit, F.lit(False))
    moved = attach(df.filter(possible).withColumn(ROW, identity), extra, [ROW]).drop(ROW)
    return moved.unionByName(df.filter(~possible), allowMissingColumns=True)


def splice(text: Column, replacements: Column) -> Column:
    """Text with each span [start, end) replaced by ``value``; spans are in order and apart."""
    def pieces(reps: Column) -> Column:
        def piece(r: Column, i: Column) -> Column:
            begin = F.coalesce(F.get(reps, i - 1)["end"], F.lit(0))
            return F.concat(F.substring(text, begin + 1, r["start"] - begin), r["value"])
        tail = F.substring(text, F.element_at(reps, -1)["end"] + 1, F.length(text))
        return F.when(F.size(reps) == 0, text).otherwise(
            F.concat(F.array_join(F.transform(reps, piece), ""), tail))
    return let(replacements, pieces)


def blocking_spans(scanned: DataFrame, keys: list[str], options: ScanOptions) -> DataFrame:
    return scanned.select(*keys, F.explode(blocking(F.col("findings"), options)).alias("f")).select(*keys, "f.*")


def first_sightings(spans: DataFrame, keys: list[str]) -> DataFrame:
    """One row per secret, named by its first finding: row order, then last in the text first."""
    seen = F.struct(*[F.col(k) for k in keys], (-F.col("start")).alias("back"))
    return (spans.withColumnRenamed("match", "secret").groupBy("secret")
            .agg(F.min_by(F.struct("provider", "rule_id"), seen).alias("by"), F.min(seen).alias("first_seen"),
                 F.collect_set(F.struct("provider", "rule_id")).alias("found_by"))
            .select("secret", "by.provider", "by.rule_id", "first_seen", "found_by"))


def usual_lengths(names: DataFrame) -> dict[str, int]:
    """The commonest suffix length of each stem: the number of stems is bounded by that of rules."""
    suffix = F.substring_index("placeholder", "_", -1)
    words = F.substring("placeholder", F.lit(1), F.length("placeholder") - F.length(suffix) - 1)
    stems = names.groupBy(words.alias("stem"), F.length(suffix).alias("n")).count()
    best = stems.groupBy("stem").agg(F.max_by("n", F.struct("count", -F.col("n"))).alias("n")).where(F.col("n") != FIRST_LENGTH).collect()
    return {r["stem"]: r["n"] for r in best}


def usual_name(finding: Column, inner_pad: Column, outer_pad: Column, lengths: dict[str, int], prefix: str) -> Column:
    """The placeholder that a finding has unless it is an exception, from the row alone."""
    words = stem(finding["provider"], finding["rule_id"], prefix)
    n = F.lit(FIRST_LENGTH)
    for name, length in sorted(lengths.items()):
        n = F.when(words == name, length).otherwise(n)
    return F.concat(words, F.lit("_"), F.substring(hmac_sha256_hex(finding["match"], inner_pad, outer_pad), F.lit(1), n))


def exceptions_of(sightings: DataFrame, names: DataFrame, key: DataFrame, lengths: dict[str, int], prefix: str) -> DataFrame:
    """(secret, placeholder) of the secrets that a finding would call otherwise: collisions, old names, names by another rule."""
    known = sightings.select("secret", "found_by").join(names.select("secret", "placeholder"), "secret")  # a secret is one row on both sides
    each = with_pads(known.select("secret", "placeholder", F.explode("found_by").alias("f")), key)
    finding = F.struct(F.col("f.provider").alias("provider"), F.col("f.rule_id").alias("rule_id"), F.col("secret").alias("match"))
    return each.where(usual_name(finding, F.col(INNER), F.col(OUTER), lengths, prefix) != F.col("placeholder")).select("secret", "placeholder").distinct()


def redact_scanned(scanned: DataFrame, text_col: str, keys: list[str], vault: DataFrame, key: DataFrame, options: ScanOptions,
                   path_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Splice placeholders over the blocking findings of a scanned frame; returns the frame and the new vault rows.

    The scanned rows are written aside once.  Then the secrets are collected, pre-aggregated, and named, and each row
    computes the names of its own findings.  Only secrets that are called otherwise, an exception each, are looked up; rows
    without one take no part in that, and texts without findings never move.
    """
    scanned = settled(scanned)
    sightings = cut_lineage(first_sightings(blocking_spans(scanned, keys, options), keys))
    added = cut_lineage(allocate(sightings.drop("found_by"), vault, key, options.prefix))
    names = vault.select("secret", "placeholder").unionByName(added.select("secret", "placeholder"))
    lengths = usual_lengths(names)
    odd = cut_lineage(exceptions_of(sightings, names, key, lengths, options.prefix))
    serious = F.transform(blocking(F.col("findings"), options), lambda f: F.struct(
        f["start"].alias("start"), f["end"].alias("end"), usual_name(f, F.col(INNER), F.col(OUTER), lengths, options.prefix).alias("value"),
        f["rule_id"].alias("rule_id"), f["provider"].alias("provider"), f["match"].alias("match")))
    # A generated column: names are computed once, however often they are referred to.
    out = with_pads(scanned, key).select(*[F.col(f"`{c}`") for c in scanned.columns], F.inline(F.array(F.struct(serious.alias("_serious")))))
    plain = F.transform("_serious", lambda r: r.dropFields("match"))
    if odd.isEmpty():
        out = out.withColumn("replacements", plain)
    else:
        identity = row_identity(F.col(text_col), None if path_col is None else F.col(path_col))
        found = out.where(F.size("_serious") > 0).select(identity.alias(ROW), F.explode("_serious").alias("s")).select(ROW, F.col("s.start").alias("start"), F.col("s.match").alias("secret"))
        changed = lookup(found, odd, "secret", [ROW, "start"], "inner").select(ROW, "start", "placeholder").distinct()
        per_row = cut_lineage(changed.groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("start", "placeholder"))).alias("_odd")))
        out = attach_to_hits(out, per_row, identity, F.size("_serious") > 0)
        named = F.transform("_serious", lambda r: r.dropFields("match").withField("value", F.coalesce(F.try_element_at("_odd", r["start"]), r["value"])))
        out = out.withColumn("replacements", F.when(F.col("_odd").isNull(), plain).otherwise(named)).drop("_odd")
    return (out.withColumn("replacements", F.when(F.size("replacements") > 0, F.col("replacements")).otherwise(empty(REPLACEMENT)))
            .withColumn("redacted", splice(F.col(text_col), F.col("replacements"))).drop("_serious")), added


def redact_df(df: DataFrame, text_col: str, keys: list[str], vault: DataFrame, key: DataFrame,
              options: ScanOptions = ScanOptions(), path_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Add ``redacted`` and ``replacements``; ``keys`` fix the naming order and may be null or repeated.

    The texts are scanned once, in a narrow stage, and written aside with their findings: a second scan costs far more. A
    text is shuffled only if it holds a secret with an exceptional name.
    """
    scanned = scan_df(df, text_col, options, path_col).drop("suppressed")
    out, added = redact_scanned(scanned, text_col, keys, vault, key, options, path_col)
    return out.drop("findings"), added


# --- restoring ---------------------------------------------------------------------------

def placeholder_tokens(df: DataFrame, text_col: str, keys: list[str], options: ScanOptions) -> DataFrame:
    """Every placeholder-shaped token: keys, start, end, token."""
    text = F.col(text_col)
    pattern = F.lit(f"{options.prefix}_[A-Za-z0-9_]*")
    found = located(text, pattern, marked_copy(text, pattern, "$0"), lambda t, p: F.regexp_extract_all(t, p, F.lit(0)))
    return (df.filter(has_placeholders(text, options.prefix))
            .select(*keys, F.explode(found).alias("m"))
            .select(*keys, F.col("m.at").alias("start"), (F.col("m.at") + F.length("m.whole")).alias("end"),
                    F.col("m.whole").alias("token")))


def resembles(tokens: DataFrame, vault: DataFrame) -> DataFrame:
    """The distinct tokens that extend, or are the beginning of, an issued placeholder."""
    return near_names(tokens.select(F.col("token").alias("text")), vault.select(F.col("placeholder").alias("name"))).select(F.col("text").alias("token"))


def classified_tokens(tokens: DataFrame, vault: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``secret`` and ``kind``: exact, mangled or unknown."""
    known = vault.select(F.col("placeholder").alias("token"), "secret")
    joined = lookup(tokens, known, "token", [*keys, "start"])
    near = resembles(joined.filter(F.col("secret").isNull()), vault).withColumn("near", F.lit(True))
    return (lookup(joined, near, "token", [*keys, "start"])
            .withColumn("kind", F.when(F.col("secret").isNotNull(), "exact")
                        .when(F.col("near"), "mangled").otherwise("unknown")).drop("near"))


def warning_message(kind: Column, token: Column) -> Column:
    return F.when(kind == "mangled", F.format_string(
        '"%s" resembles an issued placeholder but matches none exactly; it was left as it is, check the edit', token)
    ).otherwise(F.format_string('"%s" is not a placeholder issued here; nothing was substituted', token))


def rehydrate_df(df: DataFrame, text_col: str, keys: list[str], vault: DataFrame,
                 options: ScanOptions = ScanOptions()) -> DataFrame:
    """Add ``restored``, ``substituted`` and ``warnings``.

    Only exact placeholders are replaced; anything else that looks like one is reported.  ``keys``
    need not be unique or present: replacements go by what a row holds.
    """
    marked = df.withColumn(ROW, row_identity(F.col(text_col)))
    tokens = cut_lineage(placeholder_tokens(marked, text_col, [ROW], options).distinct())
    kinds = classified_tokens(tokens, vault, [ROW])
    per_row = kinds.groupBy(ROW).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "token", "secret", "kind"))).alias("_tokens"))
    exact = F.transform(F.filter("_tokens", lambda t: t["kind"] == "exact"), lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["secret"].alias("value"), F.lit("").alias("rule_id"), F.lit("").alias("provider")))
    doubtful = F.transform(F.filter("_tokens", lambda t: t["kind"] != "exact"), lambda t: F.struct(
        t["kind"].alias("kind"), t["token"].alias("token"), warning_message(t["kind"], t["token"]).alias("message")))
    out = attach_to_hits(df, per_row, row_identity(F.col(text_col)), has_placeholders(F.col(text_col), options.prefix)).withColumn("_exact", F.coalesce(exact, empty(REPLACEMENT)))
    return (out.withColumn("restored", splice(F.col(text_col), F.col("_exact")))
            .withColumn("substituted", F.size("_exact"))
            .withColumn("warnings", F.coalesce(doubtful, empty(WARNING)))
            .drop("_tokens", "_exact"))


__all__ = ["ROW", "attach_to_hits", "blocking_spans", "classified_tokens", "first_sightings", "placeholder_tokens", "redact_df",
           "redact_scanned", "rehydrate_df", "resembles", "row_identity", "splice"]
