"""Plan the move of hard-coded credentials into environment variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import let
from ..functions.text import line_after, line_before, line_number
from ..options import ScanOptions
from .detect import located, marked_copy
from .joins import attach, cut_lineage, lookup, rank_within
from .redact import REPLACEMENT, ROW, blocking_spans, row_identity, splice
from .scan import scan_df

# ---------------------------------------------------------------------------
# Languages by extension and their lookups of an environment variable.
# ---------------------------------------------------------------------------

LANGUAGES = (
    ("js", r"\.(ts|tsx|js|jsx|mjs|cjs|mts|cts)\z", "process.env.%s"),
    ("python", r"\.py\z", 'os.environ["%s"]'),
    ("ruby", r"\.rb\z", 'ENV["%s"]'),
    ("go", r"\.go\z", 'os.Getenv("%s")'),
    ("php", r"\.php\z", 'getenv("%s")'),
    ("shell", r"\.(sh|bash|zsh)\z", '"$%s"'),
)
QUOTES = ('"', "'", "`")
NO_LITERAL = "not inside a string literal"
INTERPOLATED = "template literal with interpolation"
UNSUPPORTED = "unsupported file type"


def language_of(path: Column) -> Column:
    low = F.lower(path)
    case = F.when(F.rlike(low, F.lit(LANGUAGES[0][1])), LANGUAGES[0][0])
    for name, pattern, _ in LANGUAGES[1:]:
        case = case.when(F.rlike(low, F.lit(pattern)), name)
    return case.otherwise("unknown")


def env_lookup(language: Column, name: Column) -> Column:
    case = F.when(language == LANGUAGES[0][0], F.format_string(LANGUAGES[0][2], name))
    for known, _, template in LANGUAGES[1:]:
        case = case.when(language == known, F.format_string(template, name))
    return case


def enclosing_literal(text: Column, start: Column) -> Column:
    """Bounds (start, end, quote) of the string literal around an offset, looked up on its line."""
    def on_line(parts: Column) -> Column:
        line, at = F.concat(parts["before"], parts["after"]), F.length(parts["before"])
        found = []
        for quote in QUOTES:
            pattern = F.lit(f"{quote}[^\\n]*?(?<!\\\\){quote}")
            spans = located(line, pattern, marked_copy(line, pattern, "$0"), lambda t, p: F.regexp_extract_all(t, p, F.lit(0)))
            around = F.filter(spans, lambda m: (m["at"] < at) & (at < m["at"] + F.length(m["whole"]) - 1))
            found.append(F.transform(F.slice(around, 1, 1), lambda m: F.struct(
                (start - at + m["at"]).cast("int").alias("start"),
                (start - at + m["at"] + F.length(m["whole"])).cast("int").alias("end"),
                F.lit(quote).alias("quote"))))
        return F.get(F.concat(*found), F.lit(0))
    return let(F.struct(line_before(text, start).alias("before"), line_after(text, start).alias("after")), on_line)


def base_name(before: Column, provider: Column, rule_id: Column, prefix: str) -> Column:
    """Variable name from the identifier a literal is assigned to, otherwise from the provider."""
    assigned = F.coalesce(
        F.nullif(F.regexp_extract(before, r"""([A-Za-z_][A-Za-z0-9_]*)\s*[:=]\s*["'`]?\s*\z""", 1), F.lit("")),
        F.nullif(F.regexp_extract(before, r"""["']([A-Za-z_][A-Za-z0-9_]*)["']\s*:\s*\z""", 1), F.lit("")))
    snake = F.regexp_replace(F.regexp_replace(assigned, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_")
    own = F.btrim(F.upper(snake), F.lit("_"))
    kind = F.when(F.contains(rule_id, F.lit("token")), "TOKEN").otherwise("SECRET")
    fallback = F.upper(F.regexp_replace(F.concat_ws("_", provider, kind), "[^A-Za-z0-9]+", "_"))
    return let(F.coalesce(own, fallback), lambda b: F.when(
        (b == "") | F.rlike(b, F.lit(r"\A\d")), F.concat(F.lit(prefix + "_"), b)).otherwise(b))


def parse_env(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (path, ord, name, value) of env files; one pair of outer quotes is dropped."""
    lines = files.select("path", F.posexplode(F.split(text_col, r"\r?\n")).alias("ord", "line"))
    shape = r"\A\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)\z"
    return (lines.filter(F.rlike("line", F.lit(shape)))
            .select("path", "ord", F.regexp_extract("line", shape, 1).alias("name"),
                    F.regexp_replace(F.regexp_extract("line", shape, 2), r"""\A["']|["']\z""", "").alias("value")))


def registry(env: DataFrame) -> DataFrame:
    """First name of each value; every name, also of an empty value, is taken."""
    return (env.filter(F.col("value") != "").groupBy("value")
            .agg(F.min_by("name", F.struct("path", "ord")).alias("name")))


SUFFIX = r"\A(.+)_([2-9]|[1-9]\d+)\z"


def _family(name: str) -> Column:
    """A base without its numeric tails; only bases of one family can meet on a name."""
    return F.regexp_replace(name, r"(?:_(?:[2-9]|[1-9]\d+))+\z", "")


def _numbers_in_use(taken: DataFrame) -> DataFrame:
    """The numbers (base, used) that are taken; 1 stands for the bare base."""
    bare = taken.select(F.col("name").alias("base"), F.lit(1).cast("long").alias("used"))
    # A number beyond a long is never reached.
    tails = taken.filter(F.rlike("name", F.lit(SUFFIX))).select(
        F.regexp_extract("name", SUFFIX, 1).alias("base"), F.regexp_extract("name", SUFFIX, 2).try_cast("long").alias("used"))
    return bare.unionByName(tails.filter("used IS NOT NULL")).distinct()


def _numbered(turns: DataFrame, used: DataFrame) -> DataFrame:
    """``k``, the turn-th number of each base that is not in ``used``.

    The j-th used number u has u - j free ones before it.  With the used numbers put between the
    turns at that place, a turn's rank in its base is its number; no base is gathered.
    """
    gaps = rank_within(used, "base", ["used"], "_nth").select(
        "base", (F.col("used") - F.col("_nth")).alias("_after"), F.lit(1).alias("_used"))
    asked = turns.withColumn("_after", F.col("turn").cast("long")).withColumn("_used", F.lit(0))
    merged = asked.unionByName(gaps, allowMissingColumns=True)
    return rank_within(merged, "base", ["_after", "_used"], "k").filter("_used = 0").drop("_after", "_used")


def allocate_names(values: DataFrame, env: DataFrame) -> DataFrame:
    """Names for new values (value, base, first_seen): ``BASE``, then ``BASE_2``, ``BASE_3`` ...

    All values of a base are numbered at once.  Two bases of a family can meet on a name (``KEY``
    and ``KEY_2``); then only the family's values before the first clash are final and its rest
    goes another round, which gives exactly the names of one-by-one naming.
    """
    taken = env.select("name").distinct()
    pending = cut_lineage(values)
    named = None
    while True:
        turns = rank_within(pending, "base", ["first_seen", "value"], "turn")
        used = _numbers_in_use(taken).join(pending.select("base").distinct(), "base", "left_semi")
        offered = (_numbered(turns, used)
                   .withColumn("name", F.when(F.col("k") == 1, F.col("base")).otherwise(
                       F.concat("base", F.lit("_"), F.col("k").cast("string"))))
                   .withColumn("family", _family("base"))
                   # At most one value per base offers a name, so these groups are small.
                   .withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("first_seen", "value"))))
        offered = cut_lineage(offered.select("value", "base", "first_seen", "family", "name", "place"))
        clashes = offered.filter("place > 1").groupBy("family").agg(F.min("first_seen").alias("clash"))
        final = lookup(offered, clashes, "family", ["value"]).filter("clash IS NULL OR first_seen < clash")
        done = cut_lineage(final.select("value", "name"))
        named = done if named is None else named.unionByName(done)
        rest = pending.join(done.select("value"), "value", "left_anti")
        if rest.isEmpty():
            return named
        taken = cut_lineage(taken.unionByName(done.select("name")))
        pending = cut_lineage(rest)


def plan_fixes(df: DataFrame, env: DataFrame, options: ScanOptions = ScanOptions()) -> dict[str, DataFrame]:
    """Plan for source files (path, text).

    ``edits``: path, line, name, value, replacement.  ``manual``: path, line, reason.
    ``skipped``: path, reason.  ``files``: path, text, updated.  ``names``: value, name.  A path may be missing (such files
    are skipped) or shared by several rows: each file gets the edits of its own text.
    """
    scanned = scan_df(df, "text", options, "path").withColumn(ROW, row_identity(F.col("text"), F.col("path")))
    spans = blocking_spans(scanned.withColumn("language", language_of(F.col("path"))), ["path", "text", "language", ROW], options)
    skipped = (spans.filter(F.col("language") == "unknown").select("path").distinct()
               .withColumn("reason", F.lit(UNSUPPORTED)))
    text = F.col("text")
    placed = (spans.filter(F.col("language") != "unknown")
              .withColumn("literal", enclosing_literal(text, F.col("start")))
              .withColumn("contents", F.substring(text, F.col("literal.start") + 2, F.col("literal.end") - F.col("literal.start") - 2))
              .withColumn("line", line_number(text, F.col("start")))
              .withColumn("base", base_name(line_before(text, F.col("literal.start")), F.col("provider"), F.col("rule_id"), options.prefix))
              .withColumn("reason", F.when(F.col("literal").isNull(), NO_LITERAL)
                          .when((F.col("literal.quote") == "`") & F.contains("contents", F.lit("${")), INTERPOLATED))
              .select("path", ROW, "language", "start", "line", "literal", "contents", "base", "reason"))
    placed = cut_lineage(placed)
    manual = placed.filter(F.col("reason").isNotNull()).select("path", "line", "reason")

    movable = placed.filter(F.col("reason").isNull()).withColumnRenamed("contents", "value")
    # Two findings in one literal (say, two keys in a URL) move with it once.
    seen = F.struct("path", (-F.col("start")).alias("back"))
    values = movable.groupBy("value").agg(F.min_by("base", seen).alias("base"), F.min(seen).alias("first_seen"))
    known = registry(env)
    added = allocate_names(values.join(known, "value", "left_anti"), env)
    names = cut_lineage(known.select("value", "name").unionByName(added))

    edits = (lookup(movable, names, "value", ["path", "start"])
             .withColumn("replacement", env_lookup(F.col("language"), F.col("name"))))
    reps = edits.groupBy(ROW).agg(F.array_sort(F.collect_set(F.struct(
        F.col("literal.start").alias("start"), F.col("literal.end").alias("end"),
        F.col("replacement").alias("value"), F.lit("").alias("rule_id"), F.lit("").alias("provider")))).alias("reps"))
    files = (attach(df.select("path", "text", row_identity(text, F.col("path")).alias(ROW)), reps, [ROW])
             .withColumn("updated", splice(text, F.coalesce("reps", F.array().cast(f"array<{REPLACEMENT}>"))))
             .drop("reps", ROW))
    return {"edits": edits.select("path", "line", "name", "value", "replacement"), "manual": manual,
            "skipped": skipped, "files": files, "names": names, "added": added}


def env_additions(added: DataFrame, env: DataFrame) -> DataFrame:
    """Lines to append to the env file and to its example, without names already defined."""
    new = added.join(env.select("name").distinct(), "name", "left_anti")
    return new.select("name", F.concat("name", F.lit("="), "value").alias("env_line"),
                      F.concat("name", F.lit("=")).alias("example_line"))


__all__ = ["allocate_names", "base_name", "enclosing_literal", "env_additions", "env_lookup", "language_of", "parse_env", "plan_fixes", "registry"]
