"""Decisions: what to do with a prompt, a tool call or a tool result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import let
from ..functions.predicates import is_sensitive_command, is_sensitive_path
from ..options import ScanOptions
from .nested import result_text
from .redact import redact_scanned, rehydrate_df
from .scan import blocking, scan_df
from .vault import empty_vault

# ---------------------------------------------------------------------------
# Field names of tool calls, and what each known host can do.
# ---------------------------------------------------------------------------

TEXT_FIELDS = ("command", "content", "new_string", "old_string", "prompt", "query", "body", "text", "file_text")
EDIT_FIELDS = ("new_string", "newText", "newString", "text", "content", "after")
PATH_FIELDS = ("file_path", "path", "filePath", "absolute_path")
COMMAND_FIELDS = ("command", "cmd", "script")
REWRITE_FIELDS = ("command", "content", "new_string", "prompt", "text", "file_text", "body")

# The events of the hosts by what they carry; all others are let through.
EVENTS = (
    ("prompt", ("UserPromptSubmit", "beforeSubmitPrompt")),
    ("tool", ("PreToolUse", "BeforeTool", "preToolUse")),
    ("shell", ("beforeShellExecution", "pre_run_command")),
    ("read", ("beforeReadFile", "pre_read_code")),
    ("result", ("PostToolUse", "AfterTool", "afterFileEdit")),
)

# host, capability, supported, asks, takes_rewritten_input
HOSTS = (
    ("claude-code", "redact", True, True, False),
    ("cursor", "redact", True, True, False),
    ("gemini", "redact", True, True, True),
    ("antigravity", "redact", True, True, False),
    ("copilot", "redact", True, False, True),
    ("windsurf", "block", True, False, False),
    ("codex", "partial", True, False, False),
    ("aider", "none", False, False, False),
)
HOSTS_SCHEMA = "agent string, capability string, supported boolean, asks boolean, rewrites boolean"

DECISION = "struct<kind:string,reason:string,text:string>"


def hosts_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HOSTS), HOSTS_SCHEMA)


def decision(kind: str | Column, reason: Column | None = None, text: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
                    (nothing if reason is None else reason).alias("reason"),
                    (nothing if text is None else text).alias("text"))


def describe(findings: Column) -> Column:
    """Findings per provider in order of appearance: ``2x aws, github``."""
    def counted(names: Column) -> Column:
        return F.array_join(F.transform(F.array_distinct(names), lambda p: let(
            F.size(F.filter(names, lambda n: n == p)),
            lambda k: F.when(k > 1, F.concat(k.cast("string"), F.lit("x "), p)).otherwise(p))), ", ")
    return let(F.transform(findings, lambda f: f["provider"]), counted)


def guard_message(serious: Column, options: ScanOptions) -> Column:
    n, who = F.size(serious).cast("string"), describe(serious)
    texts = {
        "warn": F.concat(n, F.lit(" credential(s) detected ("), who, F.lit('); mode is "warn", nothing was changed')),
        "block": F.concat(F.lit("blocked: "), n, F.lit(" credential(s) detected ("), who, F.lit(
            f'); remove them, add "# {options.pragma}:allow" to the line of a false positive, or accept a baseline')),
        "redact": F.concat(F.lit("masked "), n, F.lit(" credential(s) ("), who, F.lit("); values are restored on write")),
    }
    return F.when(F.size(serious) > 0, texts[options.mode])


GUARD_ACTION = {"warn": "allow", "block": "deny", "redact": "modify"}


def guard_outbound(df: DataFrame, text_col: str, keys: list[str], options: ScanOptions = ScanOptions(),
                   vault: DataFrame | None = None, key: DataFrame | None = None,
                   path_col: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Add ``action`` (allow, modify, deny), ``message``, ``serious`` and the ``outgoing`` text.

    In redact mode the second result holds the new vault rows and ``key`` is required.
    """
    scanned = scan_df(df, text_col, options, path_col)
    if options.mode == "redact":
        if key is None:
            raise ValueError("redact mode needs a vault key")
        vault = empty_vault(df.sparkSession) if vault is None else vault
        out, added = redact_scanned(scanned, text_col, keys, vault, key, options, path_col)
        serious = F.col("replacements")
        outgoing = F.col("redacted")
        providers = F.transform(serious, lambda r: F.struct(r["provider"].alias("provider")))
        out = out.withColumn("serious", providers)
    else:
        out, added, outgoing = scanned, None, F.col(text_col)
        out = out.withColumn("serious", F.transform(
            blocking(F.col("findings"), options), lambda f: F.struct(f["provider"].alias("provider"))))
    hit = F.size("serious") > 0
    out = (out.withColumn("action", F.when(hit, GUARD_ACTION[options.mode]).otherwise("allow"))
           .withColumn("message", guard_message(F.col("serious"), options))
           .withColumn("outgoing", outgoing))
    return out.select(*df.columns, "action", "message", "serious", "outgoing"), added


def guard_inbound(df: DataFrame, text_col: str, keys: list[str], vault: DataFrame,
                  options: ScanOptions = ScanOptions()) -> DataFrame:
    """Restore placeholders; texts without any pass through."""
    return rehydrate_df(df, text_col, keys, vault, options)


def from_guard(action: Column, message: Column, text: Column, capability: Column) -> Column:
    """Decision of a guarded text on a host; a host that cannot rewrite gets a refusal."""
    advice = F.concat(message, F.lit("\n\nthis host cannot take rewritten input, so the call was refused; "
                                     "remove the credential or mask the file first"))
    return (F.when(action == "deny", decision("deny", message))
            .when((action == "modify") & (capability == "redact"), decision("modify", message, text))
            .when(action == "modify", decision("deny", advice))
            .when(message.isNotNull(), decision("ask", message))
            .otherwise(decision("allow"))).cast(DECISION)


def first_text(fields: Column, names) -> Column:
    """The first named field that is present and not empty."""
    return F.coalesce(*[F.nullif(fields[n], F.lit("")) for n in names], F.lit(""))


def tool_text(tool_input: Column, longer_than: int = 0) -> Column:
    """Known text fields joined by newlines, otherwise every value longer than ``longer_than`` characters."""
    known = F.array_compact(F.array(*[tool_input[n] for n in TEXT_FIELDS]))
    rest = F.filter(F.map_values(tool_input), lambda v: F.length(v) > longer_than)
    return F.coalesce(let(known, lambda k: F.array_join(F.when(F.size(k) > 0, k).otherwise(rest), "\n")), F.lit(""))


def edit_text(content: Column, edits: Column) -> Column:
    """Text of an edit: the content, then per edit the known fields of its map, or its ``edit`` itself."""
    per_edit = F.flatten(F.transform(edits, lambda e: F.array_compact(F.array(*[e[n] for n in EDIT_FIELDS]))))
    return F.array_join(F.concat(F.array_compact(F.array(content)),
                                 F.coalesce(per_edit, F.array().cast("array<string>"))), "\n")


def command_text(command: Column, argv: Column) -> Column:
    return F.coalesce(command, F.array_join(argv, " "), F.lit(""))


def put_text(tool_input: Column, text: Column, fields=REWRITE_FIELDS) -> Column:
    """Tool input with ``text`` in the first of the free-text fields that is present."""
    target = F.coalesce(*[F.when(tool_input[n].isNotNull(), F.lit(n)) for n in fields])
    return F.when(target.isNull(), tool_input).otherwise(
        F.transform_values(tool_input, lambda k, v: F.when(k == target, text).otherwise(v)))


def sensitive_call(tool_input: Column) -> Column:
    """Refusal for reading a credentials file or printing credentials; NULL otherwise."""
    path, command = first_text(tool_input, PATH_FIELDS), first_text(tool_input, COMMAND_FIELDS)
    return (F.when((path != "") & is_sensitive_path(path), decision("deny", F.concat(
                path, F.lit(" holds credentials; read the names from an example file instead"))))
            .when((command != "") & is_sensitive_command(command), decision("deny", F.concat(
                F.lit("this command would print credentials:\n  "), command)))).cast(DECISION)


def decide_prompts(df: DataFrame, text_col: str, keys: list[str], capability: Column,
                   options: ScanOptions = ScanOptions(), vault=None, key=None) -> DataFrame:
    """Add ``decision`` for prompts; an empty prompt is allowed."""
    guarded, _ = guard_outbound(df, text_col, keys, options, vault, key)
    return guarded.withColumn("decision", from_guard(
        F.col("action"), F.col("message"), F.col("outgoing"), capability)).drop("action", "message", "serious", "outgoing")


def decide_tools(df: DataFrame, input_col: str, keys: list[str], capability: Column,
                 options: ScanOptions = ScanOptions(), vault=None, key=None) -> DataFrame:
    """Add ``decision`` for tool calls (a map of input fields): path, then command, then text."""
    guarded, _ = guard_outbound(df.withColumn("_text", tool_text(F.col(input_col))), "_text", keys, options, vault, key)
    by_text = from_guard(F.col("action"), F.col("message"), F.col("outgoing"), capability)
    return (guarded.withColumn("decision", F.coalesce(sensitive_call(F.col(input_col)), by_text))
            .drop("_text", "action", "message", "serious", "outgoing"))


def result_context(substituted: Column, warnings: Column) -> Column:
    """What is said about a tool result: the warnings, or how many values were restored."""
    return (F.when(F.size(warnings) > 0, F.array_join(F.transform(warnings, lambda w: w["message"]), "\n"))
            .when(substituted > 0, F.concat(F.lit("restored "), substituted.cast("string"), F.lit(" value(s)"))))


def decide_results(df: DataFrame, result_col: str, keys: list[str], vault: DataFrame,
                   options: ScanOptions = ScanOptions(), restored: str | None = None) -> DataFrame:
    """Add ``context`` and ``substituted`` for tool results given as JSON text; ``restored`` names a column for the text itself."""
    done = guard_inbound(df.withColumn("_text", result_text(F.col(result_col))), "_text", keys, vault, options)
    done = done.withColumn("context", result_context(F.col("substituted"), F.col("warnings")))
    done = done.withColumn("_text", F.col("restored")).drop("restored", "warnings")
    return done.drop("_text") if restored is None else done.withColumnRenamed("_text", restored)


def host_response(decided: Column, event_kind: Column, asks: Column, rewrites: Column) -> Column:
    """The decision as the host can express it.

    A prompt cannot be rewritten anywhere, so a masked prompt is a refusal carrying the text.
    A masked tool call is passed on rewritten where the host takes it and asked about where it
    does not; a host without a way to ask refuses.
    """
    kind = (F.when((event_kind == "prompt") & (decided["kind"] == "modify"), "deny")
            .when((decided["kind"] == "modify") & ~rewrites, F.when(asks, "ask").otherwise("deny"))
            .when((decided["kind"] == "ask") & ~asks, "deny")
            .otherwise(decided["kind"]))
    return F.struct(kind.alias("kind"), decided["reason"].alias("reason"), decided["text"].alias("text"))


def event_kind(event: Column, events=EVENTS) -> Column:
    """Route an event name; unknown events are let through."""
    return F.coalesce(*[F.when(event.isin(*names), kind) for kind, names in events], F.lit("other"))


def event_call(kind: Column, tool_input: Column, command: Column, path: Column) -> Column:
    """What a tool, shell or read event is about to do, as fields of a tool call; NULL for other events."""
    return (F.when(kind == "tool", tool_input)
            .when(kind == "shell", F.create_map(F.lit("command"), F.coalesce(command, F.lit(""))))
            .when(kind == "read", F.create_map(F.lit("file_path"), F.coalesce(path, F.lit("")))))
