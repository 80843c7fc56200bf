"""Line-delimited JSON messages and tool events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strict_json
from ..operators.nested import json_leaves, redact_json
from ..operators.policy import PATH_FIELDS, command_text
from ..options import ScanOptions

EVENT_NAMES = ("hook_event_name", "hookEventName", "event")
TOOL_NAMES = ("tool_name", "toolName", "tool")
INPUT_NAMES = ("tool_input", "toolInput", "input", "arguments")
RESPONSE_NAMES = ("tool_response", "toolResponse", "tool_output", "output")


def parse_messages(lines: DataFrame, value: str = "value") -> DataFrame:
    """Drop blank lines and tell messages from other lines (``parsed``).

    A message may name a member twice, which the engine's own parser refuses.
    """
    lines = lines.filter(F.trim(F.col(value)) != "").select("*", F.inline(F.array(F.struct(strict_json(F.col(value)).alias("_json")))))
    odd = json_leaves(F.when(F.col("_json").isNull(), F.col(value)))
    parsed = lines.withColumn("parsed", F.col("_json").isNotNull() | odd.isNotNull())
    method = F.coalesce(F.try_variant_get("_json", "$.method", "string"), F.when(F.col("_json").isNull() & F.col("parsed"), F.get_json_object(value, "$.method")))
    return parsed.withColumn("method", method).drop("_json")


def guard_messages(lines: DataFrame, keys: list[str], direction: str, vault: DataFrame, key: DataFrame,
                   options: ScanOptions = ScanOptions(), value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Mask the strings of ``params`` (direction "request") or ``result`` ("response").

    Adds ``outgoing`` and ``redactions``.  A message without credentials goes out as it came.  A line that
    is no message is masked as a text: what its reader would make of it is unknown.
    """
    part = {"request": "params", "response": "result"}[direction]
    messages = parse_messages(lines, value).withColumn("_message", F.col(value))
    masked, added = redact_json(messages, "_message", keys, vault, key, options, part, plain=True)
    out = masked.withColumn("outgoing", F.coalesce("_message", value))
    return out.select(*lines.columns, "method", "parsed", "outgoing", "redactions"), added


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Tool events with their snake, camel and host-specific field names; malformed ones are kept."""
    # One generated column, so that each line is parsed once.
    lines = lines.select("*", F.inline(F.array(F.struct(strict_json(F.col(value)).alias("_json")))))
    v = F.col("_json")

    def text(*names: str) -> Column:
        return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])

    def raw(*names: str) -> Column:
        return F.when(v.isNotNull(), F.coalesce(*[F.get_json_object(value, f"$.{n}") for n in names]))
    return lines.select(
        *[c for c in lines.columns if c != "_json"], v.isNotNull().alias("parsed"), F.coalesce(text(*EVENT_NAMES), F.lit("")).alias("event"),
        text("prompt").alias("prompt"), F.coalesce(text(*TOOL_NAMES), F.lit("")).alias("tool_name"),
        F.from_json(raw(*INPUT_NAMES), "map<string,string>").alias("tool_input"),
        # As JSON, so that a text that is the whole response keeps its quotes.
        F.coalesce(*[F.nullif(F.to_json(F.try_variant_get(v, f"$.{n}", "variant")), F.lit("null")) for n in RESPONSE_NAMES]).alias("tool_response"),
        text("cwd").alias("cwd"),
        # A command comes as text or as the list of its words.
        command_text(text("command"), F.from_json(raw("command"), "array<string>")).alias("command"),
        text(*PATH_FIELDS).alias("path"))
