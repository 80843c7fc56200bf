"""Chat formatting from event logs.

A log holds the events of conversations; a message is opened, grows by deltas, may be edited and may
be generated anew.  Rows are folded into final messages for each (conversation, message) first, so that a long
conversation is split over its messages; only finished messages are gathered by conversation, in
order, and rendered.  Everything is column expressions; there is no Python in the data path.

A rendered conversation is one value, so its messages do meet in one task.  This is the one place
where a group is gathered, and it holds what the conversation's own row must hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
#: Kinds of events: these set a message's text, "delta" adds to it.
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Control strings lose their form: a backslash enters between < and |, one more for each that is there."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role ends at its line's end and holds no control string; ~ marks what is escaped."""
    return F.replace(F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")), F.lit("|"), F.lit("~2"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("~2"), F.lit("|")), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, seq, role, text) of a log (conv_id, message_id, seq, kind, role, text).

    "message" opens a message, "edit" replaces its text, "regenerate" drops it and begins anew with the
    event's text; each "delta" adds to what the last of these left.  Events of a message go by
    seq, then kind (setting before adding), then role and text; a message stands where its first event
    stands and has the last role given.  Null texts are empty, null kinds are deltas; deltas without an
    opening event make a message too.  Null conversation and message ids are ids of their own.  Other columns are
    ignored; an empty log gives no rows.
    """
    kind = F.when(F.col("kind").isin(*RESETS), 0).otherwise(1)
    rows = events.select("conv_id", "message_id", "seq", kind.alias("step"), "role", F.coalesce("text", F.lit("")).alias("text"))
    own = Window.partitionBy("conv_id", "message_id")
    order = own.orderBy("seq", "step", "role", "text")
    attempt = F.sum(F.when(F.col("step") == 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("attempt", attempt).withColumn("at", F.row_number().over(order))
    last = F.max("attempt").over(own)
    rows = rows.withColumn("part", F.when(F.col("attempt") == last, F.struct("at", "text")))
    return rows.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("seq"), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans) for messages (conv_id, message_id, seq, role, text).

    Messages go by seq, then message_id; nulls first.  loss_spans has an entry for each turn: null, or where the turn begins
    (turn_start) and which code points of ``formatted`` are trained on (start, end), the text of a
    trained role without markup.  Null roles and texts are empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    body = escape(text)
    turn = F.concat(head, body, F.lit(END + "\n"))
    rows = messages.select("conv_id", "seq", "message_id", turn.alias("turn"), F.char_length(head).alias("head"),
                           F.char_length(body).alias("body"), role.isin(*trained).alias("trained"))
    before = Window.partitionBy("conv_id").orderBy("seq", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)))
    start = F.col("begin") + F.col("head")
    span = F.when(F.col("trained"), F.struct(F.col("begin").alias("turn_start"), start.alias("start"), (start + F.col("body")).alias("end")))
    rows = rows.withColumn("span", span)
    turns = F.array_sort(F.collect_list(F.struct("begin", "turn", "span")))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.select("conv_id", F.array_join("turns.turn", "").alias("formatted"), F.col("turns.span").alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """Turns (role, text) read back from the output."""
    chunks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda c: c != "")
    return F.transform(chunks, lambda c: F.struct(
        unescape_role(F.substring_index(c, "\n", 1)).alias("role"),
        unescape(F.substring(c, F.instr(c, F.lit("\n")) + 1, F.char_length(c) - F.instr(c, F.lit("\n")) - len(END) - 1)).alias("text")))


def trained_text(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped, nothing between; each is cut from its own turn."""
    chunks = F.filter(F.split(formatted, r"(?=<\|im_start\|>)"), lambda c: c != "")
    pairs = F.filter(F.arrays_zip(chunks.alias("turn"), loss_spans.alias("span")), lambda p: p["span"].isNotNull())
    return F.array_join(F.transform(pairs, lambda p: unescape(F.substring(
        p["turn"], (p["span"]["start"] - p["span"]["turn_start"] + 1).cast("int"), (p["span"]["end"] - p["span"]["start"]).cast("int")))), "")


def events_of(turns: DataFrame, piece: int = 512) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as the log of a service that streams ``piece`` characters at a time.

    Each row is a message: an opening event without text and its deltas.  Rows of one turn number are messages of
    their own, by role and text, nulls first.
    """
    ties = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.row_number().over(ties))
    pieces = F.floor((F.char_length("text") + piece - 1) / piece).cast("int")
    deltas = F.when(pieces > 0, F.transform(F.sequence(F.lit(1), F.greatest(pieces, F.lit(1))), lambda k: F.struct(
        k.alias("step"), F.lit("delta").alias("kind"), F.substring(F.col("text"), (k - 1) * piece + 1, F.lit(piece)).alias("text"))))
    opened = F.array(F.struct(F.lit(0).alias("step"), F.lit("message").alias("kind"), F.lit("").alias("text")))
    rows = rows.withColumn("event", F.explode(F.concat(opened, F.coalesce(deltas, F.slice(opened, 1, 0)))))
    # turn first, then the row among its equals, then the step within the message
    return rows.select("conv_id", F.struct("turn", "tie").alias("message_id"), F.struct("turn", "tie", "event.step").alias("seq"),
                       "event.kind", "role", "event.text")
