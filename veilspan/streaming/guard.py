"""Streams of texts and events: the batch operators, fed incrementally."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.heartbeat import heartbeat
from ..operators.joins import cut_lineage
from ..operators.policy import (DECISION, decide_results, decision, event_call, event_kind, from_guard, guard_message, guard_outbound,
                                host_response, hosts_df, put_text, sensitive_call, tool_text)
from ..operators.redact import redact_df
from ..operators.scan import blocking, scan_df
from ..operators.store import VaultConflict, VaultStore
from ..operators.vault import key_frame
from ..options import ScanOptions


def started(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str,
            mode: str = "append", once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()


def with_vault(store: VaultStore, work: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], attempts: int = 5) -> tuple[DataFrame, DataFrame]:
    """``work(vault, key)`` on the newest version of a stored vault, and what it adds committed; again if another writer was first.

    ``work`` returns its result and the new vault rows.  The vault comes back too, with those rows.  It is committed before
    the result is used: what a restart repeats finds its secrets in the vault and gives the same names.
    """
    for attempt in range(attempts):
        version = store.manifest()
        vault = store.load(version=version)
        out, added = work(vault, key_frame(store.spark, store.key))
        try:
            store.extend(added, version)
        except VaultConflict:
            if attempt + 1 == attempts:
                raise
            continue
        return out, vault.select("placeholder", "secret").unionByName(added.select("placeholder", "secret"))
    raise AssertionError


def redact_stream(stream: DataFrame, text_col: str, keys: list[str], vault_path: str, key: bytes | None, out_path: str,
                  checkpoint: str, options: ScanOptions = ScanOptions(), once: bool = True) -> StreamingQuery:
    """Mask texts as they arrive, with one vault for the whole stream, and for all streams that share its path.

    The vault (see ``VaultStore``) is written before the output, and the output folder is named by the batch.  A
    repeated batch finds its secrets in the vault, gives the same names and overwrites itself.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        store = VaultStore(batch.sparkSession, vault_path, key)
        out, _ = with_vault(store, lambda vault, pads: redact_df(batch, text_col, keys, vault, pads, options))
        (out.select(*keys, F.col("redacted").alias(text_col), F.size("replacements").alias("redactions"))
         .write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}"))
    return started(stream, each, checkpoint, once=once)


def event_stream(events: DataFrame, keys: list[str], agent: Column, vault_path: str, key: bytes | None, out_path: str,
                 checkpoint: str, options: ScanOptions = ScanOptions(), once: bool = True) -> StreamingQuery:
    """Parsed events in redact mode: calls are masked on their way out, results restored on their way back.

    Prompts, tool, shell and read events get a ``decision``, as far as the host named by ``agent`` can express it; a
    masked call also comes rewritten in ``input``.  Results get the text with its placeholders restored, how many there were, and
    what is to be said about them.  A placeholder is known as soon as the batch that issued it is committed, and in that batch
    itself; the vault is the state of the stream, with its expiry, and outlives it.  The output holds restored secrets:
    keep it private.  One folder is written for each batch and overwritten when it is repeated.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        store = VaultStore(batch.sparkSession, vault_path, key)
        routed = batch.withColumn("kind", event_kind(F.col("event"))).withColumn("agent", agent)
        routed = routed.withColumn("_call", event_call(F.col("kind"), F.col("tool_input"), F.col("command"), F.col("path")))
        routed = cut_lineage(routed.join(F.broadcast(hosts_df(batch.sparkSession)), "agent", "left"))
        calls = routed.where("kind NOT IN ('result', 'other')").withColumn(
            "_text", F.when(F.col("kind") == "prompt", F.coalesce("prompt", F.lit(""))).otherwise(tool_text(F.col("_call"))))
        guarded, vault = with_vault(store, lambda held, pads: guard_outbound(calls, "_text", keys, options, held, pads))
        by_text = from_guard(F.col("action"), F.col("message"), F.col("outgoing"), F.coalesce("capability", F.lit("none")))
        decided = F.coalesce(sensitive_call(F.col("_call")), by_text)
        spoken = host_response(decided, F.col("kind"), F.coalesce("asks", F.lit(False)), F.coalesce("rewrites", F.lit(False))).cast(DECISION)
        out = guarded.withColumn("decision", spoken).withColumn(
            "input", F.when((F.col("action") == "modify") & (F.col("decision.kind") != "deny"), put_text(F.col("_call"), F.col("outgoing"))))
        results = decide_results(routed.where("kind = 'result'"), "tool_response", keys, vault, options, restored="text")
        columns = [*keys, "kind", "decision", "input", "text", "substituted", "context"]
        allowed = results.unionByName(routed.where("kind = 'other'"), allowMissingColumns=True).withColumn("decision", decision("allow").cast(DECISION))
        (out.unionByName(allowed, allowMissingColumns=True).select(*columns)
         .write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}"))
    return started(events, each, checkpoint, once=once)


def tool_decisions(events: DataFrame, options: ScanOptions) -> DataFrame:
    """Stateless decisions for parsed events in block or warn mode, batch or stream.

    Prompts are judged by their text; tool, shell and read events by path, command and text.  Results (see
    ``event_stream``), unknown and malformed events are allowed; the latter keep their payload, so they can be put aside.
    """
    if options.mode == "redact":
        raise ValueError("masking needs the vault: use event_stream")
    routed = events.withColumn("kind", event_kind(F.col("event")))
    routed = routed.withColumn("_call", event_call(F.col("kind"), F.col("tool_input"), F.col("command"), F.col("path")))
    text = F.when(F.col("kind") == "prompt", F.coalesce("prompt", F.lit(""))).otherwise(tool_text(F.col("_call")))
    scanned = scan_df(routed.withColumn("_text", text), "_text", options)
    serious = blocking(F.col("findings"), options)
    answer = "deny" if options.mode == "block" else "ask"
    by_text = F.when(F.size(serious) > 0, decision(answer, guard_message(serious, options)))
    return (scanned.withColumn("decision", F.coalesce(
                sensitive_call(F.col("_call")), by_text.cast(DECISION), decision("allow").cast(DECISION)))
            .drop("_text", "_call", "findings", "suppressed"))


def dead_letters(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("parsed")).select("value")


def heartbeat_stream(events: DataFrame, out_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Running last sighting and count per (agent, event); changed keys are appended per batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
    return started(heartbeat(events), each, checkpoint, mode="update", once=once)


def current_heartbeats(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest row of each (agent, event) written by the stream."""
    return (spark.read.parquet(out_path).groupBy("agent", "event")
            .agg(F.max_by(F.struct("last_seen", "cnt"), "batch").alias("newest")).select("agent", "event", "newest.*"))


__all__ = ["current_heartbeats", "dead_letters", "event_stream", "heartbeat_stream", "redact_stream", "tool_decisions", "with_vault"]
