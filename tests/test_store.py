"""The stored vault: versions, renewals, merging, conflicts, keys."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from veilspan.operators import store as S
from veilspan.operators.redact import redact_df
from veilspan.operators.vault import empty_vault, refreshed
from veilspan.sources.messages import parse_events
from veilspan.streaming import guard as G

from conftest import fake

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)


def entries(spark, *names):
    return spark.createDataFrame([(f"P{n}", f"s{n}") for n in names], "placeholder string, secret string")


def names(frame):
    return sorted(r["placeholder"] for r in frame.collect())


def test_versions_merge_and_stay_few(spark, tmp_path):
    store = S.VaultStore(spark, str(tmp_path / "vault"), segments=3)
    for n in range(14):
        version = store.extend(entries(spark, f"{n:02}"), store.manifest(), NOW)
        assert version.version == n + 1 and len(version.segments) <= 4
    assert names(store.load(NOW)) == [f"P{n:02}" for n in range(14)]
    assert len(store.versions()) == S.KEPT_MANIFESTS and store.file_count() <= 1 + S.KEPT_MANIFESTS * 5
    # An older version that is still kept reads as it was.
    older = S.Manifest(13, "", tuple(S.Segment(**s) for s in json.loads(store._read("manifests/13.json"))["segments"]))
    assert names(store.load(NOW, older)) == [f"P{n:02}" for n in range(13)]


def test_a_renewal_moves_the_expiry_of_what_is_alive(spark, tmp_path):
    store = S.VaultStore(spark, str(tmp_path / "vault"))
    store.extend(entries(spark, 1), store.manifest(), NOW)
    store.extend(entries(spark, 2), store.manifest(), NOW + timedelta(hours=8))
    assert names(store.load(NOW + timedelta(hours=19))) == ["P1", "P2"]  # 1 was renewed at 8
    assert names(store.load(NOW + timedelta(hours=21))) == []
    after = store.extend(entries(spark, 3), store.manifest(), NOW + timedelta(hours=30))
    assert len(after.segments) == 1 and names(store.load(NOW + timedelta(hours=30))) == ["P3"]  # the dead are gone, not revived
    assert store.extend(entries(spark), store.manifest(), NOW + timedelta(hours=31)).segments[0].last == S.micros(NOW + timedelta(hours=31))


def test_merged_entries_keep_their_own_expiry(spark, tmp_path):
    store = S.VaultStore(spark, str(tmp_path / "vault"), segments=1)
    store.extend(entries(spark, 1), store.manifest(), NOW)
    store.extend(entries(spark, 2), store.manifest(), NOW + timedelta(hours=13))  # 1 is dead by then
    store.extend(entries(spark, 3), store.manifest(), NOW + timedelta(hours=14))
    assert names(store.load(NOW + timedelta(hours=14))) == ["P2", "P3"]


def test_of_two_writers_one_loads_again(spark, tmp_path):
    path = str(tmp_path / "vault")
    one, two = S.VaultStore(spark, path), S.VaultStore(spark, path)
    assert one.key == two.key
    version, tries = one.manifest(), []

    def work(vault, key):
        tries.append(names(vault))
        if len(tries) == 1:  # another writer comes in between
            one.extend(entries(spark, "first"), one.manifest())
        return vault, entries(spark, "second")
    _, vault = G.with_vault(two, work)
    assert tries == [[], ["Pfirst"]] and names(vault) == names(one.load()) == ["Pfirst", "Psecond"]
    with pytest.raises(S.VaultConflict):
        one.extend(entries(spark, "late"), version)
    assert names(one.load()) == ["Pfirst", "Psecond"]


def test_the_key_is_kept_and_checked(spark, tmp_path):
    path = str(tmp_path / "vault")
    store = S.VaultStore(spark, path, b"k" * 32)
    assert S.VaultStore(spark, path).key == b"k" * 32 and S.VaultStore(spark, path, b"k" * 32).key == store.key
    with pytest.raises(S.KeyMismatch):
        S.VaultStore(spark, path, b"other")
    assert (tmp_path / "vault" / "key").stat().st_mode & 0o077 == 0
    assert store.key.hex() not in repr(store) and not store.clear() and not (tmp_path / "vault").exists()


def test_names_do_not_change_between_sessions(spark, tmp_path):
    from veilspan.operators.vault import key_frame
    aws = fake("AKIA", 16, "ABCDEFGHIJKLMNPQRSTUVWXYZ234567")
    texts = spark.createDataFrame([(1, f"key {aws}"), (2, "nothing")], "doc_id long, text string")
    told = []
    for session in (spark, spark.newSession()):
        store = S.VaultStore(session, str(tmp_path / "vault"))
        out, _ = G.with_vault(store, lambda vault, key: redact_df(texts, "text", ["doc_id"], vault, key))
        told.append([r["redacted"] for r in out.orderBy("doc_id").collect()])
    assert told[0] == told[1] and aws not in str(told) and store.load().count() == 1
    plain, _ = redact_df(texts, "text", ["doc_id"], refreshed(empty_vault(spark), store.load(), F.current_timestamp()), key_frame(spark, b"unused"))
    assert [r["redacted"] for r in plain.orderBy("doc_id").collect()] == told[0]


def test_events_are_masked_and_results_restored_across_batches(spark, tmp_path):
    aws = fake("AKIA", 16, "ABCDEFGHIJKLMNPQRSTUVWXYZ234567")
    source, out = str(tmp_path / "events"), str(tmp_path / "out")

    def run(batch, rows, host="gemini", key=None):
        lines = [(i, json.dumps(e) if isinstance(e, dict) else e) for i, e in rows]
        spark.createDataFrame(lines, "id long, value string").coalesce(1).write.parquet(f"{source}/{batch}")
        stream = spark.readStream.schema("id long, value string").parquet(f"{source}/*")
        G.event_stream(parse_events(stream), ["id"], F.lit(host), str(tmp_path / "vault"), key, out, str(tmp_path / f"c-{host}")).awaitTermination()
        return {r["id"]: r for r in spark.read.parquet(out).collect()}

    first = run("a", [(1, {"hook_event_name": "PreToolUse", "tool_input": {"content": f"key {aws}"}}), (2, {"event": "UserPromptSubmit", "prompt": f"my {aws}"}),
                      (3, {"event": "PreToolUse", "tool_input": {"file_path": ".env"}}), (4, "broken {"), (5, {"event": "SessionStart", "prompt": aws}),
                      (6, {"event": "PreToolUse", "tool_input": {"content": "plain"}}), (7, {"event": "PostToolUse", "tool_response": None})])
    token = first[1]["input"]["content"].split()[1]
    assert first[1]["decision"]["kind"] == "modify" and token.startswith("MASKED_AWS_") and first[2]["decision"]["kind"] == "deny" and token in first[2]["decision"]["text"]
    assert [first[i]["decision"]["kind"] for i in (3, 4, 5, 6, 7)] == ["deny", "allow", "allow", "allow", "allow"] and first[6]["input"] is None and first[7]["substituted"] == 0
    later = run("b", [(10, {"event": "PostToolUse", "tool_response": {"out": [f"see {token}", {"x": token}]}}), (11, {"event": "PostToolUse", "tool_response": f"cut {token[:-1]}"}),
                      (12, {"event": "PreToolUse", "tool_input": {"content": f"again {aws}"}})])
    assert later[10]["text"] == f"see {aws}\n{aws}" and later[10]["substituted"] == 2 and later[10]["context"] == "restored 2 value(s)"
    assert "resembles" in later[11]["context"] and later[12]["input"]["content"] == f"again {token}"
    # A host that takes no rewritten input refuses.
    refused = run("c", [(20, {"event": "PreToolUse", "tool_input": {"content": f"key {aws}"}})], "windsurf")
    assert refused[20]["decision"]["kind"] == "deny" and refused[20]["input"] is None
