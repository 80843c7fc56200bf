"""Vault, redaction, restoration, files at rest, nested values, messages."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import fake
from veilspan.operators import vault as V
from veilspan.operators.joins import cut_lineage, lookup
from veilspan.operators.lock import lock_files, unlock_files
from veilspan.operators.nested import redact_json, redact_nested
from veilspan.operators.redact import redact_df, rehydrate_df, resembles
from veilspan.options import ScanOptions
from veilspan.sources.messages import guard_messages, parse_events

KEY = b"k" * 32
AWS = "AKIA" + "4KTNQ7VZL2WXMP3D"
NPM = fake("npm_", 36)


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "i int, text string")


def redacted(spark, *values, vault=None, options=ScanOptions()):
    vault = V.empty_vault(spark) if vault is None else vault
    out, added = redact_df(texts(spark, *values), "text", ["i"], vault, V.key_frame(spark, KEY), options)
    return [r["redacted"] for r in out.orderBy("i").collect()], added


def test_names_are_stable_and_readable(spark):
    out, added = redacted(spark, f'a "{AWS}" b {NPM} c {AWS}', f"again {AWS}", "nothing", None)
    names = {r["secret"]: r["placeholder"] for r in added.collect()}
    assert names[AWS].startswith("MASKED_AWS_KEY_") and names[NPM].startswith("MASKED_NPM_TOKEN_")
    assert out == [f'a "{names[AWS]}" b {names[NPM]} c {names[AWS]}', f"again {names[AWS]}", "nothing", None]


def test_first_finding_names_the_secret_and_the_last_in_a_text_comes_first(spark):
    value = fake("", 40)
    text = f'aws_secret_access_key = "{value}"\nauth_token = "{value}"'
    _, added = redacted(spark, text)
    assert added.first()["placeholder"].startswith("MASKED_GENERIC_KEY_")


def test_known_secrets_keep_their_name(spark):
    old = spark.createDataFrame([("MASKED_OLD_KEY_1", AWS, datetime(2024, 1, 1))], V.VAULT)
    out, added = redacted(spark, f"x {AWS}", vault=old)
    assert out == ["x MASKED_OLD_KEY_1"] and added.count() == 0


def greedy(rows, taken, key):
    import hashlib
    import hmac
    taken, out = set(taken), {}
    for secret in rows:
        digest = hmac.new(key, secret.encode(), hashlib.sha256).hexdigest().upper()
        length = 4
        while f"MASKED_P_KEY_{digest[:length]}" in taken:
            length += 2
        out[secret] = f"MASKED_P_KEY_{digest[:length]}"
        taken.add(out[secret])
    return out


def test_collisions_lengthen_like_one_by_one_naming(spark):
    secrets = [f"s{i}" for i in range(3000)]  # about 70 collisions at four digits
    df = spark.createDataFrame([(s, "p", "some-key", i) for i, s in enumerate(secrets)], "secret string, provider string, rule_id string, first_seen int")
    old = spark.createDataFrame([("MASKED_P_KEY_" + "00AB", "gone", datetime(2024, 1, 1))], V.VAULT)
    got = {r["secret"]: r["placeholder"] for r in V.allocate(df, old, V.key_frame(spark, KEY), "MASKED").collect()}
    assert got == greedy(secrets, {"MASKED_P_KEY_00AB"}, KEY)
    assert len(set(got.values())) == 3000 and max(map(len, got.values())) > len("MASKED_P_KEY_0000")


def test_round_trip_and_warnings(spark):
    source = f"k = '{AWS}' and {NPM}\n\nend"
    out, added = redacted(spark, source)
    vault = V.refreshed(V.empty_vault(spark), added, F.current_timestamp())
    name = {r["secret"]: r["placeholder"] for r in added.collect()}[AWS]
    cases = [out[0], f"a {name[:-1]} b", f"a {name}x b", "MASKED_NOBODY_KEY_1234", name.lower(), "MASKED_", f"{name} {name}"]
    rows = rehydrate_df(texts(spark, *cases), "text", ["i"], vault).orderBy("i").collect()
    assert rows[0]["restored"] == source and rows[0]["substituted"] == 2 and rows[0]["warnings"] == []
    kinds = [[w["kind"] for w in r["warnings"]] for r in rows]
    assert kinds == [[], ["mangled"], ["mangled"], ["unknown"], [], ["mangled"], []]
    assert [r["restored"] for r in rows[1:6]] == cases[1:6] and rows[6]["restored"] == f"{AWS} {AWS}"


def test_resemblance_to_an_empty_vault(spark):
    tokens = spark.createDataFrame([("MASKED_A",)], "token string")
    assert resembles(tokens, V.empty_vault(spark)).count() == 0


def test_redacted_text_is_clean(spark):
    out, _ = redacted(spark, f'x = "{AWS}"\npostgres://u:{NPM[4:]}@h/d')
    again, added = redacted(spark, *out)
    assert again == out and added.count() == 0 and AWS not in out[0]


def test_expiry_and_stored_versions(spark, tmp_path):
    now = datetime(2024, 5, 1, 12)
    rows = [("P1", "a", now - timedelta(hours=11)), ("P2", "b", now - timedelta(hours=13)), ("P3", None, now)]
    vault = spark.createDataFrame(rows, V.VAULT)
    assert [r["placeholder"] for r in V.live(vault, F.lit(now)).collect()] == ["P1"]
    path = str(tmp_path / "vault")
    assert V.load_vault(spark, path).count() == 0 and not V.clear_vault(spark, path)
    V.save_vault(vault, path)
    V.save_vault(V.refreshed(V.load_vault(spark, path, F.lit(now)), vault.filter("placeholder = 'P2'"), F.lit(now)), path)
    assert V.vault_status(V.load_vault(spark, path, F.lit(now))).first()["entries"] == 2
    assert V.clear_vault(spark, path) and V.load_vault(spark, path).count() == 0


def test_key_and_secrets_stay_out_of_plans(spark):
    out, added = redact_df(texts(spark, f"x {AWS}"), "text", ["i"], V.empty_vault(spark), V.key_frame(spark, KEY))
    plan = out._jdf.queryExecution().toString() + added._jdf.queryExecution().toString()
    assert AWS not in plan and KEY.decode() not in plan and KEY.hex() not in plan.lower()


def test_lookup_splits_a_hot_key(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    right = left.select("k").distinct().withColumn("v", F.length("k"))
    salted = lookup(left, right, "k", ["id"], small=False)
    assert salted.count() == 2000 and salted.filter("v IS NULL OR v <> length(k)").count() == 0
    hot = salted.filter("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert hot >= 1


def test_checkpoint_folder_is_kept(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    cut_lineage(spark.range(3))
    assert before is None or spark.sparkContext.getCheckpointDir() == before


ENV = f'A=1\nAPI_TOKEN="{NPM}"\n'


def test_lock_and_unlock(spark):
    files = spark.createDataFrame([("a/.env", ENV), ("b/.env", "A=1\n"), ("c/.env", "T=MASKED_X_KEY_1\n")], "path string, text string")
    out, originals, added = lock_files(files, V.empty_vault(spark), V.key_frame(spark, KEY))
    rows = {r["path"]: r for r in out.collect()}
    assert [rows[p]["status"] for p in ("a/.env", "b/.env", "c/.env")] == ["locked", "skipped", "already"]
    assert NPM not in rows["a/.env"]["locked_text"] and originals.count() == 1
    locked = spark.createDataFrame([("a/.env", rows["a/.env"]["locked_text"]), ("b/.env", "A=1\n"), ("c/.env", "T=MASKED_X_KEY_1\n")], "path string, text string")
    vault = V.refreshed(V.empty_vault(spark), added, F.current_timestamp())
    back = {r["path"]: r for r in unlock_files(locked, vault, originals).collect()}
    assert (back["a/.env"]["unlocked_text"], back["a/.env"]["source"], back["a/.env"]["restored"]) == (ENV, "vault", 1)
    assert back["b/.env"]["source"] == "not locked" and back["c/.env"]["source"] == "partial" and back["c/.env"]["notes"]
    lost = {r["path"]: r for r in unlock_files(locked, V.empty_vault(spark), originals).collect()}
    assert (lost["a/.env"]["unlocked_text"], lost["a/.env"]["used_backup"], lost["a/.env"]["restored"]) == (ENV, True, -1)


def test_nested_columns(spark):
    df = spark.createDataFrame([(1, {"a": [AWS, "x"], "m": {"k": f"t {NPM}"}, "n": 3}), (2, None)],
                               "i int, v struct<a:array<string>,m:map<string,string>,n:int>")
    out, _ = redact_nested(df, "v", ["i"], V.empty_vault(spark), V.key_frame(spark, KEY))
    a, b = out.orderBy("i").collect()
    assert a["redactions"] == 2 and a["v"]["a"][0].startswith("MASKED_AWS") and a["v"]["a"][1] == "x" and a["v"]["n"] == 3
    assert a["v"]["m"]["k"].startswith("t MASKED_NPM") and b["v"] is None


def test_json_values(spark):
    deep = AWS
    for _ in range(30):
        deep = [deep]
    rows = [(1, json.dumps({"a": [1, {"b": f"k {AWS}"}], "c": None, "d": True})), (2, "not json"), (3, json.dumps(deep)), (4, '{"x": "y"}'), (5, None)]
    out, _ = redact_json(spark.createDataFrame(rows, "i int, v string"), "v", ["i"], V.empty_vault(spark), V.key_frame(spark, KEY))
    got = {r["i"]: r for r in out.collect()}
    assert json.loads(got[1]["v"])["a"][1]["b"].startswith("k MASKED_AWS") and got[1]["redactions"] == 1
    assert [got[i]["v"] for i in (2, 4, 5)] == ["not json", '{"x": "y"}', None]
    assert got[3]["redactions"] == 1 and AWS not in got[3]["v"]  # no depth is too deep


def test_messages(spark):
    lines = [json.dumps({"jsonrpc": "2.0", "id": 7, "method": "call", "params": {"t": f"k {AWS}"}, "x": [1, "é\"q"]}), "", "broken {",
             json.dumps({"id": 8, "result": {"t": AWS}})]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    key = V.key_frame(spark, KEY)
    asked = {r["i"]: r for r in guard_messages(df, ["i"], "request", V.empty_vault(spark), key)[0].collect()}
    done = json.loads(asked[0]["outgoing"])
    assert done["params"]["t"].startswith("k MASKED_AWS") and done["id"] == 7 and done["x"] == [1, "é\"q"]
    assert set(asked) == {0, 2, 3} and asked[2]["outgoing"] == "broken {" and not asked[2]["parsed"] and asked[3]["outgoing"] == lines[3]
    answered = {r["i"]: r for r in guard_messages(df, ["i"], "response", V.empty_vault(spark), key)[0].collect()}
    assert AWS not in answered[3]["outgoing"] and answered[0]["outgoing"] == lines[0]


def test_text_of_tool_results(spark):
    from veilspan.operators.nested import result_text
    values = ['"a"', '["a", "", 1, ["b"]]', '{"x": "", "y": ["", "c"], "z": 2, "w": {"v": "d"}}', "3", "no", None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", result_text("v").alias("t"))
    assert [r["t"] for r in df.orderBy("i").collect()] == ["a", "a\nb", "\nc\nd", "", "", ""]


def test_event_payload_spellings(spark):
    lines = ['{"hook_event_name":"pre","tool_name":"t","tool_input":{"command":"ls"}}', '{"hookEventName":"post","toolResponse":{"a":["x"]}}', "{"]
    a, b, c = parse_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (a["event"], a["tool_name"], a["tool_input"]) == ("pre", "t", {"command": "ls"})
    assert (b["event"], b["tool_response"]) == ("post", '{"a":["x"]}') and not c["parsed"] and c["event"] == ""


def test_a_vault_key_is_needed_to_mask(spark):
    from veilspan.operators.policy import guard_outbound
    with pytest.raises(ValueError):
        guard_outbound(texts(spark, "x"), "text", ["i"])


def test_renewal_slides_the_expiry_of_live_entries_only(spark, tmp_path):
    path, start = str(tmp_path / "v"), datetime(2024, 5, 1)
    at = lambda hours: F.lit(start + timedelta(hours=hours))
    V.save_vault(spark.createDataFrame([("P1", "a", start), ("P0", "z", start - timedelta(hours=5))], V.VAULT), path)
    V.extend_vault(V.empty_vault(spark).unionByName(spark.createDataFrame([("P2", "b", start)], V.VAULT)), path, at(8))
    names = lambda hours: sorted(r["placeholder"] for r in V.load_vault(spark, path, at(hours)).collect())
    assert names(9) == ["P1", "P2"]  # P0 had expired before the renewal
    assert names(19) == ["P1", "P2"] and names(21) == []
    V.extend_vault(V.empty_vault(spark), path, at(19))
    assert names(30) == ["P1", "P2"]
