"""Decisions, heartbeats, baseline, scoring, remediation, sources, streams, registry."""

import json
import subprocess
import sys
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from conftest import fake
from veilspan.operators import baseline as B, fixplan as X, heartbeat as H, policy as P, reports as R, score as S
from veilspan.operators.scan import findings_table, scan_df
from veilspan.operators.store import VaultStore
from veilspan.options import ScanOptions
from veilspan.sources.files import MAX_BYTES, staged, text_files
from veilspan.streaming import guard as G

AWS = "AKIA" + "4KTNQ7VZL2WXMP3D"
NPM = fake("npm_", 36)


def test_tool_decisions(spark):
    calls = [({"file_path": "a/.env"}, "redact"), ({"path": ".env.example", "content": "x"}, "redact"), ({"cmd": "printenv"}, "block"),
             ({"command": f"curl {AWS}"}, "redact"), ({"note": "short", "other": f"long {AWS}"}, "redact"), ({}, "redact"), ({"content": "fine"}, "redact")]
    df = spark.createDataFrame([(i, m, c) for i, (m, c) in enumerate(calls)], "i int, m map<string,string>, capability string")
    kinds = {}
    for mode in ("block", "warn"):
        rows = P.decide_tools(df, "m", ["i"], F.col("capability"), ScanOptions(mode=mode)).orderBy("i").collect()
        kinds[mode] = [r["decision"]["kind"] for r in rows]
    assert kinds["block"] == ["deny", "allow", "deny", "deny", "deny", "allow", "allow"]
    assert kinds["warn"] == ["deny", "allow", "deny", "ask", "ask", "allow", "allow"]


def test_masking_needs_a_host_that_rewrites(spark):
    from veilspan.operators.vault import empty_vault, key_frame
    df = spark.createDataFrame([(1, f"x {AWS}", "redact"), (2, f"x {AWS}", "partial"), (3, "", "redact")], "i int, text string, capability string")
    out = P.decide_prompts(df, "text", ["i"], F.col("capability"), ScanOptions(), empty_vault(spark), key_frame(spark, b"k"))
    a, b, c = [r["decision"] for r in out.orderBy("i").collect()]
    assert a["kind"] == "modify" and AWS not in a["text"] and "1 credential(s) (aws)" in a["reason"]
    assert b["kind"] == "deny" and b["text"] is None and c["kind"] == "allow"


def test_field_helpers(spark):
    df = spark.createDataFrame([({"text": "t", "command": "c", "z": "zzzzzzzzzz"}, ["a", "b"], "x" * 300)], "m map<string,string>, argv array<string>, long string")
    edits = F.array(F.create_map(F.lit("after"), F.lit("A"), F.lit("text"), F.lit("T")))
    row = df.select(P.tool_text(F.col("m")).alias("t"), P.put_text(F.col("m"), F.lit("new")).alias("p"), P.edit_text(F.lit("c"), edits).alias("e"),
                    P.command_text(F.lit(None).cast("string"), F.col("argv")).alias("c"),
                    P.result_context(F.lit(2), F.array().cast("array<struct<message:string>>")).alias("r")).first()
    assert (row["t"], row["p"]["command"], row["p"]["text"], row["e"], row["c"], row["r"]) == ("c\nt", "new", "t", "c\nT\nA", "a b", "restored 2 value(s)")


def test_host_response(spark):
    cases = [("modify", "prompt", True, True, "deny"), ("modify", "tool", True, True, "modify"), ("modify", "tool", True, False, "ask"),
             ("modify", "tool", False, False, "deny"), ("ask", "tool", False, True, "deny"), ("ask", "tool", True, False, "ask"), ("allow", "tool", False, False, "allow")]
    df = spark.createDataFrame(cases, "k string, e string, asks boolean, rewrites boolean, want string")
    out = df.select(P.host_response(P.decision(F.col("k")), F.col("e"), F.col("asks"), F.col("rewrites"))["kind"].alias("got"), "want").collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]


def test_heartbeats(spark):
    events = spark.sql("SELECT * FROM VALUES ('a', 'x', TIMESTAMP'2024-01-01 00:00:00'), ('a', 'x', TIMESTAMP'2024-01-01 01:00:00'), ('a', '', TIMESTAMP'2024-01-02 00:00:00') AS t(agent, event, at)")
    beats = H.heartbeat(events)
    health = H.agent_health(H.merge_heartbeats(beats, beats)).first()
    assert [(e["event"], e["cnt"]) for e in health["events"]] == [("unknown", 2), ("x", 4)]
    assert H.protected(H.agent_health(beats)).first()[0] and not H.protected(H.agent_health(beats.limit(0))).first()[0]
    assert H.latest_events(beats, 1).first()["event"] == "unknown"


def test_baseline(spark, tmp_path):
    df = spark.createDataFrame([(1, "src/a.py", f"x\n{AWS} {NPM}"), (2, "tests/b.py", AWS), (3, "c.py", NPM)], "i int, path string, text string")
    rows = findings_table(scan_df(df, "text", ScanOptions(), None), ["i", "path"], "text")
    base = B.build_baseline(rows.filter("i < 3").filter(F.col("match") == AWS), "path", "s")
    assert [r["hint"] for r in base.collect()] == ["tests/b.py:1 aws-access-key-id"]
    assert {r["match"] for r in B.new_findings(rows, base, "s", ["i"]).collect()} == {NPM}
    done = B.with_baseline(scan_df(df, "text", ScanOptions(), "path"), base, "s", ["i"]).orderBy("i").collect()
    assert [[f["note"] for f in r["suppressed"]] for r in done] == [["accepted in baseline"], ["accepted in baseline"], []]
    assert done[1]["suppressed"][0]["confidence"] == "high" and done[1]["findings"] == []
    path = tmp_path / "b.json"
    path.write_text('{"version": 1, "salt": "s", "accepted": {"f1": "h1"}}')
    assert [tuple(r) for r in B.load_baseline_json(spark, str(path)).collect()] == [("s", "f1", "h1")]
    path.write_text("{broken")
    assert B.load_baseline_json(spark, str(path)).count() == 0


def test_scores(spark):
    rows = [(["abc", "zzz"], "xabcx", ["abc", "q"]), ([], "abc", []), (["abc"], "abc", ["abc", "abcd"])]
    df = spark.createDataFrame(rows, "hits array<string>, expected string, many array<string>")
    assert [tuple(r) for r in S.positive_counts(df, "hits", "expected").collect()] == [(1, 1, 0), (0, 0, 1), (1, 0, 0)]
    assert [tuple(r) for r in S.mixed_counts(df, "hits", "many").collect()] == [(1, 1, 1), (0, 0, 0), (2, 0, 0)]
    assert S.negative_counts(df, "hits").agg(F.sum("fp")).first()[0] == 3
    empty = S.scores(S.negative_counts(df.limit(0), "hits")).first()
    assert (empty["precision"], empty["recall"], empty["f1"]) == (1.0, 1.0, 1.0)


def test_nearest_rank_is_exact(spark):
    values = [(i * 7919) % 1000 / 10 for i in range(1234)]
    df = spark.createDataFrame([("a" if i % 3 else "b", v) for i, v in enumerate(values)], "g string, v double")
    ordered = sorted(values)
    row = S.nearest_rank(df, "v", [0.5, 0.99]).first()
    assert (row["p50"], row["p99"]) == (ordered[617], ordered[int(1234 * 0.99)])
    for r in S.nearest_rank(df, "v", [0.5], ["g"]).collect():
        part = sorted(v for i, v in enumerate(values) if ("a" if i % 3 else "b") == r["g"])
        assert r["p50"] == part[len(part) // 2]


def test_score_deltas_and_gates(spark):
    now = spark.createDataFrame([("precision", 0.97), ("recall", 0.95), ("p99_ms", 60.0), ("other", 1.0)], "metric string, value double")
    assert {r["metric"]: r["passed"] for r in S.gates(now).collect()} == {"precision": False, "recall": True, "p99_ms": False}
    assert S.score_deltas(now, now).agg(F.sum("delta")).first()[0] == 0


def test_reports(spark):
    files = spark.createDataFrame([("a/.env", 2), ("b/.env", 1), ("c/.env", 1), (".env.example", 3), ("d.py", 4)], "path string, credentials int")
    ignored = spark.createDataFrame([("a/.env",)], "path string")
    out = {r["path"]: r["status"] for r in R.store_exposure(files, ignored, F.col("path") != "c/.env").collect()}
    assert out == {"a/.env": "ignored", "b/.env": "exposed", "c/.env": "no-repo"}
    assert R.has_findings(files) and not R.has_findings(files.limit(0))


SOURCE = {
    "a.ts": 'const apiKey = "{0}";\nconst u = "postgres://svc:{1}@h/d";\n',
    "b.py": "api_key = '{2}'\nx = '{0}'\n",
    "c.go": "apiKey := `{3} ${{x}}`\nplain {4}\n",
    "d.txt": "token = \"{0}\"\n",
}
S5 = [fake("npm_", 36), fake("Zq", 18), fake("hf_", 34), fake("gsk_", 52), fake("ghp_", 36)]


def test_fix_plan(spark):
    df = spark.createDataFrame([(p, t.format(*S5)) for p, t in SOURCE.items()], "path string, text string")
    env = X.parse_env(spark.createDataFrame([(".env", "export API_KEY='old'\nEMPTY=\nbad line")], "path string, text string"))
    assert sorted(r["name"] for r in env.collect()) == ["API_KEY", "EMPTY"]
    plan = X.plan_fixes(df, env)
    edits = {(r["path"], r["line"]): (r["name"], r["replacement"]) for r in plan["edits"].collect()}
    assert edits == {("a.ts", 1): ("API_KEY_2", "process.env.API_KEY_2"), ("a.ts", 2): ("U", "process.env.U"),
                     ("b.py", 1): ("API_KEY_3", 'os.environ["API_KEY_3"]'), ("b.py", 2): ("API_KEY_2", 'os.environ["API_KEY_2"]')}
    assert {(r["path"], r["reason"]) for r in plan["manual"].collect()} == {("c.go", X.INTERPOLATED), ("c.go", X.NO_LITERAL)}
    assert [(r["path"], r["reason"]) for r in plan["skipped"].collect()] == [("d.txt", X.UNSUPPORTED)]
    files = {r["path"]: r["updated"] for r in plan["files"].collect()}
    assert files["a.ts"] == "const apiKey = process.env.API_KEY_2;\nconst u = process.env.U;\n"
    assert files["d.txt"] == SOURCE["d.txt"].format(*S5)
    lines = {r["env_line"] for r in X.env_additions(plan["added"], env).collect()}
    assert f"API_KEY_2={S5[0]}" in lines and len(lines) == 3


def test_names_equal_one_by_one_naming(spark):
    bases = ["KEY", "KEY", "KEY_2", "KEY", "A", "KEY_2", "KEY_2_2", "KEY", "A", "KEY_3"] * 4
    taken = ["KEY", "KEY_4", "A_2", "A_99999999999999999999"]
    want, seen = {}, set(taken)
    for i, base in enumerate(bases):
        name, n = base, 2
        while name in seen:
            name, n = f"{base}_{n}", n + 1
        seen.add(name)
        want[f"v{i:02d}"] = name
    values = spark.createDataFrame([(f"v{i:02d}", b, i) for i, b in enumerate(bases)], "value string, base string, first_seen int")
    env = spark.createDataFrame([(t, "x") for t in taken], "name string, value string")
    assert {r["value"]: r["name"] for r in X.allocate_names(values, env).collect()} == want


def test_enclosing_literals(spark):
    cases = [('a = "x KEY y"', ('"', 'x KEY y')), (r'a = "q\" KEY"', ('"', r'q\" KEY')), ("b = 'KEY'", ("'", "KEY")), ("`KEY`", ("`", "KEY")),
             ('KEY "x"', None), ('"a" KEY "b"', None), ("'\"KEY\"'", ('"', "KEY")), ('"KEY', None)]
    df = spark.createDataFrame([(i, "first\n" + t + "\nlast") for i, (t, _) in enumerate(cases)], "i int, t string")
    df = df.withColumn("at", F.instr("t", "KEY") - 1).withColumn("l", X.enclosing_literal(F.col("t"), F.col("at")))
    for (line, want), r in zip(cases, df.orderBy("i").collect()):
        got = r["l"] and (r["l"]["quote"], r["t"][r["l"]["start"] + 1:r["l"]["end"] - 1])
        assert got == want, line


def test_file_source(spark, tmp_path):
    root = tmp_path / "build"  # a skipped name above the root does not matter
    for name, data in {"a.py": AWS.encode(), "x/node_modules/b.py": b"no", "bin": b"a\0b", "bad.txt": b"ok \xff", ".git/c": b"no", "big": b"x" * (2 * 1024 * 1024 + 1)}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    assert text_files(spark, str(root)).filter(F.endswith("path", F.lit("big"))).count() == 1  # no limit by default
    files = text_files(spark, str(root), MAX_BYTES)
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.collect()}
    assert got == {"a.py": AWS, "bad.txt": "ok �"}
    manifest = files.select("path", F.when(F.col("path").endswith("a.py"), "M").otherwise("D").alias("status"))
    assert staged(files, manifest).count() == 1


def test_stream_equals_batch_and_survives_a_repeat(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, f"a {AWS}"), (2, "b")], "i int, text string").write.parquet(str(source))
    stream = spark.readStream.schema("i int, text string").parquet(str(source))
    args = (["i"], str(tmp_path / "vault"), b"k" * 32, str(tmp_path / "out"))
    G.redact_stream(stream, "text", *args, str(tmp_path / "c1")).awaitTermination()
    first = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("i", "text").collect())
    G.redact_stream(stream, "text", *args, str(tmp_path / "c2")).awaitTermination()  # the same batch again
    again = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("i", "text").collect())
    assert first == again and AWS not in str(first) and VaultStore(spark, str(tmp_path / "vault")).load().count() == 1


@pytest.mark.parametrize("name", ["doc_scan_summary", "labelled_findings", "suppression_ladder", "redacted_documents", "rehydrate_warnings",
                                  "prompt_decisions", "env_names", "stream_heartbeat"])
def test_registered_queries_agree_with_their_twins(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted((tuple(map(str, r)) for r in cursor.fetchall()))
    df = entry_module.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_event_routing(spark):
    names = ["UserPromptSubmit", "PreToolUse", "PostToolUse", "afterFileEdit", "pre_run_command", "beforeReadFile", "SessionStart", ""]
    kinds = spark.createDataFrame([(n,) for n in names], "e string").select(P.event_kind(F.col("e")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["prompt", "tool", "result", "result", "shell", "read", "other", "other"]


def test_events_are_decided_by_their_kind(spark):
    from veilspan.sources.messages import parse_events
    from veilspan.streaming.guard import tool_decisions
    events = [({"event": "SessionStart", "prompt": f"x {AWS}"}, "allow"), ({"event": "UserPromptSubmit", "prompt": f"x {AWS}"}, "deny"),
              ({"event": "UserPromptSubmit", "prompt": "cat", "tool_input": {"file_path": ".env"}}, "allow"),
              ({"event": "beforeShellExecution", "command": ["curl", AWS]}, "deny"), ({"event": "pre_run_command", "command": "printenv"}, "deny"),
              ({"event": "pre_run_command", "command": "ls"}, "allow"), ({"event": "beforeReadFile", "file_path": "a/.env"}, "deny"),
              ({"event": "beforeReadFile", "path": "a/b.ts"}, "allow"), ({"event": "PostToolUse", "tool_response": {"a": AWS}}, "allow"),
              ({"event": "BeforeTool", "toolInput": {"content": AWS}}, "deny"), ({"event": "PreToolUse"}, "allow")]
    lines = spark.createDataFrame([(i, json.dumps(e)) for i, (e, _) in enumerate(events)] + [(99, "{broken")], "i int, value string")
    got = tool_decisions(parse_events(lines), ScanOptions(mode="block")).orderBy("i").collect()
    assert [r["decision"]["kind"] for r in got] == [k for _, k in events] + ["allow"]


def test_nothing_is_left_in_the_shared_folder(tmp_path):
    script = f"""
from pyspark.sql import SparkSession
from veilspan.operators.redact import redact_df
from veilspan.operators.vault import empty_vault, key_frame
spark = SparkSession.builder.master('local[2]').config('spark.checkpoint.dir', {str(tmp_path)!r}).config('spark.ui.enabled', 'false').getOrCreate()
df = spark.createDataFrame([(1, 'key {AWS}')], 'id int, text string')
out, added = redact_df(df, 'text', ['id'], empty_vault(spark), key_frame(spark, b'k'))
assert {AWS!r} not in out.first()['redacted']
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=300, cwd=str(Path(__file__).parent.parent))
    left = True  # the JVM ends a little after the script
    for _ in range(60):
        if not (left := [p for p in tmp_path.rglob("*") if p.is_file()]):
            break
        time.sleep(0.5)
    assert not left
