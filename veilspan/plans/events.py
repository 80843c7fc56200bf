"""Registered queries: decisions, heartbeats, remediation and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.predicates import SENSITIVE_COMMAND as COMMAND_PATTERN, is_sensitive_command, is_sensitive_path
from ..functions.text import fingerprint, human_age
from ..operators import fixplan as X, heartbeat as H, policy as P
from ..operators.joins import gone_at_end, shared_folder, spread
from ..operators.redact import redact_df
from ..operators.store import VaultStore
from ..operators.vault import empty_vault, key_frame
from ..options import ScanOptions
from ..sources.messages import parse_events
from ..streaming import guard as G
from . import duck
from .detection import SALT, SERIOUS, fp
from .inputs import labelled, labelled_sql, prompts_sql, table, with_prompt_samples
from .masking import KEY, PROMPT_SERIOUS, spliced_sql, vault_sql

REDACT, BLOCK, WARN = (ScanOptions(mode=m) for m in ("redact", "block", "warn"))
AGENTS = "[" + ", ".join(duck.lit(h[0]) for h in P.HOSTS) + "]"
HOSTS_SQL = "hosts(agent, capability, supported, asks, rewrites) AS (VALUES " + ", ".join(
    f"({duck.lit(a)}, {duck.lit(c)}, {s}, {k}, {r})" for a, c, s, k, r in P.HOSTS) + ")"

# Paths and commands of tool calls, chosen by the event.
PATHS = ("src/app.ts", ".env", ".env.local", "conf/.env.example", "keys/id_rsa", "tls/server.pem", "a/secrets.yaml",
         "docs/readme.md", "home/.npmrc", "env.py", "x.key", "credentials", "my.credentials.txt")
COMMANDS = ("ls -la", "cat .env", "env", "printenv", "cat README.md | head", "aws configure list", "docker login reg",
            "tail -f app.log; cat config/credentials", "gcloud auth print-access-token", "set -e", "environment")


def picked(items, index: str, dialect: str) -> str:
    joined = "'" + "\x1f".join(items) + "'"
    if dialect == "spark":
        return f"element_at(split({joined}, chr(31)), CAST({index} % {len(items)} AS INT) + 1)"
    return f"string_split({joined}, chr(31))[CAST({index} % {len(items)} AS INT) + 1]"


def _calls(spark, sf_dir):
    """Tool calls made of the events: a path, a command, or a text with a sample."""
    from ..sources.samples import with_samples
    events = with_samples(spread(table(spark, sf_dir, "events")).withColumn("text", F.lit("run:")), "event_id")
    return events.select(
        "event_id", "user_id", "ts", "event_type", F.expr(picked(PATHS, "event_id", "spark")).alias("path"),
        F.expr(picked(COMMANDS, "(event_id + user_id)", "spark")).alias("command"),
        F.expr(picked([h[0] for h in P.HOSTS], "user_id", "spark")).alias("agent"),
        F.when(F.col("event_type").isin("error", "purchase"), F.col("text")).otherwise(F.lit("run: nothing")).alias("text"))


def _tool_input():
    return (F.when(F.col("event_type") == "view", F.create_map(F.lit("file_path"), F.col("path")))
            .when(F.col("event_type") == "click", F.create_map(F.lit("command"), F.col("command")))
            .otherwise(F.create_map(F.lit("path"), F.lit("src/app.ts"), F.lit("content"), F.col("text"))))


def sensitive_paths(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_id", F.expr(picked(PATHS, "event_id", "spark")).alias("path"))
    return calls.select("event_id", "path", is_sensitive_path(F.col("path")).alias("sensitive"))


def sensitive_commands(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_id", F.expr(picked(COMMANDS, "(event_id + user_id)", "spark")).alias("command"))
    return calls.select("event_id", "command", is_sensitive_command(F.col("command")).alias("sensitive"))


SENSITIVE_PATH = (r"(regexp_matches(path, '(?i)(?:^|/)(?:\.env(?:\.[\w-]+)*|\.npmrc|\.pypirc|\.netrc|credentials|id_rsa|id_ed25519|id_ecdsa|"
                  r"[\w.-]*\.(?:pem|p12|pfx|key)|secrets?\.(?:ya?ml|json|toml))$') AND NOT regexp_matches(path, "
                  r"'(?i)(?:^|/)\.env\.(?:example|sample|template|dist|schema|defaults)[\w.-]*$'))")
SENSITIVE_COMMAND = f"regexp_matches(command, {duck.lit('(?im)' + COMMAND_PATTERN)})"


def tool_decisions(spark, sf_dir):
    """Every tool call in block and in warn mode, as the calling host can express it."""
    calls = _calls(spark, sf_dir).withColumn("tool_input", _tool_input())
    hosts = P.hosts_df(spark)
    out = None
    for options in (BLOCK, WARN):
        one = P.decide_tools(calls.join(F.broadcast(hosts), "agent"), "tool_input", ["event_id"], F.col("capability"), options)
        answer = P.host_response(F.col("decision"), F.lit("tool"), F.col("asks"), F.col("rewrites"))
        one = one.select("event_id", "agent", F.lit(options.mode).alias("mode"), F.col("decision.kind").alias("kind"),
                         answer["kind"].alias("answer"))
        out = one if out is None else out.unionByName(one)
    return out


CALL_TEXT = ("CASE WHEN event_type IN ('error', 'purchase') THEN text ELSE 'run: nothing' END")
TOOL_DECISIONS = f"""WITH {labelled_sql(key='event_id', columns='event_id AS doc_id, user_id, event_type', where_from="(SELECT *, 'run:' AS text FROM events)").replace('docs AS', 'origin AS')},
calls AS (SELECT doc_id, event_type, {picked(PATHS, 'doc_id', 'duckdb')} AS path, {picked(COMMANDS, '(doc_id + user_id)', 'duckdb')} AS command,
  {picked([h[0] for h in P.HOSTS], 'user_id', 'duckdb')} AS agent, {CALL_TEXT} AS body FROM origin),
docs AS (SELECT doc_id, agent, event_type, path, command, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN command ELSE body END AS text FROM calls),
{duck.findings('docs')}, {HOSTS_SQL}, n AS (SELECT doc_id, count(*) AS n FROM findings WHERE serious GROUP BY doc_id),
kinds AS (SELECT d.*, h.asks, m.mode, CASE WHEN event_type = 'view' AND {SENSITIVE_PATH} THEN 'deny' WHEN event_type = 'click' AND {SENSITIVE_COMMAND} THEN 'deny'
  WHEN n IS NULL THEN 'allow' WHEN m.mode = 'block' THEN 'deny' ELSE 'ask' END AS kind
  FROM docs d JOIN hosts h USING (agent) LEFT JOIN n USING (doc_id) CROSS JOIN (VALUES ('block'), ('warn')) m(mode))
SELECT doc_id AS event_id, agent, mode, kind, CASE WHEN kind = 'ask' AND NOT asks THEN 'deny' ELSE kind END AS answer FROM kinds"""


def prompt_decisions(spark, sf_dir):
    """Every prompt in the three modes; the host decides whether masking is possible."""
    turns = (with_prompt_samples(table(spark, sf_dir, "conversations"))
             .withColumn("agent", F.expr(picked([h[0] for h in P.HOSTS], "conv_id", "spark"))).select("row_id", "role", "agent", "text"))
    turns = turns.join(F.broadcast(P.hosts_df(spark)), "agent")
    out = None
    for options in (REDACT, BLOCK, WARN):
        vault, key = (empty_vault(spark), key_frame(spark, KEY)) if options.mode == "redact" else (None, None)
        one = P.decide_prompts(turns, "text", ["row_id"], F.col("capability"), options, vault, key)
        one = one.select("row_id", "role", F.lit(options.mode).alias("mode"), F.col("decision.kind").alias("kind"),
                         F.sha2("decision.text", 256).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


PROMPT_DECISIONS = f"""WITH {PROMPT_SERIOUS}, {vault_sql('row_id')}, {spliced_sql('row_id')}, {HOSTS_SQL},
turns AS (SELECT d.row_id, role, r.n, r.text, capability, m.mode FROM docs d JOIN redacted r USING (row_id)
  JOIN hosts h ON h.agent = {picked([h[0] for h in P.HOSTS], 'conv_id', 'duckdb')} CROSS JOIN (VALUES ('redact'), ('block'), ('warn')) m(mode))
SELECT row_id, role, mode, CASE WHEN n = 0 THEN 'allow' WHEN mode = 'block' THEN 'deny' WHEN mode = 'warn' THEN 'ask'
  WHEN capability = 'redact' THEN 'modify' ELSE 'deny' END AS kind,
  CASE WHEN n > 0 AND mode = 'redact' AND capability = 'redact' THEN sha256(text) END AS text FROM turns"""


def guard_messages_text(spark, sf_dir):
    """The message shown for each blocked prompt."""
    turns = with_prompt_samples(table(spark, sf_dir, "conversations")).select("row_id", "text")
    guarded, _ = P.guard_outbound(turns, "text", ["row_id"], WARN)
    return guarded.select("row_id", "action", "message")


GUARD_TEXT = f"""WITH {PROMPT_SERIOUS}, per AS (SELECT row_id, provider, count(*) AS n, min(start_at) AS first FROM serious GROUP BY 1, 2),
said AS (SELECT row_id, CAST(sum(n) AS BIGINT) || ' credential(s) detected (' || string_agg(CASE WHEN n > 1 THEN n || 'x ' || provider ELSE provider END, ', ' ORDER BY first)
  || '); mode is "warn", nothing was changed' AS message FROM per GROUP BY row_id)
SELECT row_id, 'allow' AS action, message FROM docs LEFT JOIN said USING (row_id)"""


# --- heartbeats --------------------------------------------------------------------------

def _beats(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("agent", F.expr(picked([h[0] for h in P.HOSTS], "(user_id * user_id)", "spark")))
    return H.heartbeat(events, "agent", "event_type", "ts")


BEATS = (f"beats AS (SELECT {picked([h[0] for h in P.HOSTS], '(user_id * user_id)', 'duckdb')} AS agent, event_type AS event, max(ts) AS last_seen, "
         "count(*) AS cnt FROM events GROUP BY 1, 2)")


def agent_heartbeat(spark, sf_dir):
    return H.heartbeat(table(spark, sf_dir, "events").withColumn("agent", F.col("user_id").cast("string")), "agent", "event_type", "ts")


def agent_health(spark, sf_dir):
    health = H.agent_health(_beats(spark, sf_dir))
    return health.select("agent", F.array_join(F.transform("events", lambda e: F.concat(e["event"], F.lit(":"), e["cnt"].cast("string"))), " ").alias("events"), "last_seen")


def latest_events(spark, sf_dir):
    return H.latest_events(_beats(spark, sf_dir)).select("agent", "event", "last_seen", "cnt", "place")


def human_ages(spark, sf_dir):
    """Age of each event against the newest one."""
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return events.select("event_id", human_age(F.col("ts"), now).alias("age"))


AGE = """CASE WHEN s < 60 THEN CAST(CAST(s AS BIGINT) AS VARCHAR) || 's ago' WHEN m < 60 THEN CAST(CAST(m AS BIGINT) AS VARCHAR) || 'm ago'
  WHEN h < 48 THEN CAST(CAST(h AS BIGINT) AS VARCHAR) || 'h ago' ELSE CAST(CAST(floor(h / 24 + 0.5) AS BIGINT) AS VARCHAR) || 'd ago' END"""
AGES = """SELECT *, floor(m / 60 + 0.5) AS h FROM (SELECT *, floor(s / 60 + 0.5) AS m FROM (SELECT *,
  greatest(0, floor((epoch_ms((SELECT max(ts) FROM events)) - epoch_ms(seen_at)) / 1000 + 0.5)) AS s FROM {0}))"""


def agent_status(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    agents = P.hosts_df(spark).withColumn("present", F.col("agent") != "gemini")
    wired = P.hosts_df(spark).filter(F.col("agent").isin("cursor", "codex")).select("agent")
    return H.agent_status(agents, wired, H.agent_health(_beats(spark, sf_dir)), now).select("agent", "capability", "status")


AGENT_STATUS = f"""WITH {BEATS}, {HOSTS_SQL}, seen AS (SELECT agent, max(last_seen) AS seen_at FROM beats GROUP BY agent), aged AS ({AGES.format('seen')})
SELECT agent, capability, CASE WHEN seen_at IS NOT NULL THEN 'firing, last seen ' || {AGE} WHEN agent = 'gemini' THEN 'not installed'
  WHEN agent IN ('cursor', 'codex') THEN 'wired, but has never fired' WHEN supported THEN 'detected, not wired' ELSE 'detected, no adapter yet' END AS status
FROM hosts LEFT JOIN aged USING (agent)"""


# --- remediation -------------------------------------------------------------------------

NAMES = ("apiKey", "dbPassword", "authToken", "API_KEY", "clientSecret")
CODE_SQL = ("text || chr(10) || 'const ' || {name} || ' = \"' || expected_secret || '\";' || chr(10)")


def _sources(spark, sf_dir):
    docs = labelled(spark, sf_dir)
    plain = table(spark, sf_dir, "documents").select("doc_id", "text")
    code = F.expr(CODE_SQL.format(name=picked(NAMES, "doc_id", "spark")))
    return docs.drop("text").join(plain, "doc_id").select(F.col("path").alias("path"), code.alias("text"))


def _env(spark, sf_dir):
    """An env file that defines two of the names and one of the secrets already."""
    known = labelled(spark, sf_dir).agg(F.min_by("expected_secret", "doc_id").alias("s"))
    return X.parse_env(known.select(F.lit(".env").alias("path"), F.concat(F.lit("API_KEY="), "s", F.lit("\nexport DB_PASSWORD_2='x'\n# note\n")).alias("text")))


def env_names(spark, sf_dir):
    """Variable names given to the secrets of all source files."""
    added = X.plan_fixes(_sources(spark, sf_dir), _env(spark, sf_dir))["added"]
    return added.select("name", F.sha2("value", 256).alias("value"))


def fix_plan(spark, sf_dir):
    return X.plan_fixes(_sources(spark, sf_dir), _env(spark, sf_dir))["edits"].select("path", "line", "name", "replacement")


def fix_manual(spark, sf_dir):
    return X.plan_fixes(_sources(spark, sf_dir), _env(spark, sf_dir))["manual"]


def fixed_files(spark, sf_dir):
    """Rewritten files hold no blocking finding inside a string literal any more."""
    files = X.plan_fixes(_sources(spark, sf_dir), _env(spark, sf_dir))["files"]
    return files.select("path", F.sha2("updated", 256).alias("digest"), (F.col("text") != F.col("updated")).alias("changed"))


def env_lines(spark, sf_dir):
    env = _env(spark, sf_dir)
    return X.env_additions(X.plan_fixes(_sources(spark, sf_dir), env)["added"], env).select("name", "example_line", F.sha2("env_line", 256).alias("env_line"))


# Every finding of these files sits in a double-quoted literal it fills; PEM samples span lines and have none.
FIX_CTES = f"""{labelled_sql(columns='doc_id, path, text AS plain').replace('docs AS', 'origin AS')},
docs AS (SELECT doc_id, path, {CODE_SQL.replace('text ||', 'plain ||').format(name=picked(NAMES, 'doc_id', 'duckdb'))} AS text FROM origin),
{duck.findings('docs', path='path')},
spots AS (SELECT f.*, path, string_split(substring(text, 1, start_at), chr(10))[-1] AS before, string_split(substring(text, end_at + 1), chr(10))[1] AS after
  FROM findings f JOIN docs USING (doc_id) WHERE serious AND regexp_matches(path, '\\.(py|ts|go|rb|php|sh)$') AND note IS NULL),
lits AS (SELECT *, regexp_extract(before, '"([^"]*)$', 1) || match || regexp_extract(after, '^([^"]*)"', 1) AS value,
  len(before) - len(replace(before, '"', '')) AS quotes, regexp_extract(before, '([A-Za-z_][A-Za-z0-9_]*)\\s*[:=]\\s*"[^"]*$', 1) AS ident FROM spots
  WHERE NOT contains(match, chr(10))),
based AS (SELECT *, upper(regexp_replace(ident, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS base FROM lits WHERE quotes % 2 = 1),
vals AS (SELECT value, arg_min(base, (path, -start_at)) AS base, min((path, -start_at)) AS first_seen FROM based
  WHERE value <> (SELECT arg_min(expected_secret, doc_id) FROM origin) GROUP BY value),
turns AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY first_seen, value) AS turn FROM vals),
numbered AS (SELECT *, CASE base WHEN 'API_KEY' THEN turn + 1 WHEN 'DB_PASSWORD' THEN CASE WHEN turn >= 2 THEN turn + 1 ELSE turn END ELSE turn END AS k FROM turns),
names AS (SELECT value, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS name FROM numbered),
known AS (SELECT * FROM names UNION ALL SELECT arg_min(expected_secret, doc_id), 'API_KEY' FROM origin)"""
LOOKUP = ("CASE regexp_extract(path, '\\.([a-z]+)$', 1) WHEN 'ts' THEN 'process.env.' || name WHEN 'py' THEN 'os.environ[\"' || name || '\"]' "
          "WHEN 'rb' THEN 'ENV[\"' || name || '\"]' WHEN 'go' THEN 'os.Getenv(\"' || name || '\")' WHEN 'php' THEN 'getenv(\"' || name || '\")' "
          "WHEN 'sh' THEN '\"$' || name || '\"' END")


# Literals, quotes included, replaced by lookups.
FIXED_FILES = f"""WITH {FIX_CTES},
spans AS (SELECT DISTINCT doc_id, start_at - len(regexp_extract(before, '"([^"]*)$', 1)) - 1 AS start_at, end_at + len(regexp_extract(after, '^([^"]*)"', 1)) + 1 AS end_at,
  {LOOKUP} AS placeholder FROM based JOIN known USING (value)),
{spliced_sql()} SELECT path, sha256(r.text) AS digest, n > 0 AS changed FROM redacted r JOIN docs USING (doc_id)"""


# --- streams -----------------------------------------------------------------------------

def _new_folder(spark) -> str:
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    gone_at_end(spark, folder)
    return folder


def _stream(spark, sf_dir, name):
    """A given table as a stream, be it one file or a folder of files: a pattern, unlike a path, may stand for either."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _written(spark, folder, schema):
    """What a stream wrote; nothing, if it had no rows."""
    gone_at_end(spark, folder)
    return spark.read.schema(schema).parquet(folder)


def stream_redact(spark, sf_dir):
    """The conversation turns as a stream, masked with a stored vault."""
    base = _new_folder(spark)
    turns = with_prompt_samples(_stream(spark, sf_dir, "conversations")).select("row_id", "text")
    G.redact_stream(turns, "text", ["row_id"], f"{base}/vault", KEY, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    done = _written(spark, f"{base}/out", "row_id long, text string, redactions int")
    return done.select("row_id", F.sha2("text", 256).alias("text"), "redactions")


STREAM_REDACT = f"WITH {PROMPT_SERIOUS}, {vault_sql('row_id')}, {spliced_sql('row_id')} SELECT row_id, sha256(text) AS text, n AS redactions FROM redacted"


def stream_heartbeat(spark, sf_dir):
    base = _new_folder(spark)
    events = _stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("agent"), F.col("event_type").alias("event"), F.col("ts").alias("at"))
    G.heartbeat_stream(events, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return G.current_heartbeats(spark, f"{base}/out")


HEARTBEAT = "SELECT CAST(user_id AS VARCHAR) AS agent, event_type AS event, max(ts) AS last_seen, count(*) AS cnt FROM events GROUP BY 1, 2"


# What the turns arrive as, by turn; the last is cut short.
ARRIVALS = ("UserPromptSubmit", "PreToolUse", "PostToolUse", "beforeShellExecution", "beforeReadFile", "SessionStart", "broken")


def stream_decisions(spark, sf_dir):
    """Events of every kind arriving as JSON lines, some broken: decided as they come."""
    base = _new_folder(spark)
    turns = with_prompt_samples(_stream(spark, sf_dir, "conversations")).withColumn("name", F.expr(picked(ARRIVALS, "row_id", "spark")))
    text = F.coalesce("text", F.lit(""))
    payload = F.to_json(F.struct(
        F.col("name").alias("hookEventName"), F.when(F.col("name").isin("UserPromptSubmit", "SessionStart", "broken"), text).alias("prompt"),
        F.when(F.col("name") == "PreToolUse", F.struct(text.alias("content"))).alias("tool_input"),
        F.when(F.col("name") == "PostToolUse", F.struct(text.alias("output"))).alias("tool_response"),
        F.when(F.col("name") == "beforeShellExecution", text).alias("command"),
        F.when(F.col("name") == "beforeReadFile", F.expr(picked(PATHS, "turn", "spark"))).alias("file_path")))
    lines = turns.select("row_id", F.when(F.col("name") == "broken", F.substring(payload, 2, 40)).otherwise(payload).alias("value"))
    decided = G.tool_decisions(parse_events(lines), BLOCK).select("row_id", "parsed", "event", F.col("decision.kind").alias("kind"))
    query = (decided.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return _written(spark, f"{base}/out", decided.schema)


def _json_event(name, **fields):
    return F.to_json(F.struct(F.lit(name).alias("hook_event_name"), *[c.alias(k) for k, c in fields.items()]))


def _source_of_events(folder, files):
    """Event lines as they arrive: as many files as one half was written in are a batch, read by many tasks."""
    return lambda spark: spark.readStream.schema("row_id long, value string").option("maxFilesPerTrigger", files).parquet(folder)


def _arrived(lines, folder) -> int:
    """Lines written as they come, in one file for each task; the number of files."""
    lines.select("row_id", "value").write.parquet(folder)
    return max(1, len(lines.sparkSession.read.parquet(folder).inputFiles()))


def stream_results(spark, sf_dir):
    """Tool calls are masked in one run of a stream, their results restored in the next, from the stored vault.

    The calls of each half of the conversations are a batch, their results, some of them bent, another.  The second run
    resumes where the first one stopped and reads the key with the vault.
    """
    base = _new_folder(spark)

    def run(key, files):
        events = parse_events(_source_of_events(f"{base}/events/*", files)(spark))
        G.event_stream(events, ["row_id"], F.lit("gemini"), f"{base}/vault", key, f"{base}/out", f"{base}/checkpoint").awaitTermination()
        return spark.read.parquet(f"{base}/out")

    turns = with_prompt_samples(table(spark, sf_dir, "conversations")).select("row_id", "conv_id", F.coalesce("text", F.lit("")).alias("text"))
    calls = turns.select("row_id", "conv_id", _json_event("BeforeTool", tool_name=F.lit("write"), tool_input=F.struct(F.col("text").alias("content"))).alias("value"))
    files = max([_arrived(calls.where(F.col("conv_id") % 2 == half), f"{base}/events/calls{half}") for half in (0, 1)])
    masked = run(KEY, files).select("row_id", "input.content").join(turns.select("row_id", "text", "conv_id"), "row_id")
    back = F.when(F.col("row_id") % 5 == 0, F.concat(F.coalesce("content", "text"), F.lit(" MASKED_NOBODY_KEY_0000"))).otherwise(F.coalesce("content", "text"))
    answers = masked.select("row_id", "conv_id", _json_event("AfterTool", tool_response=F.struct(back.alias("output"))).alias("value"))
    files = max([_arrived(answers.where(F.col("conv_id") % 2 == half), f"{base}/events/results{half}") for half in (0, 1)])
    done = run(None, files)
    return done.where("kind = 'result'").select("row_id", "decision.kind", "substituted", F.sha2("text", 256).alias("text"), F.when(
        F.startswith("context", F.lit("restored")), F.col("context")).when(F.col("context").isNotNull(), "warning").alias("context"))


STREAM_RESULTS = (f"WITH {PROMPT_SERIOUS}, counted AS (SELECT row_id, coalesce(text, '') AS text, (SELECT count(*) FROM serious s WHERE s.row_id = d.row_id) AS n FROM docs d) "
                  "SELECT row_id, 'allow' AS kind, n AS substituted, sha256(CASE WHEN row_id % 5 = 0 THEN text || ' MASKED_NOBODY_KEY_0000' ELSE text END) AS text, "
                  "CASE WHEN row_id % 5 = 0 THEN 'warning' WHEN n > 0 THEN 'restored ' || n || ' value(s)' END AS context FROM counted")


def vault_restart(spark, sf_dir):
    """Two sessions mask two batches each with one stored vault: what every secret is called, by how many batches, in how many files."""
    path = f"{_new_folder(spark)}/vault"
    docs = labelled(spark, sf_dir).select("doc_id", "text")
    tables = []
    for session, key in ((spark, KEY), (spark.newSession(), None)):
        for _ in range(2):
            store = VaultStore(session, path, key, segments=2)
            part = docs.where(F.col("doc_id") % 4 == len(tables))
            out, vault = G.with_vault(store, lambda held, pads: redact_df(part, "text", ["doc_id"], held, pads))
            used = out.select(F.explode("replacements").alias("r")).select(F.col("r.value").alias("placeholder")).distinct()
            tables.append(used.withColumn("batch", F.lit(len(tables))))
    known = store.load().select("placeholder", fingerprint(F.col("secret"), SALT).alias("fingerprint"))
    seen = reduce(DataFrame.unionByName, tables).groupBy("placeholder").agg(F.count("*").alias("batches"))
    few = store.file_count() <= 1 + 3 + 3 * 2 * 2  # key, manifests, and the segments that they name
    return known.join(seen, "placeholder").select("placeholder", "fingerprint", "batches", F.lit(few).alias("few_files"))


VAULT_RESTART = (f"WITH {SERIOUS}, {vault_sql('doc_id % 4, doc_id')} SELECT placeholder, {fp('secret')} AS fingerprint, "
                 "(SELECT count(DISTINCT doc_id % 4) FROM serious WHERE match = secret) AS batches, TRUE AS few_files FROM vault")


STREAM_DECISIONS = f"""WITH {PROMPT_SERIOUS}, named AS (SELECT row_id, text AS command, {picked(ARRIVALS, 'row_id', 'duckdb')} AS name, {picked(PATHS, 'turn', 'duckdb')} AS path FROM docs)
SELECT row_id, name <> 'broken' AS parsed, CASE WHEN name <> 'broken' THEN name ELSE '' END AS event,
  CASE WHEN name IN ('UserPromptSubmit', 'PreToolUse', 'beforeShellExecution') AND row_id IN (SELECT row_id FROM serious) THEN 'deny'
  WHEN name = 'beforeShellExecution' AND {SENSITIVE_COMMAND} THEN 'deny' WHEN name = 'beforeReadFile' AND {SENSITIVE_PATH} THEN 'deny' ELSE 'allow' END AS kind FROM named"""

QUERIES = {
    "sensitive_paths": (sensitive_paths, f"SELECT event_id, path, {SENSITIVE_PATH} AS sensitive FROM (SELECT event_id, {picked(PATHS, 'event_id', 'duckdb')} AS path FROM events)"),
    "sensitive_commands": (sensitive_commands, f"SELECT event_id, command, {SENSITIVE_COMMAND} AS sensitive FROM (SELECT event_id, {picked(COMMANDS, '(event_id + user_id)', 'duckdb')} AS command FROM events)"),
    "tool_decisions": (tool_decisions, TOOL_DECISIONS),
    "prompt_decisions": (prompt_decisions, PROMPT_DECISIONS),
    "guard_messages": (guard_messages_text, GUARD_TEXT),
    "agent_heartbeat": (agent_heartbeat, HEARTBEAT),
    "agent_health": (agent_health, f"WITH {BEATS} SELECT agent, string_agg(event || ':' || cnt, ' ' ORDER BY last_seen DESC, event DESC) AS events, max(last_seen) AS last_seen FROM beats GROUP BY agent"),
    "latest_events": (latest_events, f"WITH {BEATS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY last_seen DESC, event DESC) AS place FROM beats) WHERE place <= 4"),
    "human_age": (human_ages, f"WITH src AS (SELECT event_id, ts AS seen_at FROM events) SELECT event_id, {AGE} AS age FROM ({AGES.format('src')})"),
    "agent_status": (agent_status, AGENT_STATUS),
    "env_names": (env_names, f"WITH {FIX_CTES} SELECT name, sha256(value) AS value FROM names"),
    "env_lines": (env_lines, f"WITH {FIX_CTES} SELECT name, name || '=' AS example_line, sha256(name || '=' || value) AS env_line FROM names"),
    "fix_plan": (fix_plan, f"WITH {FIX_CTES} SELECT path, line, name, {LOOKUP} AS replacement FROM based JOIN known USING (value)"),
    "fix_manual": (fix_manual, f"WITH {FIX_CTES} SELECT path, line, 'not inside a string literal' AS reason FROM spots WHERE contains(match, chr(10)) OR (len(before) - len(replace(before, '\"', ''))) % 2 = 0"),
    "fixed_files": (fixed_files, FIXED_FILES),
    "stream_redact": (stream_redact, STREAM_REDACT),
    "stream_heartbeat": (stream_heartbeat, HEARTBEAT),
    "stream_decisions": (stream_decisions, STREAM_DECISIONS),
    "stream_results": (stream_results, STREAM_RESULTS),
    "vault_restart": (vault_restart, VAULT_RESTART),
}
