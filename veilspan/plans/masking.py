"""Registered queries: placeholders, redaction, restoration, files at rest, nested values."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.text import fingerprint, key_pads
from ..operators import vault as V
from ..operators.joins import cut_lineage, spread
from ..operators.lock import lock_files, unlock_files
from ..operators.nested import redact_json, redact_nested
from ..operators.policy import decide_results
from ..operators.redact import (blocking_spans, classified_tokens, first_sightings, placeholder_tokens, redact_df,
                                rehydrate_df, resembles)
from ..operators.scan import blocking, scan_df
from ..options import ScanOptions
from ..sources.messages import guard_messages
from ..sources.samples import with_samples
from . import duck
from .detection import SALT, SERIOUS, fp
from .inputs import labelled, labelled_sql, prompts_sql, table, with_prompt_samples

KEY = b"registered queries use a fixed key"
DEFAULT = ScanOptions()


def vault_sql(key: str = "doc_id") -> str:
    """CTEs ``vault`` and ``spans`` over a CTE ``serious``: names by first sighting, longer on collision."""
    name = duck.stem("provider", "rule_id")
    lengths = [4, 6, 8]
    ctes = [f"seen AS (SELECT match AS secret, arg_min(provider, ({key}, -start_at)) AS provider, arg_min(rule_id, ({key}, -start_at)) AS rule_id, "
            f"min(({key}, -start_at)) AS first_seen FROM serious GROUP BY match)",
            f"digested AS (SELECT *, {duck.digest('secret', *key_pads(KEY))} AS digest, {name} AS stem FROM seen)"]
    pool = "digested"
    for n in lengths:
        ctes.append(f"try{n} AS (SELECT *, stem || '_' || substring(digest, 1, {n}) AS placeholder, row_number() OVER "
                    f"(PARTITION BY stem, substring(digest, 1, {n}) ORDER BY first_seen, secret) AS turn FROM {pool})")
        ctes.append(f"left{n} AS (SELECT * EXCLUDE (placeholder, turn) FROM try{n} WHERE turn > 1)")
        pool = f"left{n}"
    ctes.append("vault AS (" + " UNION ALL ".join(f"SELECT secret, placeholder FROM try{n} WHERE turn = 1" for n in lengths) + ")")
    ctes.append("spans AS (SELECT s.*, v.placeholder FROM serious s JOIN vault v ON v.secret = s.match)")
    return ", ".join(ctes)


def spliced_sql(key: str = "doc_id", source: str = "docs") -> str:
    """CTE ``redacted`` (key, n, text): text with the spans replaced."""
    return (f"pieces AS (SELECT {key}, placeholder, start_at, end_at, coalesce(lag(end_at) OVER w, 0) AS prev FROM spans "
            f"WINDOW w AS (PARTITION BY {key} ORDER BY start_at)), "
            f"joined AS (SELECT d.{key}, string_agg(substring(d.text, prev + 1, start_at - prev) || placeholder, '' ORDER BY start_at) AS head, "
            f"max(end_at) AS last, count(*) AS n FROM pieces JOIN {source} d USING ({key}) GROUP BY d.{key}), "
            f"redacted AS (SELECT d.{key}, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN d.text ELSE head || substring(d.text, last + 1) END AS text "
            f"FROM {source} d LEFT JOIN joined USING ({key}))")


def _key(spark):
    return V.key_frame(spark, KEY)


def _texts(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", "text")


def _sightings(spark, sf_dir):
    return first_sightings(blocking_spans(scan_df(_texts(spark, sf_dir), "text"), ["doc_id"], DEFAULT), ["doc_id"])


def placeholders(spark, sf_dir):
    named = V.allocate(_sightings(spark, sf_dir), V.empty_vault(spark), _key(spark), DEFAULT.prefix)
    return named.select("placeholder", fingerprint(F.col("secret"), SALT).alias("fingerprint"))


def placeholder_stems(spark, sf_dir):
    """Every secret with its placeholder words, without the digest."""
    return _sightings(spark, sf_dir).select(
        fingerprint(F.col("secret"), SALT).alias("fingerprint"), V.kind_of(F.col("rule_id")).alias("kind"),
        V.stem(F.col("provider"), F.col("rule_id"), DEFAULT.prefix).alias("stem"))


def known_secrets_kept(spark, sf_dir):
    """A second run against a vault of the labelled-as-good documents keeps their names."""
    docs, good = _texts(spark, sf_dir), table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    key, empty = _key(spark), V.empty_vault(spark)
    sightings = _sightings(spark, sf_dir)
    first = blocking_spans(scan_df(docs.join(good, "doc_id", "left_semi"), "text"), ["doc_id"], DEFAULT)
    old = V.refreshed(empty, V.allocate(first_sightings(first, ["doc_id"]), empty, key, DEFAULT.prefix), F.lit("2024-01-01").cast("timestamp"))
    added = V.allocate(sightings, old, key, DEFAULT.prefix)
    return added.agg(F.count("*").alias("added")).withColumn("kept", F.lit(old.count()))


KNOWN_SECRETS = (f"WITH {SERIOUS} SELECT (SELECT count(DISTINCT match) FROM serious) - count(DISTINCT match) AS added, "
                 "count(DISTINCT match) AS kept FROM serious WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")


def redacted_documents(spark, sf_dir):
    out, _ = redact_df(_texts(spark, sf_dir), "text", ["doc_id"], V.empty_vault(spark), _key(spark))
    return out.select("doc_id", F.sha2("redacted", 256).alias("digest"), F.size("replacements").alias("replaced"))


# Keys as careless writers leave them: missing, or shared by many rows.
ODD_KEY_SQL = "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN doc_id % 10 ELSE doc_id END"


def masking_odd_keys(spark, sf_dir):
    """Rows with null and repeated keys, some of whose secrets the vault knows by names of its own: each is masked as its own text asks."""
    docs = _texts(spark, sf_dir).withColumn("k", F.expr(ODD_KEY_SQL))
    known = cut_lineage(_sightings(spark, sf_dir).where(F.substring(F.sha2("secret", 256), 1, 1) == "7").select("secret"))
    names = F.concat(F.lit("MASKED_KNOWN_KEY_"), F.substring(F.sha2("secret", 256), 1, 12))
    vault = known.select(names.alias("placeholder"), "secret", F.lit("2024-01-01").cast("timestamp").alias("at"))
    out, _ = redact_df(docs, "text", ["k"], vault, _key(spark))
    return out.select("doc_id", F.sha2("redacted", 256).alias("digest"), F.size("replacements").alias("replaced"))


ODD_KEYS = (f"WITH {SERIOUS.replace('serious AS', 'all_serious AS')}, serious AS (SELECT *, coalesce({ODD_KEY_SQL}, -1) AS k FROM all_serious WHERE substring(sha256(match), 1, 1) <> '7'), "
            f"{vault_sql('k').replace('spans AS', 'own_spans AS')}, spans AS (SELECT doc_id, start_at, end_at, placeholder FROM own_spans UNION ALL "
            "SELECT doc_id, start_at, end_at, 'MASKED_KNOWN_KEY_' || substring(sha256(match), 1, 12) FROM all_serious WHERE substring(sha256(match), 1, 1) = '7'), "
            f"{spliced_sql()} SELECT doc_id, sha256(text) AS digest, n AS replaced FROM redacted")


REDACTED = f"WITH {SERIOUS}, {vault_sql()}, {spliced_sql()} "


def roundtrip_mismatches(spark, sf_dir):
    """Redact, restore and compare; also look for any secret left in the redacted text: those that were replaced, as they are, and whatever a scan finds."""
    out, added = redact_df(_texts(spark, sf_dir), "text", ["doc_id"], V.empty_vault(spark), _key(spark))
    replaced = F.transform("replacements", lambda r: F.substring(F.col("text"), r["start"] + 1, r["end"] - r["start"]))
    held = F.size(F.filter(replaced, lambda secret: F.contains(F.col("redacted"), secret)))
    # The count is a column first: in one selection its ``text`` would be the renamed one.
    masked = out.withColumn("held", held).select("doc_id", F.col("text").alias("original"), F.col("redacted").alias("text"), "held")
    again = scan_df(masked.select("text", "held"), "text")
    left = again.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("secrets_left"),
                     F.coalesce(F.sum(F.size(blocking(F.col("findings"), DEFAULT))), F.lit(0)).alias("findings_left"))
    back = rehydrate_df(masked.drop("held"), "text", ["doc_id"], V.refreshed(V.empty_vault(spark), added, F.current_timestamp()))
    return back.agg(F.count("*").alias("texts"), F.count_if(~F.col("restored").eqNullSafe(F.col("original"))).alias("mismatches"),
                    F.coalesce(F.sum("substituted"), F.lit(0)).alias("substituted")).crossJoin(left)


ROUNDTRIP = (REDACTED + "SELECT (SELECT count(*) FROM docs) AS texts, 0 AS mismatches, (SELECT count(*) FROM serious) AS substituted, "
             "(SELECT count(*) FROM serious s JOIN redacted r USING (doc_id) WHERE contains(r.text, s.match)) AS secrets_left, "
             f"(WITH {duck.findings('redacted')} SELECT count(*) FROM findings WHERE serious) AS findings_left")


def rescan_of_redacted(spark, sf_dir):
    """Redacted texts hold no blocking finding."""
    out, _ = redact_df(_texts(spark, sf_dir), "text", ["doc_id"], V.empty_vault(spark), _key(spark))
    again = blocking_spans(scan_df(out.select("doc_id", F.col("redacted").alias("text")), "text"), ["doc_id"], DEFAULT)
    return again.agg(F.count("*").alias("findings"))


# Placeholders as an editor may hand them back: exact, cut, extended, reformatted or invented.
BENT_SQL = ("CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, length(text) - 1) WHEN 2 THEN text || 'x' "
            "WHEN 3 THEN text || ' MASKED_NOBODY_KEY_0000' ELSE lower(text) END")


def _bent(spark, sf_dir):
    out, added = redact_df(_texts(spark, sf_dir), "text", ["doc_id"], V.empty_vault(spark), _key(spark))
    texts = out.select("doc_id", F.array_join(F.transform("replacements", lambda r: r["value"]), "\n").alias("text"))
    return texts.withColumn("text", F.expr(BENT_SQL)), V.refreshed(V.empty_vault(spark), added, F.current_timestamp())


def rehydrate_warnings(spark, sf_dir):
    texts, vault = _bent(spark, sf_dir)
    kinds = classified_tokens(placeholder_tokens(texts, "text", ["doc_id"], DEFAULT), vault, ["doc_id"])
    return kinds.select("doc_id", F.col("start").alias("start_at"), "token", "kind")


# Names and tokens of one stem, from the order lines: digests cut at several places.
LINE_DIGEST = "upper(sha2(CAST(l_orderkey * 8 + l_linenumber AS STRING), 256))"
LINE_ID = "(l_orderkey * 8 + l_linenumber)"
STEM_NAME = "'MASKED_NPM_TOKEN_' || substring(d, 1, CAST(4 + 2 * (id % 4) AS INT))"
STEM_TOKEN = ("CASE id % 5 WHEN 0 THEN 'MASKED_NPM_TOKEN_' || substring(d, 1, 3) WHEN 1 THEN 'MASKED_NPM_TOKEN_' || substring(d, 1, 12) "
              "WHEN 2 THEN 'MASKED_NPM_TOKEN_' || substring(d, 1, 5) WHEN 3 THEN 'MASKED_NPM_' || substring(d, 1, 9) ELSE 'MASKED_NPM_TOKEN_' || substring(d, 3, 10) END")


def tokens_of_one_stem(spark, sf_dir):
    """Every order line brings a token of one stem, every third one a name of that stem: which tokens resemble a name."""
    lines = table(spark, sf_dir, "lineitem").select(F.expr(LINE_ID).alias("id"), F.expr(LINE_DIGEST).alias("d"))
    names = lines.where("id % 3 = 0").select(F.expr(STEM_NAME).alias("placeholder"))
    tokens = lines.select(F.expr(STEM_TOKEN).alias("token")).distinct()
    near = resembles(tokens, names).withColumn("near", F.lit(True))
    return tokens.join(near, "token", "left").select("token", F.coalesce("near", F.lit(False)).alias("near"))


ONE_STEM = (f"WITH l AS (SELECT {LINE_ID} AS id, upper(sha256(CAST({LINE_ID} AS VARCHAR))) AS d FROM lineitem), n AS (SELECT DISTINCT {STEM_NAME} AS name FROM l WHERE id % 3 = 0), "
            f"t AS (SELECT DISTINCT {STEM_TOKEN} AS token FROM l), a AS (SELECT DISTINCT substring(name, 1, k) AS head FROM n, range(1, 40) r(k)), "
            "b AS (SELECT token, substring(token, 1, k) AS head FROM t, range(1, 40) r(k)) "
            "SELECT token, token IN (SELECT head FROM a) OR token IN (SELECT token FROM b JOIN n ON n.name = b.head) AS near FROM t")


def rehydrate_counts(spark, sf_dir):
    """Substitutions and warnings per text."""
    texts, vault = _bent(spark, sf_dir)
    done = rehydrate_df(texts, "text", ["doc_id"], vault)
    return done.select("doc_id", "substituted", F.size("warnings").alias("warnings"))


BENT = (f"WITH {SERIOUS}, {vault_sql()}, listed AS (SELECT d.doc_id, coalesce(string_agg(placeholder, chr(10) ORDER BY start_at), '') AS text "
        f"FROM docs d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id), bent AS (SELECT doc_id, {BENT_SQL} AS text FROM listed), "
        "tok AS (SELECT doc_id, unnest(regexp_extract_all(text, 'MASKED_[A-Za-z0-9_]*')) AS token, "
        "generate_subscripts(regexp_extract_all(text, 'MASKED_[A-Za-z0-9_]*'), 1) AS i, text FROM bent), "
        "kinds AS (SELECT doc_id, token, i, text, CASE WHEN EXISTS (SELECT 1 FROM vault v WHERE v.placeholder = token) THEN 'exact' "
        "WHEN EXISTS (SELECT 1 FROM vault v WHERE starts_with(v.placeholder, token) OR starts_with(token, v.placeholder)) THEN 'mangled' "
        "ELSE 'unknown' END AS kind FROM tok)")


def tool_results(spark, sf_dir):
    """Placeholders coming back inside tool results: restored, or doubted with a warning."""
    texts, vault = _bent(spark, sf_dir)
    result = F.to_json(F.struct(F.array(F.lit(""), F.col("text")).alias("out"), F.lit(1).alias("code")))
    done = decide_results(texts.select("doc_id", result.alias("result")), "result", ["doc_id"], vault)
    return done.select("doc_id", "substituted", F.when(F.startswith("context", F.lit("restored")), F.col("context"))
                       .when(F.col("context").isNotNull(), "warning").alias("context"))


def vault_live(spark, sf_dir):
    """Events as vault entries of different ages: what is still alive at the newest time."""
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    entries = events.select(F.concat(F.lit("P"), "event_id").alias("placeholder"), F.col("props").alias("secret"), F.col("ts").alias("at"))
    return V.vault_status(V.live(entries, now, timedelta(hours=12)))


VAULT_LIVE = ("SELECT count(*) AS entries, min(ts) AS oldest, max(ts) AS newest FROM events "
              "WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")


# --- files at rest -----------------------------------------------------------------------

ENV_SQL = ("'APP_NAME=demo' || chr(10) || 'API_TOKEN_' || doc_id || '=' || CASE doc_id % 3 WHEN 0 THEN '\"' || expected_secret || '\"' "
           "WHEN 1 THEN expected_secret ELSE 'none' END || chr(10)")


def _env_files(spark, sf_dir):
    return labelled(spark, sf_dir).select(F.concat(F.lit("app/"), "doc_id", F.lit("/.env")).alias("path"),
                                          F.expr(ENV_SQL).alias("text"))


def locked_files(spark, sf_dir):
    out, _, _ = lock_files(_env_files(spark, sf_dir), V.empty_vault(spark), _key(spark))
    return out.select("path", "status", "locked")


LOCKED = (f"WITH {labelled_sql(columns='doc_id').replace('docs AS', 'origin AS')}, docs AS (SELECT doc_id, {ENV_SQL} AS text FROM origin), "
          f"{duck.findings('docs')}, n AS (SELECT d.doc_id, count(f.doc_id) AS n FROM docs d LEFT JOIN (SELECT * FROM findings WHERE serious) f "
          "ON f.doc_id = d.doc_id GROUP BY d.doc_id) SELECT 'app/' || doc_id || '/.env' AS path, "
          "CASE WHEN n = 0 THEN 'skipped' ELSE 'locked' END AS status, n AS locked FROM n")


def unlocked_files(spark, sf_dir):
    """Lock, lose part of the vault, unlock: where each file came back from and whether it is whole."""
    files = _env_files(spark, sf_dir)
    out, originals, added = lock_files(files, V.empty_vault(spark), _key(spark))
    vault = V.refreshed(V.empty_vault(spark), added, F.current_timestamp()).filter("placeholder NOT LIKE '%KEY%'")
    locked = out.select("path", F.col("locked_text").alias("text"))
    back = unlock_files(locked, vault, originals).join(files, "path")
    return back.select("path", "source", "used_backup", (F.col("unlocked_text") == F.col("text")).alias("whole"))


ENV_DOCS = f"{labelled_sql(columns='doc_id').replace('docs AS', 'origin AS')}, docs AS (SELECT doc_id, 'app/' || doc_id || '/.env' AS file, {ENV_SQL} AS text FROM origin)"
UNLOCKED = (f"WITH {ENV_DOCS}, {duck.findings('docs')}, serious AS (SELECT f.*, file FROM findings f JOIN docs USING (doc_id) WHERE serious), {vault_sql('file')}, "
            "n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (contains(placeholder, 'KEY')) AS lost FROM spans GROUP BY doc_id) "
            "SELECT file AS path, CASE WHEN n IS NULL THEN 'not locked' WHEN lost > 0 THEN 'original' ELSE 'vault' END AS source, "
            "coalesce(lost, 0) > 0 AS used_backup, TRUE AS whole FROM docs LEFT JOIN n USING (doc_id)")

# Three files of four share a path with many; every seventh has none.
ODD_PATH = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 4 > 0 THEN 'app/.env' ELSE 'app/' || doc_id || '/.env' END"


def unlocked_odd_paths(spark, sf_dir):
    """Lock files that share a path or have none, lose the vault, unlock: every file has its own text again."""
    files = labelled(spark, sf_dir).select(F.expr(ODD_PATH).alias("path"), F.expr(ENV_SQL).alias("text"))
    out, originals, _ = lock_files(files, V.empty_vault(spark), _key(spark))
    back = unlock_files(out.select("path", F.col("locked_text").alias("text")), V.empty_vault(spark), originals)
    return back.select("path", "source", F.sha2("unlocked_text", 256).alias("text_sha256"))


UNLOCKED_ODD_PATHS = (f"WITH {ENV_DOCS}, {duck.findings('docs')} SELECT {ODD_PATH} AS path, CASE WHEN doc_id IN (SELECT doc_id FROM findings WHERE serious) "
                      "THEN 'original' ELSE 'not locked' END AS source, sha256(text) AS text_sha256 FROM docs")


def _json_lines(spark, sf_dir):
    events = with_samples(spread(table(spark, sf_dir, "events")).select("event_id", "props", F.lit("note:").alias("text")), "event_id")
    return events.select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.array(
        F.struct(F.col("text").alias("note"))).alias("parts"))).alias("props"))


def json_leaf_redaction(spark, sf_dir):
    """Strings at any depth of a JSON column, masked; the key is the event."""
    out, _ = redact_json(_json_lines(spark, sf_dir), "props", ["event_id"], V.empty_vault(spark), _key(spark))
    return out.select("event_id", "redactions", F.get_json_object("props", "$.k").cast("int").alias("k"),
                      F.sha2(F.get_json_object("props", "$.parts[0].note"), 256).alias("note"))


NOTES = labelled_sql(key="event_id", columns="event_id AS doc_id, event_id, props", where_from="(SELECT *, 'note:' AS text FROM events)")
JSON_LEAVES = (f"WITH {NOTES}, {duck.findings('docs')}, serious AS (SELECT * FROM findings WHERE serious), {vault_sql()}, {spliced_sql()} "
               "SELECT d.event_id, r.n AS redactions, CAST(json_extract(props, '$.k') AS INTEGER) AS k, sha256(r.text) AS note "
               "FROM docs d JOIN redacted r USING (doc_id)")


def nested_redaction(spark, sf_dir):
    """Strings of a typed nested column, masked without leaving the JVM."""
    docs = labelled(spark, sf_dir)
    payload = F.struct(F.array("lang", "text").alias("parts"), F.create_map(F.lit("source"), F.col("source")).alias("meta"),
                       F.col("doc_id").alias("number"))
    out, _ = redact_nested(docs.select("doc_id", payload.alias("payload")), "payload", ["doc_id"], V.empty_vault(spark), _key(spark))
    return out.select("doc_id", "redactions", F.sha2(F.element_at("payload.parts", 2), 256).alias("digest"),
                      F.element_at("payload.meta", "source").alias("source"), F.col("payload.number").alias("number"))


def message_guard(spark, sf_dir):
    """Conversation turns as request messages: masked params, other members untouched."""
    turns = with_prompt_samples(table(spark, sf_dir, "conversations"))
    line = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("row_id").alias("id"), F.lit("tools/call").alias("method"),
                              F.struct(F.struct("text").alias("arguments")).alias("params")))
    lines = turns.select("row_id", F.when(F.col("role") == "system", F.lit("not json")).otherwise(line).alias("value"))
    out, _ = guard_messages(lines, ["row_id"], "request", V.empty_vault(spark), _key(spark))
    return out.select("row_id", "redactions", "parsed", "method", F.get_json_object("outgoing", "$.id").cast("bigint").alias("id"),
                      F.sha2(F.get_json_object("outgoing", "$.params.arguments.text"), 256).alias("text"))


PROMPT_SERIOUS = f"{prompts_sql()}, {duck.findings('docs', key='row_id')}, serious AS (SELECT * FROM findings WHERE serious)"
MESSAGES = (f"WITH {PROMPT_SERIOUS}, {vault_sql('row_id')}, {spliced_sql('row_id')} "
            "SELECT row_id, CASE WHEN role = 'system' THEN 0 ELSE n END AS redactions, role <> 'system' AS parsed, "
            "CASE WHEN role <> 'system' THEN 'tools/call' END AS method, CASE WHEN role <> 'system' THEN row_id END AS id, "
            "CASE WHEN role <> 'system' THEN sha256(r.text) END AS text FROM docs d JOIN redacted r USING (row_id)")

# Lines that strict readers refuse: a member named twice, and text that is no message at all.
def message_odd_lines(spark, sf_dir):
    """Turns as messages that name a member twice, and as log lines: credentials go out in neither."""
    turns = with_prompt_samples(table(spark, sf_dir, "conversations")).withColumn("text", F.coalesce("text", F.lit("")))
    twice = F.concat(F.lit('{"method":"m","params":{"a":"q","a":'), F.get_json_object(F.to_json(F.struct("text")), "$"), F.lit("}}"))
    twice = F.regexp_replace(twice, r'"a":\{"text":(.*)\}\}\}\z', '"a":$1}}')
    lines = turns.select("row_id", "text", F.when(F.col("row_id") % 2 == 0, twice).otherwise(F.concat(F.lit("log: "), "text")).alias("value"))
    out, _ = guard_messages(lines, ["row_id"], "request", V.empty_vault(spark), _key(spark))
    return out.select("row_id", "parsed", "redactions", F.when(~F.col("parsed"), F.sha2("outgoing", 256)).alias("digest"),
                      (F.col("outgoing") == F.col("value")).alias("unchanged"))


ODD_LINES = (f"WITH {PROMPT_SERIOUS}, {vault_sql('row_id')}, {spliced_sql('row_id')} SELECT row_id, row_id % 2 = 0 AS parsed, n AS redactions, "
             "CASE WHEN row_id % 2 = 1 THEN sha256('log: ' || coalesce(r.text, '')) END AS digest, n = 0 AS unchanged FROM redacted r")

QUERIES = {
    "placeholders": (placeholders, f"WITH {SERIOUS}, {vault_sql()} SELECT placeholder, {fp('secret')} AS fingerprint FROM vault"),
    "placeholder_stems": (placeholder_stems, f"WITH {SERIOUS}, {vault_sql()} SELECT {fp('secret')} AS fingerprint, {duck.kind('rule_id')} AS kind, stem FROM digested"),
    "known_secrets_kept": (known_secrets_kept, KNOWN_SECRETS),
    "redacted_documents": (redacted_documents, REDACTED + "SELECT doc_id, sha256(text) AS digest, n AS replaced FROM redacted"),
    "masking_odd_keys": (masking_odd_keys, ODD_KEYS),
    "roundtrip_mismatches": (roundtrip_mismatches, ROUNDTRIP),
    "rescan_of_redacted": (rescan_of_redacted, "SELECT 0 AS findings"),
    "rehydrate_warnings": (rehydrate_warnings, BENT + " SELECT doc_id, len(list_aggregate(list_slice(regexp_split_to_array(text, 'MASKED_[A-Za-z0-9_]*'), 1, i), 'string_agg', '')) "
                           "+ len(list_aggregate(list_slice(regexp_extract_all(text, 'MASKED_[A-Za-z0-9_]*'), 1, i), 'string_agg', '')) - len(token) AS start_at, token, kind FROM kinds"),
    "rehydrate_counts": (rehydrate_counts, BENT + " SELECT b.doc_id, count(*) FILTER (kind = 'exact') AS substituted, "
                         "count(*) FILTER (kind <> 'exact') AS warnings FROM bent b LEFT JOIN kinds k USING (doc_id) GROUP BY b.doc_id"),
    "tokens_of_one_stem": (tokens_of_one_stem, ONE_STEM),
    "tool_results": (tool_results, BENT + ", per AS (SELECT b.doc_id, count(*) FILTER (kind = 'exact') AS substituted, count(*) FILTER (kind <> 'exact') AS warnings "
                     "FROM bent b LEFT JOIN kinds k USING (doc_id) GROUP BY b.doc_id) SELECT doc_id, substituted, CASE WHEN warnings > 0 THEN 'warning' "
                     "WHEN substituted > 0 THEN 'restored ' || substituted || ' value(s)' END AS context FROM per"),
    "vault_live": (vault_live, VAULT_LIVE),
    "locked_files": (locked_files, LOCKED),
    "unlocked_files": (unlocked_files, UNLOCKED),
    "unlocked_odd_paths": (unlocked_odd_paths, UNLOCKED_ODD_PATHS),
    "json_leaf_redaction": (json_leaf_redaction, JSON_LEAVES),
    "nested_redaction": (nested_redaction, REDACTED + "SELECT doc_id, n AS redactions, sha256(r.text) AS digest, source, doc_id AS number FROM redacted r JOIN docs d USING (doc_id)"),
    "message_guard": (message_guard, MESSAGES),
    "message_odd_lines": (message_odd_lines, ODD_LINES),
}
