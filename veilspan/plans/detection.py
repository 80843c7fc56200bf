"""Registered queries: detection, suppression, baseline and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.predicates import is_placeholder_value
from ..functions.text import fingerprint, is_real_jwt, shannon_entropy
from ..operators import baseline as B, reports as R, score as S
from ..operators.detect import rule_spans
from ..operators.joins import cut_lineage, gone_at_end, shared_folder
from ..operators.scan import blocking, findings_table, is_blocking, scan_df
from ..options import ScanOptions
from ..rules.catalogue import BUILTIN, Rule
from ..rules.table import rules_df
from ..sources.files import staged
from ..sources.samples import look_alike_sql
from . import duck
from .inputs import PRAGMA_SQL, evaluated, evaluated_sql, labelled, labelled_sql, plain_sql, table

SALT = "0123456789abcdef"
DEFAULT = ScanOptions()
GENERIC_ONLY = DEFAULT.but(disabled=tuple(r.id for r in BUILTIN if r.id != "generic-api-key"), entropy_enabled=False)
PREFIXED_IDS = ("aws-access-key-id", "github-pat-classic", "gitlab-pat", "npm-access-token", "huggingface-token",
                "stripe-secret-key", "mailgun-api-key")
PREFIXED = DEFAULT.but(disabled=tuple(r.id for r in BUILTIN if r.id not in PREFIXED_IDS), entropy_enabled=False)
ENTROPY_ONLY = DEFAULT.but(disabled=tuple(r.id for r in BUILTIN))
ALLOW_PATTERNS = ("^gh[pousr]_", "^sk_live_")
ALLOWING = DEFAULT.but(allow_patterns=ALLOW_PATTERNS + ("(unclosed",), allow_paths=("**/vendor/**",))
MAIL = Rule("mail-address", "mail", "Mail address", r"\b([a-z]+\.\d+@mail\d\.[a-z]+)\b", ("@mail",), 1, None, "high")
WITH_MAIL = DEFAULT.but(custom=(MAIL,))


def fp(value: str) -> str:
    return f"substring(sha256('{SALT} ' || {value}), 1, 32)"


FINDING_ROW = ["doc_id", "rule_id", "provider", "start_at", "end_at", "confidence", "entropy", "status", "note", "fingerprint"]


def _rows(findings, *more):
    return (findings.withColumn("fingerprint", fingerprint(F.col("match"), SALT)).withColumn("entropy", F.round("entropy", 6))
            .withColumnsRenamed({"start": "start_at", "end": "end_at"}).select(*FINDING_ROW, *more))


def _rows_sql(ctes: str, more: str = "", where: str = "TRUE") -> str:
    return (f"WITH {ctes} SELECT doc_id, rule_id, provider, start_at, end_at, confidence, round(entropy, 6) AS entropy, "
            f"status, note, {fp('match')} AS fingerprint{more} FROM findings WHERE {where}")


def doc_scan_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return (scan_df(docs, "text").groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"),
        F.count_if(F.size("findings") > 0).alias("docs_with_findings"),
        F.sum(F.size("findings")).alias("findings"), F.sum(F.size("suppressed")).alias("suppressed"),
        F.sum(F.size(blocking(F.col("findings"), DEFAULT))).alias("blocking")))


DOC_SCAN_SUMMARY = f"""WITH {plain_sql()}, {duck.findings('docs')},
per AS (SELECT doc_id, count(*) FILTER (status = 'active') AS a, count(*) FILTER (status = 'suppressed') AS s,
        count(*) FILTER (serious) AS b FROM findings GROUP BY doc_id)
SELECT lang, count(*) AS docs, CAST(sum(len(text)) AS BIGINT) AS chars, count(*) FILTER (a > 0) AS docs_with_findings,
  CAST(coalesce(sum(a), 0) AS BIGINT) AS findings, CAST(coalesce(sum(s), 0) AS BIGINT) AS suppressed,
  CAST(coalesce(sum(b), 0) AS BIGINT) AS blocking FROM docs LEFT JOIN per USING (doc_id) GROUP BY lang"""


def page_scan_summary(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return scan_df(pages, "html").agg(F.count("*").alias("pages"), F.sum(F.size("findings")).alias("findings"),
                                      F.sum(F.size("suppressed")).alias("suppressed"))


PAGE_SCAN_SUMMARY = f"""WITH docs AS (SELECT page_id AS doc_id, html AS text FROM pages), {duck.findings('docs')}
SELECT (SELECT count(*) FROM docs) AS pages, count(*) FILTER (status = 'active') AS findings,
  count(*) FILTER (status = 'suppressed') AS suppressed FROM findings"""


def generic_credential_findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _rows(findings_table(scan_df(docs, "text", GENERIC_ONLY), ["doc_id"]))


def labelled_findings(spark, sf_dir):
    docs = labelled(spark, sf_dir).select("doc_id", "text")
    return _rows(findings_table(scan_df(docs, "text"), ["doc_id"]))


def prefixed_token_findings(spark, sf_dir):
    docs = labelled(spark, sf_dir).select("doc_id", "text")
    return _rows(findings_table(scan_df(docs, "text", PREFIXED), ["doc_id"]))


def custom_rule_findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _rows(findings_table(scan_df(docs, "text", WITH_MAIL), ["doc_id"]))


def rule_matches(spark, sf_dir):
    """Matches per rule before overlaps are resolved, for every rule of the catalogue."""
    docs = labelled(spark, sf_dir).select("text")
    spans = docs.select(F.explode(rule_spans(F.col("text"), DEFAULT)).alias("s"))
    hits = spans.groupBy(F.col("s.rule_id").alias("id")).agg(F.count("*").alias("matches"))
    return (rules_df(spark).join(F.broadcast(hits), "id", "left")
            .select(F.col("id").alias("rule_id"), "provider", "description", "confidence", F.coalesce("matches", F.lit(0)).alias("matches")))


RULE_MATCHES = (f"WITH {labelled_sql()}, {duck.findings('docs')}, rules(rule_id, provider, description, confidence) AS (VALUES "
                + ", ".join(f"({duck.lit(r.id)}, {duck.lit(r.provider)}, {duck.lit(r.description)}, {duck.lit(r.confidence)})" for r in BUILTIN)
                + ") SELECT rules.*, count(raw.rule_id) AS matches FROM rules LEFT JOIN raw ON raw.rule_id = rules.rule_id GROUP BY ALL")


def rule_inventory(spark, sf_dir):
    """Rules and distinct texts hit per provider."""
    docs = labelled(spark, sf_dir).select("doc_id", "text")
    hit = (scan_df(docs, "text").select("doc_id", F.explode("findings").alias("f"))
           .groupBy(F.col("f.provider").alias("provider"), "doc_id").count()
           .groupBy("provider").agg(F.count("*").alias("texts")))
    listing = R.rules_by_provider(rules_df(spark)).select("provider", "rules", F.array_join("ids", ",").alias("ids"))
    return listing.join(hit, "provider", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))


RULE_INVENTORY = (f"WITH {labelled_sql()}, {duck.findings('docs')}, rules(id, provider) AS (VALUES "
                  + ", ".join(f"({duck.lit(r.id)}, {duck.lit(r.provider)})" for r in BUILTIN)
                  + "), hit AS (SELECT provider, count(DISTINCT doc_id) AS texts FROM findings WHERE status = 'active' GROUP BY provider)"
                  " SELECT provider, count(*) AS rules, string_agg(id, ',' ORDER BY id) AS ids, coalesce(any_value(texts), 0) AS texts"
                  " FROM rules LEFT JOIN hit USING (provider) GROUP BY provider")


def overlap_resolved(spark, sf_dir):
    """Per rule: matches found, and findings kept after overlaps and the entropy layer."""
    docs = labelled(spark, sf_dir).select("doc_id", "text")
    raw = docs.select(F.explode(rule_spans(F.col("text"), DEFAULT)).alias("s")).groupBy("s.rule_id").agg(F.count("*").alias("found"))
    kept = findings_table(scan_df(docs, "text"), ["doc_id"]).groupBy("rule_id").agg(F.count("*").alias("kept"))
    return (kept.join(raw, "rule_id", "full").select(
        "rule_id", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("kept", F.lit(0)).alias("kept")))


OVERLAP_RESOLVED = f"""WITH {labelled_sql()}, {duck.findings('docs')},
f AS (SELECT rule_id, count(*) AS found FROM raw GROUP BY 1), k AS (SELECT rule_id, count(*) AS kept FROM findings GROUP BY 1)
SELECT rule_id, coalesce(found, 0) AS found, coalesce(kept, 0) AS kept FROM f FULL JOIN k USING (rule_id)"""


def entropy_candidates(spark, sf_dir):
    docs = labelled(spark, sf_dir).select("doc_id", "text")
    return _rows(findings_table(scan_df(docs, "text", ENTROPY_ONLY), ["doc_id"]))


def _tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \n]")).alias("token"))
    own = labelled(spark, sf_dir).select(F.col("expected_secret").alias("token"))
    return docs.unionByName(own).distinct()


TOKENS = (f"{labelled_sql()}, tokens AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]')) AS token FROM documents "
          "UNION SELECT expected_secret FROM docs)")


def char_entropy(spark, sf_dir):
    """Entropy of every distinct token."""
    return _tokens(spark, sf_dir).select("token", F.round(shannon_entropy(F.col("token")), 6).alias("entropy"))


def placeholder_values(spark, sf_dir):
    """Distinct tokens, and stand-ins made of them, that are no credentials."""
    made = F.explode(F.array(F.col("token"), F.concat(F.lit("my-secret-"), "token"), F.concat(F.lit("process.env."), "token"),
                             F.concat(F.lit("<"), "token", F.lit(">"))))
    return _tokens(spark, sf_dir).select(made.alias("value")).filter(is_placeholder_value(F.col("value"))).distinct()


PLACEHOLDER_VALUES = f"""WITH {TOKENS}, made AS (SELECT DISTINCT unnest([token, 'my-secret-' || token, 'process.env.' || token, '<' || token || '>']) AS value FROM tokens)
SELECT value FROM made WHERE {duck.placeholder_value('value')}"""


def suppression_ladder(spark, sf_dir):
    """Pragma, allowlists and test paths: every finding with its verdict and line."""
    docs = labelled(spark, sf_dir).select("doc_id", "path", F.concat("text", F.expr(PRAGMA_SQL)).alias("text"))
    return _rows(findings_table(scan_df(docs, "text", ALLOWING, "path"), ["doc_id"], "text"), "line")


def _noted(note):
    def query(spark, sf_dir):
        return suppression_ladder(spark, sf_dir).filter(F.col("note") == note)
    return query


LADDER_CTES = (labelled_sql(PRAGMA_SQL) + ", " + duck.findings("docs", path="path", allow_patterns=ALLOW_PATTERNS,
                                                               allow_path_regex="(?:^|/)(?:.*/)?vendor/.*$"))


def finding_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = findings_table(scan_df(docs, "text"), ["doc_id"], "text")
    return rows.select("doc_id", "rule_id", "line", F.col("start").alias("start_at"))


def jwt_valid(spark, sf_dir):
    docs = labelled(spark, sf_dir)
    return docs.select("doc_id", is_real_jwt(F.col("expected_secret")).alias("valid"))


JWT_VALID = (f"WITH {labelled_sql()} SELECT doc_id, CASE WHEN starts_with(match, 'eyJ') THEN {duck.VALIDATORS['jwt']} ELSE FALSE END AS valid "
             "FROM (SELECT doc_id, expected_secret AS match FROM docs)")


# --- baseline ----------------------------------------------------------------------------

def _serious(spark, sf_dir):
    docs = labelled(spark, sf_dir).select("doc_id", "path", "text")
    rows = findings_table(scan_df(docs, "text"), ["doc_id", "path"], "text").filter("status = 'active'")
    return rows.filter(is_blocking(F.struct("rule_id", "confidence"), DEFAULT))


SERIOUS = f"{labelled_sql()}, {duck.findings('docs')}, serious AS (SELECT f.*, path FROM findings f JOIN docs USING (doc_id) WHERE serious)"


def fingerprints(spark, sf_dir):
    return _serious(spark, sf_dir).select("doc_id", fingerprint(F.col("match"), SALT).alias("fingerprint"))


def _baseline(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    # Written once, as a stored baseline would be.
    return cut_lineage(B.build_baseline(_serious(spark, sf_dir).join(good, "doc_id", "left_semi"), "path", SALT))


BASELINE = f"""{SERIOUS}, baseline AS (SELECT {fp('match')} AS fingerprint, arg_max(path || ':' || line || ' ' || rule_id, (path, start_at)) AS hint
  FROM serious WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1)"""


def baseline_build(spark, sf_dir):
    return _baseline(spark, sf_dir)


def baseline_new_findings(spark, sf_dir):
    new = B.new_findings(_serious(spark, sf_dir), _baseline(spark, sf_dir), SALT, ["doc_id", "start"])
    return new.select("doc_id", "rule_id", F.col("start").alias("start_at"), "fingerprint")


BASELINE_NEW = f"WITH {BASELINE} SELECT doc_id, rule_id, start_at, {fp('match')} AS fingerprint FROM serious WHERE {fp('match')} NOT IN (SELECT fingerprint FROM baseline)"


def baseline_suppressed(spark, sf_dir):
    """Findings per verdict once a baseline is applied to the scanned rows."""
    docs = labelled(spark, sf_dir).select("doc_id", "path", "text")
    done = B.with_baseline(scan_df(docs, "text", DEFAULT, "path").drop("text"), _baseline(spark, sf_dir), SALT, ["doc_id"])
    rows = findings_table(done, ["doc_id"])
    return rows.groupBy("status", "note", "confidence").agg(F.count("*").alias("findings"))


BASELINE_SUPPRESSED = f"""WITH {BASELINE}, {duck.findings('docs', path='path').replace('raw AS', 'raw_p AS').replace('raw a', 'raw_p a').replace('raw b', 'raw_p b').replace('won', 'pwon').replace('rest', 'prest').replace('structured', 'pstructured').replace('candidates', 'pcandidates').replace('noted', 'pnoted').replace('findings AS', 'pfindings AS')},
given(rule_id, given) AS (VALUES {', '.join(f"('{r.id}', '{r.confidence}')" for r in BUILTIN)}),
judged AS (SELECT pfindings.*, given, note IS DISTINCT FROM 'placeholder value' AND {fp('match')} IN (SELECT fingerprint FROM baseline) AS ok FROM pfindings LEFT JOIN given USING (rule_id))
SELECT CASE WHEN ok THEN 'suppressed' ELSE status END AS status, CASE WHEN ok THEN 'accepted in baseline' ELSE note END AS note,
  CASE WHEN ok AND note = 'test/fixture path' THEN given ELSE confidence END AS confidence, count(*) AS findings FROM judged GROUP BY ALL"""


def baseline_rebuild(spark, sf_dir):
    """Build a stored baseline from some documents, rebuild it from all, read it back: what each entry accepts."""
    folder = f"{shared_folder(spark)}/baseline-{uuid.uuid4().hex}"
    gone_at_end(spark, folder)
    serious = cut_lineage(_serious(spark, sf_dir).select("doc_id", "path", "rule_id", "start", "match", "line"))
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    store = B.BaselineStore(spark, folder)
    store.rebuild(serious.join(good, "doc_id", "left_semi"), "path")
    first, _ = store.load()
    version, _ = store.rebuild(serious, "path")
    salt, entries = store.load()
    used = serious.groupBy(fingerprint(F.col("match"), salt).alias("fingerprint")).agg(F.count("*").alias("findings"))
    return (entries.join(used, "fingerprint", "full")
            .select("hint", "findings", F.lit(salt != first and len(salt) == 32).alias("fresh_salt"), F.lit(version).alias("version")))


BASELINE_REBUILD = (f"WITH {SERIOUS} SELECT arg_max(path || ':' || line || ' ' || rule_id, (path, start_at)) AS hint, count(*) AS findings, "
                    "TRUE AS fresh_salt, 2 AS version FROM serious GROUP BY match")


# --- reports -----------------------------------------------------------------------------

def provider_summary(spark, sf_dir):
    return R.provider_counts(_serious(spark, sf_dir), ["doc_id"])


PROVIDER_SUMMARY = f"""WITH {SERIOUS}, per AS (SELECT doc_id, provider, count(*) AS n, min(start_at) AS first FROM serious GROUP BY 1, 2)
SELECT doc_id, string_agg(CASE WHEN n > 1 THEN n || 'x ' || provider ELSE provider END, ', ' ORDER BY first, provider) AS providers,
  CAST(sum(n) AS BIGINT) AS findings FROM per GROUP BY doc_id"""


def secret_reuse(spark, sf_dir):
    """Secrets of the turns of all conversations; turn numbers repeat, so secrets do."""
    from ..sources.samples import with_samples
    turns = with_samples(table(spark, sf_dir, "conversations"), "turn")
    rows = findings_table(scan_df(turns.select("conv_id", "turn", "text"), "text"), ["conv_id", "turn"])
    return R.secret_reuse(rows.filter("status = 'active'"), ["conv_id"], SALT)


SECRET_REUSE = (f"WITH {labelled_sql(key='turn', columns='conv_id * 1000 + turn AS doc_id, conv_id', where_from='conversations')}, {duck.findings('docs')} "
                f"SELECT {fp('match')} AS fingerprint, count(*) AS findings, count(DISTINCT conv_id) AS places FROM findings JOIN docs USING (doc_id) "
                "WHERE status = 'active' GROUP BY 1")


def file_report(spark, sf_dir):
    rows = _serious(spark, sf_dir)
    return R.report_rows(rows, "path")


FILE_REPORT = f"WITH {SERIOUS} SELECT path AS file, line, rule_id, provider, confidence FROM serious WHERE path NOT LIKE '%/.env'"


def scan_totals(spark, sf_dir):
    docs = scan_df(labelled(spark, sf_dir).select("path", "text"), "text")
    return R.scan_totals(docs.withColumn("serious", blocking(F.col("findings"), DEFAULT)), "serious", "path")


SCAN_TOTALS = f"""WITH {SERIOUS}, per AS (SELECT d.path, count(s.doc_id) AS n FROM docs d LEFT JOIN serious s ON s.doc_id = d.doc_id GROUP BY d.path)
SELECT count(*) AS scanned, CAST(sum(n) FILTER (path NOT LIKE '%/.env') AS BIGINT) AS findings, count(*) FILTER (path LIKE '%/.env' AND n > 0) AS stores FROM per"""


def store_exposure(spark, sf_dir):
    per = _serious(spark, sf_dir).groupBy("path").agg(F.count("*").alias("credentials"))
    ignored = labelled(spark, sf_dir).filter("path LIKE '%/config/%'").select("path")
    return R.store_exposure(per, ignored, ~F.contains("path", F.lit("/vendor/")))


STORE_EXPOSURE = f"""WITH {SERIOUS}, s AS (SELECT path, count(*) AS credentials FROM serious WHERE path LIKE '%/.env' GROUP BY path),
v AS (SELECT *, CASE WHEN contains(path, '/vendor/') THEN 'no-repo' WHEN contains(path, '/config/') THEN 'ignored' ELSE 'exposed' END AS status FROM s)
SELECT *, status = 'exposed' AS exposed FROM v"""


def staged_findings(spark, sf_dir):
    """Findings in the files a change list adds or modifies; the labels table serves as the list."""
    files = labelled(spark, sf_dir).select("path", "text", "doc_id")
    manifest = (files.join(table(spark, sf_dir, "labels"), "doc_id")
                .select("path", F.when(F.col("quality") == 1, "M").otherwise("D").alias("status")))
    rows = findings_table(scan_df(staged(files, manifest), "text"), ["path"], "text").filter("status = 'active'")
    return rows.filter(is_blocking(F.struct("rule_id", "confidence"), DEFAULT)).select("path", "line", "rule_id", "provider")


STAGED = f"WITH {SERIOUS} SELECT path, line, rule_id, provider FROM serious WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"


# --- scoring -----------------------------------------------------------------------------

KINDS = ("kind",)


def _counts(spark, sf_dir):
    """Counts per text and kind; a document counts twice, with its sample and with what it holds of itself."""
    hits = F.transform(blocking(F.col("findings"), DEFAULT), lambda f: f["match"])
    positive, negative, mixed = [scan_df(t, "text").withColumn("hits", hits).drop("text", "findings", "suppressed") for t in evaluated(spark, sf_dir)]
    # Scanned once, counted twice.
    twice = positive.select("*", F.explode(F.array(F.lit("sample"), F.lit("own"))).alias("kind"))
    return (S.positive_counts(twice.where("kind = 'sample'"), "hits", "expected_secret", "own", KINDS)
            .unionByName(S.found_counts(twice.where("kind = 'own'"), "hits", "own", KINDS))
            .unionByName(S.negative_counts(negative.withColumn("kind", F.lit("look-alike")), "hits", KINDS))
            .unionByName(S.mixed_counts(mixed.withColumn("kind", F.lit("message")), "hits", "expected_secrets", KINDS)))


def _rounded(score, *by):
    return score.select(*by, *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")],
                        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def detection_scores(spark, sf_dir):
    return _rounded(S.scores(_counts(spark, sf_dir)))


def detection_scores_by_kind(spark, sf_dir):
    return _rounded(S.scores(_counts(spark, sf_dir), KINDS), "kind")


SCORES = f"""{evaluated_sql()}, {duck.findings('docs', key='id')},
hit AS (SELECT id, list(match ORDER BY start_at) AS hits FROM findings WHERE serious GROUP BY id),
per AS (SELECT kind, expected, own, coalesce(hits, CAST([] AS VARCHAR[])) AS hits FROM docs LEFT JOIN hit USING (id)),
claims AS (SELECT *, list_filter(list_transform(expected, lambda e: list_filter(hits, lambda h: contains(h, e) OR contains(e, h))[1]), lambda c: c IS NOT NULL) AS claimed FROM per),
counts AS (
  SELECT kind, len(claimed) AS tp, CASE WHEN len(claimed) = 0 THEN 0 ELSE len(list_filter(hits, lambda h: len(list_filter(list_concat(expected, own),
    lambda e: contains(h, e) OR contains(e, h))) = 0)) END AS fp, len(expected) - len(claimed) AS fn FROM claims WHERE kind = 'sample'
  UNION ALL SELECT 'own', len(list_filter(own, lambda e: len(list_filter(hits, lambda h: contains(h, e) OR contains(e, h))) > 0)) AS found, 0, len(own) - found
    FROM claims WHERE kind = 'sample'
  UNION ALL SELECT kind, len(claimed), len(list_filter(hits, lambda h: NOT list_contains(claimed, h))), len(expected) - len(claimed) FROM claims WHERE kind <> 'sample'),
sums AS (SELECT kind, CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn
  FROM counts GROUP BY GROUPING SETS ((kind), ())),
score AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM sums)"""
RATED = "tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM score"
DETECTION_SCORES = f"WITH {SCORES} SELECT {RATED} WHERE kind IS NULL"
DETECTION_SCORES_BY_KIND = f"WITH {SCORES} SELECT kind, {RATED} WHERE kind IS NOT NULL"


def look_alike_hits(spark, sf_dir):
    """Findings in texts that hold none of their own, by what looks like a credential there and how it was judged."""
    negative = evaluated(spark, sf_dir)[1]
    rows = scan_df(negative, "text").drop("text").withColumn("active", F.size("findings")).withColumn("serious", F.size(blocking(F.col("findings"), DEFAULT)))
    return rows.groupBy("look_alike").agg(F.count("*").alias("texts"), *[F.sum(c).alias(c) for c in ("active", "serious")], F.sum(F.size("suppressed")).alias("suppressed"))


LOOK_ALIKE_HITS = f"""WITH turns AS (SELECT *, conv_id * 1000 + turn AS row_id FROM conversations WHERE role IS DISTINCT FROM 'user'),
docs AS (SELECT row_id, {look_alike_sql('row_id', 'duckdb')['kind']} AS look_alike, text || chr(10) || {look_alike_sql('row_id', 'duckdb')['text']} AS text FROM turns),
{duck.findings('docs', key='row_id')},
per AS (SELECT row_id, count(*) FILTER (status = 'active') AS a, count(*) FILTER (serious) AS b, count(*) FILTER (status = 'suppressed') AS s FROM findings GROUP BY 1)
SELECT look_alike, count(*) AS texts, CAST(coalesce(sum(a), 0) AS BIGINT) AS active, CAST(coalesce(sum(b), 0) AS BIGINT) AS serious,
  CAST(coalesce(sum(s), 0) AS BIGINT) AS suppressed FROM docs LEFT JOIN per USING (row_id) GROUP BY 1"""


def score_gates(spark, sf_dir):
    score = S.scores(_counts(spark, sf_dir))
    metrics = score.select(F.explode(F.map_from_arrays(F.array(F.lit("precision"), F.lit("recall")), F.array("precision", "recall"))).alias("metric", "value"))
    return S.gates(metrics).select("metric", "passed")


SCORE_GATES = (f"WITH {SCORES} SELECT 'precision' AS metric, p >= 0.98 AS passed FROM score WHERE kind IS NULL "
               "UNION ALL SELECT 'recall', r >= 0.90 FROM score WHERE kind IS NULL")


def latency_percentiles(spark, sf_dir):
    return S.nearest_rank(table(spark, sf_dir, "events"), "value", [0.5, 0.99], ["event_type"])


LATENCY = """SELECT event_type, s[CAST(floor(len(s) * 0.5) AS BIGINT) + 1] AS p50, s[CAST(floor(len(s) * 0.99) AS BIGINT) + 1] AS p99
FROM (SELECT event_type, list_sort(list(value)) AS s FROM events WHERE value IS NOT NULL GROUP BY 1)"""

PLAIN = f"{plain_sql('doc_id')}, "
QUERIES = {
    "doc_scan_summary": (doc_scan_summary, DOC_SCAN_SUMMARY),
    "page_scan_summary": (page_scan_summary, PAGE_SCAN_SUMMARY),
    "generic_credential_findings": (generic_credential_findings, _rows_sql(PLAIN + duck.findings(
        "docs", rules=[r for r in BUILTIN if r.id == "generic-api-key"], with_entropy=False))),
    "labelled_findings": (labelled_findings, _rows_sql(f"{labelled_sql()}, {duck.findings('docs')}")),
    "prefixed_token_findings": (prefixed_token_findings, _rows_sql(labelled_sql() + ", " + duck.findings(
        "docs", rules=[r for r in BUILTIN if r.id in PREFIXED_IDS], with_entropy=False))),
    "custom_rule_findings": (custom_rule_findings, _rows_sql(PLAIN + duck.findings("docs", rules=(MAIL, *BUILTIN)))),
    "rule_matches": (rule_matches, RULE_MATCHES),
    "rule_inventory": (rule_inventory, RULE_INVENTORY),
    "overlap_resolved": (overlap_resolved, OVERLAP_RESOLVED),
    "entropy_candidates": (entropy_candidates, _rows_sql(labelled_sql() + ", " + duck.findings("docs", rules=BUILTIN[:1]).replace(
        "structured AS (SELECT * FROM won0 UNION ALL SELECT * FROM won1 UNION ALL SELECT * FROM won2)",
        "structured AS (SELECT * FROM won0 WHERE FALSE)"))),
    "char_entropy": (char_entropy, f"WITH {TOKENS} SELECT token, round({duck.entropy('token')}, 6) AS entropy FROM tokens"),
    "placeholder_values": (placeholder_values, PLACEHOLDER_VALUES),
    "suppression_ladder": (suppression_ladder, _rows_sql(LADDER_CTES, ", line")),
    "pragma_suppressed": (_noted("veilspan:allow pragma"), _rows_sql(LADDER_CTES, ", line", "note = 'veilspan:allow pragma'")),
    "allowlist_suppressed": (_noted("allowlist pattern"), _rows_sql(LADDER_CTES, ", line", "note = 'allowlist pattern'")),
    "allowlisted_paths": (_noted("allowlisted path"), _rows_sql(LADDER_CTES, ", line", "note = 'allowlisted path'")),
    "test_path_downgraded": (_noted("test/fixture path"), _rows_sql(LADDER_CTES, ", line", "note = 'test/fixture path'")),
    "finding_lines": (finding_lines, f"WITH {PLAIN}{duck.findings('docs')} SELECT doc_id, rule_id, line, start_at FROM findings"),
    "jwt_valid": (jwt_valid, JWT_VALID),
    "fingerprints": (fingerprints, f"WITH {SERIOUS} SELECT doc_id, {fp('match')} AS fingerprint FROM serious"),
    "baseline_build": (baseline_build, f"WITH {BASELINE} SELECT * FROM baseline"),
    "baseline_new_findings": (baseline_new_findings, BASELINE_NEW),
    "baseline_rebuild": (baseline_rebuild, BASELINE_REBUILD),
    "baseline_suppressed": (baseline_suppressed, BASELINE_SUPPRESSED),
    "provider_summary": (provider_summary, PROVIDER_SUMMARY),
    "secret_reuse": (secret_reuse, SECRET_REUSE),
    "file_report": (file_report, FILE_REPORT),
    "scan_totals": (scan_totals, SCAN_TOTALS),
    "store_exposure": (store_exposure, STORE_EXPOSURE),
    "staged_findings": (staged_findings, STAGED),
    "detection_scores": (detection_scores, DETECTION_SCORES),
    "detection_scores_by_kind": (detection_scores_by_kind, DETECTION_SCORES_BY_KIND),
    "look_alike_hits": (look_alike_hits, LOOK_ALIKE_HITS),
    "score_gates": (score_gates, SCORE_GATES),
    "latency_percentiles": (latency_percentiles, LATENCY),
}
