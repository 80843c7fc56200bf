"""Labelled samples: credentials, and look-alikes that are none, derived from a row's id by a digest.

The same formula runs on Spark and, for checking, on any engine with SHA-256: it is a SQL
expression with two spellings of the digest.  No credential-shaped literal is stored; every
value is assembled from a prefix and digest characters when the query runs.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, functions as F

from ..rules.catalogue import BUILTIN

SEED = "veil"


@dataclass(frozen=True)
class Shape:
    provider: str
    rule_id: str
    name: str
    parts: tuple  # literals and (alphabet, length)
    before: str | None = None  # own surroundings instead of one of the contexts
    after: str = ""


def _part_of_jwt(**claims) -> str:
    return base64.urlsafe_b64encode(json.dumps(claims, separators=(",", ":")).encode()).decode().rstrip("=")


def _token(rule_id: str, *parts) -> Shape:
    """A value that stands by itself: it is put into one of the contexts, under the rule's name."""
    return Shape(PROVIDERS[rule_id], rule_id, rule_id.replace("-", "_"), parts)


def _placed(rule_id: str, before: str, parts: tuple, after: str = "") -> Shape:
    """A value that its rule knows by what stands around it."""
    return Shape(PROVIDERS[rule_id], rule_id, "", parts, before, after)


PROVIDERS = {r.id: r.provider for r in BUILTIN}
LETTERS, HEX, DIGITS, CAPITALS, BASE64 = "alnum", "hex", "digits", "upper", "base64"
BACKSLASH = "\x1e"  # stands for one: engines differ in how they read it in a literal

# Derived from the rules: for each a value that its pattern takes, in the order of the rules' names.
SHAPES = (
    _token("anthropic-api-key", "sk-ant-api07-", (LETTERS, 93)),
    _placed("authorization-header", "Authorization: Bearer ", ((LETTERS, 44),)),
    _token("aws-access-key-id", "AKIA", (CAPITALS, 16)),
    _token("aws-access-key-id", "ABIA", (CAPITALS, 16)),
    _placed("aws-secret-access-key", "export AWS_SECRET_ACCESS_KEY=\"", ((BASE64, 40),), '"'),
    _placed("aws-session-token", "AWS_SESSION_TOKEN=", ((BASE64, 110),)),
    _token("azure-ad-client-secret", (LETTERS, 3), "8Q~", (LETTERS, 33)),
    _placed("azure-storage-key", "AccountName=archive;AccountKey=", ((BASE64, 86), "=="), ";"),
    _placed("basic-auth-url", "fetched from https://mirror:", ((LETTERS, 18),), "@files.example.org/list"),
    _placed("bitbucket-client-secret", 'bitbucket.client.secret = "', ((LETTERS, 64),), '"'),
    _placed("cloudflare-api-token", "cloudflare_token = \"", ((LETTERS, 40),), '"'),
    _placed("cohere-api-key", "COHERE_KEY = \"", ((LETTERS, 40),), '"'),
    _placed("curl-user-flag", "curl --user mirror:", ((LETTERS, 21),), " ftp://files.example.org"),
    _placed("datadog-api-key", "DATADOG_API_KEY = \"", ((HEX, 32),), '"'),
    _placed("db-connection-string", "mysql://report:", ((LETTERS, 22),), "@replica.example.org/sales"),
    _placed("db-connection-string", "amqps://queue:", ((LETTERS, 17),), "@broker.example.org/jobs"),
    _token("digitalocean-token", "dop_v1_", (HEX, 64)),
    _token("discord-bot-token", "N", (LETTERS, 23), ".", (LETTERS, 6), ".", (LETTERS, 27)),
    _token("gcp-api-key", "AIza", (LETTERS, 35)),
    _token("gcp-oauth-client-secret", "GOCSPX-", (LETTERS, 28)),
    _placed("gcp-service-account-key", '{"type": "service_account", "project_id": "archive", "private_key": "',
            ("-----BEGIN PRIVATE", f" KEY-----{BACKSLASH}n", (BASE64, 64), f"{BACKSLASH}n-----END PRIVATE", f" KEY-----{BACKSLASH}n"), '"}'),
    _placed("generic-api-key", 'refresh_token: "', ((LETTERS, 28),), '"'),
    _placed("generic-env-assignment", "export QUEUE_PASSWORD=", ((LETTERS, 22),)),
    _placed("generic-yaml-assignment", "relay.password: ", ((LETTERS, 26),)),
    _token("github-app-jwt-key", "ghs_", (LETTERS, 36)),
    _token("github-pat-classic", "ghu_", (LETTERS, 36)),
    _token("github-pat-classic", "ghr_", (LETTERS, 36)),
    _token("github-pat-fine-grained", "github_pat_", (LETTERS, 82)),
    _token("gitlab-pat", "glpat-", (LETTERS, 26)),
    _token("gitlab-runner-token", "GR1348941", (LETTERS, 20)),
    _token("groq-api-key", "gsk_", (LETTERS, 52)),
    _placed("heroku-api-key", "heroku_key=", ((HEX, 8), "-5d21-4e7b-8c60-", (HEX, 12))),
    _token("huggingface-token", "hf_", (LETTERS, 36)),
    _placed("jdbc-password", "jdbc:mariadb://replica.example.org/sales;password=", ((LETTERS, 19),), ";ssl=true"),
    _placed("jwt", "cookie: session=", (_part_of_jwt(typ="JWT", alg="HS512"), ".", _part_of_jwt(iss="login.example.org", uid=71), ".", (LETTERS, 86))),
    _token("mailgun-api-key", "key-", (HEX, 32)),
    _placed("mongodb-srv-password", "mongodb+srv://report:", ((LETTERS, 20),), "@archive.k2x4q.mongodb.net/log"),
    _token("new-relic-license-key", "NRAK-", (CAPITALS, 27)),
    _token("npm-access-token", "npm_", (LETTERS, 36)),
    _placed("npmrc-auth-token", "//packages.example.org/:_authToken=", ((LETTERS, 30),)),
    _token("openai-api-key", "sk-svcacct-", (LETTERS, 58)),
    _token("openrouter-api-key", "sk-or-v1-", (HEX, 64)),
    _placed("private-key-block", "found on the retired build host\n",
            ("-----BEGIN EC PRIVATE", " KEY-----\n", (BASE64, 64), "\n", (BASE64, 44), "\n-----END EC PRIVATE", " KEY-----"), "\n"),
    _placed("private-key-header-only", "the paste begins with\n", ("-----BEGIN PGP PRIVATE", " KEY BLOCK-----"), "\nand was cut there"),
    _token("pypi-upload-token", "pypi-AgEIcHlwaS5vcmc", (LETTERS, 70)),
    _token("replicate-api-token", "r8_", (LETTERS, 38)),
    _token("sendgrid-api-key", "SG.", (LETTERS, 22), ".", (LETTERS, 43)),
    _token("shopify-access-token", "shppa_", (HEX, 32)),
    _token("slack-app-token", "xapp-2-", (CAPITALS, 11), "-", (DIGITS, 12), "-", (HEX, 64)),
    _token("slack-bot-token", "xoxp-", (DIGITS, 11), "-", (LETTERS, 30)),
    _token("slack-webhook-url", "https://hooks.slack.com/services/T", (CAPITALS, 9), "/B", (CAPITALS, 9), "/", (LETTERS, 24)),
    _token("square-access-token", "sq0csp-", (LETTERS, 40)),
    _placed("ssh-authorized-key-with-private-material", "saved by the old client\n",
            ("PuTTY-User-Key-File-3: ssh-ed25519\nEncryption: aes256-cbc\nPublic-Lines: 1\n", (BASE64, 64), "\nPrivate-Lines:"), " 1\n"),
    _token("stripe-secret-key", "rk_live_", (LETTERS, 30)),
    _token("supabase-service-role-key", "sbp_", (HEX, 40)),
    _token("telegram-bot-token", (DIGITS, 9), ":AA", (LETTERS, 33)),
    _token("twilio-api-key", "SK", (HEX, 32)),
    _placed("vercel-token", "VERCEL_TOKEN = \"", ((LETTERS, 24),), '"'),
)

# (before, after, name in capitals); ``{}`` stands for the name.
CONTEXTS = (
    ("set {} to ", " before the first run", False),
    ("-D{}=", " -jar service.jar", False),
    ('{} := "', '"', False),
    ("| {} | ", " | yes |", True),
    ("it fails with ", ", please look", False),
    ('[{}]\nvalue = "', '"', False),
    ("({}) ", " for the tests", False),
    ("unset {}; ", " was the old one", True),
)

# What looks like a credential and is none, by what it is.
LOOK_ALIKES = (
    ("commit", ("reverted in commit ", (HEX, 40), " last week")),
    ("short commit", ("* ", (HEX, 7), " (main) loader: wait before the next try")),
    ("request id", ("request ", (HEX, 8), "-4c1d-4", (HEX, 3), "-9a0b-c2", (HEX, 10), " took 3 s")),
    ("braced id", ("class {", (CAPITALS, 8), "-5A7D-4C1B-9E20-", (CAPITALS, 12), "} is registered")),
    ("image digest", ("image: registry.example.org/loader@sha256:", (HEX, 64))),
    ("lock file", ('"integrity": "sha512-', (BASE64, 86), '=="')),
    ("checksum", ('checksum = "', (HEX, 64), '"')),
    ("checksum list", ((HEX, 32), "  readme.txt\n", (HEX, 32), "  notes.txt")),
    ("module sum", ("example.org/loader v1.4.2 h1:", (BASE64, 43), "=")),
    ("public key", ("ssh-ed25519 AAAAC3NzaC1lZDI1NTE5AAAAI", (BASE64, 43), " build@host")),
    ("public block", ("-----BEGIN PUBLIC KEY-----\n", (BASE64, 64), "\n-----END PUBLIC KEY-----")),
    ("certificate", ("-----BEGIN CERTIFICATE-----\n", (BASE64, 64), "\n-----END CERTIFICATE-----")),
    ("page tag", ('ETag: "', (HEX, 40), '"')),
    ("trace", ("traceparent: 00-", (HEX, 32), "-", (HEX, 16), "-01")),
    ("picture", ('src="data:image/png;base64,iVBORw0KGgo', (BASE64, 100), '"')),
    ("script file", ("static/parts/index-", (HEX, 16), ".js is too large")),
    ("build name", ('"buildId": "', (LETTERS, 20), '"')),
    ("row ids", ("rows = [1", (DIGITS, 18), ", 1", (DIGITS, 18), "]")),
    ("hashed word", ("hash: $2b$12$", (LETTERS, 53))),
    ("session id", ("session=", (HEX, 32), "; path=/")),
    ("template", ("QUEUE_PASSWORD=<paste the password here>",)),
    ("template word", ("API_TOKEN=your-token-goes-here",)),
    ("variable", ("postgres://report:$REPORT_PASSWORD@db.example.org/sales",)),
    ("reference", ("password = var.queue_password",)),
    ("address", ("redis://cache.example.org:6379/0",)),
    ("secret name", ("secretKeyRef:\n  name: queue-credentials\n  key: password",)),
    ("masked", ("token: MASKED_GITHUB_TOKEN_", (CAPITALS, 4), " was put in its place")),
    ("first part of a token", ("its header reads ", _part_of_jwt(alg="HS256"), " and no more")),
    ("prose", ("The access token is read from the environment; it is never printed, nor is the password.",)),
    ("column names", ("SELECT id, password_hash, api_key_id FROM members WHERE seen > 7",)),
    ("licence line", ("SPDX-License-Identifier: MIT, build ", (DIGITS, 9))),
    ("punctuation", ("=" * 70,)),
)

# What a message asks before and after its parts.
ASKED = (
    ("It fails since this morning. What I run:", "What is missing?"),
    ("Please look over this before I send it:", "Anything that should not be there?"),
    ("From the log of the night:", "It then stops without a word."),
    ("Both machines are set up like this:", "Only one of them answers."),
    ("I found these notes:", "Which of them are still of use?"),
)

# Digest, base64 and array lookup in the two SQL dialects.
DIALECTS = {
    "spark": {"sha": "sha2({}, 256)", "base64": "base64(unhex({}))", "text": "CAST({} AS STRING)",
              "pick": "element_at(split({}, chr(31)), CAST({} AS INT) + 1)"},
    "duckdb": {"sha": "sha256({})", "base64": "to_base64(unhex({}))", "text": "CAST({} AS VARCHAR)",
               "pick": "string_split({}, chr(31))[CAST({} AS INT) + 1]"},
}
SLOTS = 3  # digest-filled parts per shape


def _slots(parts: tuple) -> tuple[list[str], list[tuple[str, int]]]:
    """The literals around, and the (alphabet, length) of, every slot."""
    literals, bodies = [""], []
    for part in parts:
        if isinstance(part, str):
            literals[-1] += part
        else:
            bodies.append(part)
            literals.append("")
    empty = SLOTS - len(bodies)
    return literals + [""] * empty, bodies + [("hex", 0)] * empty


def _picked(values, index: str, dialect: str) -> str:
    return DIALECTS[dialect]["pick"].format("'" + "\x1f".join(str(v) for v in values) + "'", index)


def _filled(layouts: list[tuple[list[str], list[tuple[str, int]]]], index: str, key: str, dialect: str, seed: str) -> str:
    """SQL of the layout at ``index``, its slots filled from digests of the key."""
    d = DIALECTS[dialect]

    def material(slot: int) -> dict[str, str]:
        digests = [d["sha"].format(f"'{seed}.{slot}.{n}:' || {d['text'].format(key)}") for n in range(3)]
        base64 = " || ".join(f"substring({d['base64'].format(x)}, 1, 43)" for x in digests)
        alnum = f"translate({base64}, '+/', 'kT')"
        hexa = " || ".join(digests[:2])
        return {"hex": hexa, "digits": f"translate({hexa}, 'abcdef', '123456')", "base64": base64,
                "alnum": alnum, "upper": f"upper({alnum})"}

    text = [_picked([literals[0] for literals, _ in layouts], index, dialect)]
    for slot in range(SLOTS):
        branches = " ".join(f"WHEN '{name}' THEN {sql}" for name, sql in material(slot).items())
        alphabet = _picked([bodies[slot][0] for _, bodies in layouts], index, dialect)
        length = _picked([bodies[slot][1] for _, bodies in layouts], index, dialect)
        text.append(f"substring(CASE {alphabet} {branches} END, 1, CAST({length} AS INT))")
        text.append(_picked([literals[slot + 1] for literals, _ in layouts], index, dialect))
    return f"replace({' || '.join(text)}, '{BACKSLASH}', chr(92))"


@cache
def sample_sql(key: str, dialect: str, secret_name: str = "secret") -> dict[str, str]:
    """SQL expressions ``provider``, ``rule_id``, ``secret`` and ``sample`` for an integer key.

    ``sample`` refers to a column ``secret_name`` holding the value of ``secret``.
    """
    shape = f"({key} % {len(SHAPES)})"
    context = f"(CAST(floor({key} / {len(SHAPES)}) AS BIGINT) % {len(CONTEXTS)})"

    def pick(values, index: str) -> str:
        return _picked(values, index, dialect)

    secret = _filled([_slots(s.parts) for s in SHAPES], shape, key, dialect, SEED)
    own = " || ".join([pick([s.before or "" for s in SHAPES], shape), secret_name, pick([s.after for s in SHAPES], shape)])
    name = pick([s.name for s in SHAPES], shape)
    cased = f"CASE {pick([c[2] for c in CONTEXTS], context)} WHEN 'True' THEN upper({name}) ELSE {name} END"
    embedded = (f"replace({pick([c[0] for c in CONTEXTS], context)}, '{{}}', {cased}) || {secret_name} || "
                f"{pick([c[1] for c in CONTEXTS], context)}")
    bare = pick([s.before is None for s in SHAPES], shape)
    return {"provider": pick([s.provider for s in SHAPES], shape),
            "rule_id": pick([s.rule_id for s in SHAPES], shape),
            "secret": secret,
            "sample": f"CASE {bare} WHEN 'True' THEN {embedded} ELSE {own} END"}


@cache
def look_alike_sql(key: str, dialect: str) -> dict[str, str]:
    """SQL expressions ``kind`` and ``text`` of a look-alike for an integer key."""
    index = f"({key} % {len(LOOK_ALIKES)})"
    return {"kind": _picked([kind for kind, _ in LOOK_ALIKES], index, dialect),
            "text": _filled([_slots(parts) for _, parts in LOOK_ALIKES], index, key, dialect, f"{SEED}.none")}


def mixed_keys(key: str) -> tuple[str, str]:
    """Keys of the two credentials of a message."""
    return f"({key} * 2 + 1)", f"({key} * 3 + 20)"


@cache
def mixed_sql(key: str, dialect: str) -> dict[str, str]:
    """SQL expressions ``first``, ``second``, ``n`` and ``text`` of a message for an integer key.

    It holds ``n`` credentials, none to two, and a look-alike between a question's beginning and end; ``text``
    refers to columns ``first`` and ``second`` holding the values of those expressions.
    """
    one, two = [sample_sql(k, dialect, name) for k, name in zip(mixed_keys(key), ("first", "second"))]
    n, index = f"({key} % 3)", f"(CAST(floor({key} / 3) AS BIGINT) % {len(ASKED)})"
    parts = [_picked([a for a, _ in ASKED], index, dialect), f"CASE WHEN {n} > 0 THEN {one['sample']} ELSE '-' END",
             look_alike_sql(key, dialect)["text"], f"CASE WHEN {n} > 1 THEN {two['sample']} ELSE '-' END",
             _picked([b for _, b in ASKED], index, dialect)]
    return {"first": one["secret"], "second": two["secret"], "n": n, "text": " || chr(10) || ".join(parts)}


def with_look_alikes(df: DataFrame, key_col: str, text_col: str = "text") -> DataFrame:
    """Append to every text what looks like a credential and is none; adds ``look_alike``, its kind."""
    sql = look_alike_sql(key_col, "spark")
    made = F.inline(F.array(F.struct(F.concat(text_col, F.lit("\n"), F.expr(sql["text"])).alias("_text"), F.expr(sql["kind"]).alias("look_alike"))))
    return df.select("*", made).select(*[c for c in df.columns if c != text_col], F.col("_text").alias(text_col), "look_alike")


def with_messages(df: DataFrame, key_col: str, text_col: str = "text") -> DataFrame:
    """Append to every text a message with none to two credentials and a look-alike; adds ``expected_secrets``."""
    sql = mixed_sql(key_col, "spark")
    secrets = F.inline(F.array(F.struct(F.expr(sql["first"]).alias("first"), F.expr(sql["second"]).alias("second"))))
    text = F.inline(F.array(F.struct(F.concat(text_col, F.lit("\n"), F.expr(sql["text"])).alias("_text"))))
    return (df.select("*", secrets).select("*", text)
            .select(*[c for c in df.columns if c != text_col], F.col("_text").alias(text_col),
                    F.slice(F.array("first", "second"), F.lit(1), F.expr(f"CAST({sql['n']} AS INT)")).alias("expected_secrets")))


def with_samples(df: DataFrame, key_col: str, text_col: str = "text") -> DataFrame:
    """Append a labelled sample to every text: adds ``expected_provider/rule/secret``."""
    sql = sample_sql(key_col, "spark")
    # Generated columns are not merged into later expressions, so each sample is made once.
    label = F.inline(F.array(F.struct(F.expr(sql["secret"]).alias("secret"), F.expr(sql["provider"]).alias("expected_provider"),
                                      F.expr(sql["rule_id"]).alias("expected_rule"))))
    sample = F.inline(F.array(F.struct(F.concat(text_col, F.lit("\n"), F.expr(sql["sample"])).alias("_text"))))
    return (df.select("*", label).select("*", sample)
            .select(*[c for c in df.columns if c != text_col], F.col("_text").alias(text_col),
                    "expected_provider", "expected_rule", F.col("secret").alias("expected_secret")))
