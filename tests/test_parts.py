"""Rules of one word and of one assignment are asked of parts of a text: no hit is lost or made up by that."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from veilspan.functions.columns import contains_any
from veilspan.operators.detect import _assignments, _pieces, java_pattern, rule_hits, worth_a_look
from veilspan.rules.catalogue import BUILTIN

from conftest import fake

GAPS = ("", "", " ", " ", "\n", "\n", "\n\n", "\t", "\r\n", " \n", "\n ", "\u00a0", "\u2028", '"', "'", "`", '"\n', "=", ":", "=\n", ":\n", " = ", ": ", "\n=", "\n:")
NAMES = ("password", "api_key", "export API_TOKEN", "aws_secret_access_key", "AWS_SECRET", "heroku_api_key", "HEROKU", "vercel_token", "dd_api_key", "datadog",
         "cloudflare-token", "Authorization", "Bearer", "AccountKey", "curl", "-u", "plain", "The key", "x.secret-", "jdbc:", "JDBC:", "mongodb+srv://", "# note")
HEX, UUID = "0123456789abcdef" * 4, "01234567-89ab-cdef-0123-456789abcdef"
VALUES = (fake("", 40), fake("", 24), fake("", 12), fake("", 11), HEX[:32], UUID, fake("ghp_", 36), fake("xoxb-", 10), fake("AKIA", 0) + "2B4D6F8H" * 2, "amqp://u:abc@h",
          "AMQPS://u:abc@h:1/x", "jdbc:a://b;password=abc", "JDBC:a://b;password=abcd", "mongodb+srv://u:abc@c.mongodb.net", "MONGODB+SRV://u:abcd@c.mongodb.net", "https://u:pw1@h",
          fake("sk-", 20), fake("hf_", 34), "AC" + HEX[:32], "12345678:AA" + fake("", 33), "a" * 13, "u:secretvalue", fake("", 86) + "==", "-----BEGIN RSA PRIVATE KEY-----",
          "//registry.example.org/:_authToken", fake("", 300))


def test_hits_are_those_of_the_whole_text(spark):
    rng = random.Random(5)
    pick = lambda: rng.choice(rng.choice((NAMES, VALUES)))
    texts = ["".join(pick() + rng.choice(GAPS) + rng.choice(GAPS) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    text = F.col("t")
    whole = F.array_compact(F.array(*[F.when((contains_any(text, r.prefilter) if r.prefilter else F.lit(True)) & F.rlike(text, F.lit(java_pattern(r))), F.lit(i))
                                      for i, r in enumerate(BUILTIN, 1)]))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8).select(
        "t", F.array_sort(whole).alias("whole"), F.array_sort(rule_hits(text, BUILTIN, worth_a_look(text))).alias("hits")).collect()
    assert [(r["t"], r["hits"]) for r in rows if r["hits"] != r["whole"]] == []
    seen = {h for r in rows for h in r["hits"]}
    assert len(seen) >= 20 and any(not r["hits"] for r in rows)


def test_a_long_text_with_one_credential_has_short_parts(spark):
    prose = "Plain words stand here, one after another: nothing of them is a value.\n" * 500
    text = prose + f'password = "{fake("", 30)}"\n' + prose
    row = spark.createDataFrame([(text,)], "t string").select(_pieces(F.col("t")).alias("words"), _assignments(F.col("t")).alias("lines")).first()
    assert row["words"] == f'"{fake("", 30)}"' and row["lines"] == f'password = "{fake("", 30)}"'
