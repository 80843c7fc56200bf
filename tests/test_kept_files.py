"""Originals of files that share a path, and rebuilt baselines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilspan.operators import baseline as B, vault as V
from veilspan.operators.lock import lock_files, unlock_files

TOKENS = ["npm_" + c * 2 + "Q7w2E9r4T6y1U8i3O5p0A2s4D6f8G1h3J5" for c in "KLMN"]


def test_files_of_one_path_or_none_get_their_own_text_back(spark):
    texts = [f'A={i}\nAPI_TOKEN="{t}"\n' for i, t in enumerate(TOKENS)]
    files = spark.createDataFrame(list(zip(["a/.env", "a/.env", None, None], texts)), "path string, text string")
    out, originals, _ = lock_files(files, V.empty_vault(spark), V.key_frame(spark, b"k" * 32))
    locked = out.select("path", F.col("locked_text").alias("text"))
    assert locked.where(F.contains("text", F.lit("npm_"))).count() == 0
    back = unlock_files(locked, V.empty_vault(spark), originals)
    assert sorted((r["path"] or "", r["unlocked_text"], r["source"]) for r in back.collect()) == sorted(
        (p or "", t, "original") for p, t in zip(["a/.env", "a/.env", None, None], texts))


def test_a_changed_file_takes_the_only_or_the_newest_original_of_its_path(spark):
    texts = [f'API_TOKEN="{t}"\n' for t in TOKENS[:3]]
    files = spark.createDataFrame(list(zip(["a/.env", "a/.env", "b/.env"], texts)), "path string, text string")
    out, originals, _ = lock_files(files, V.empty_vault(spark), V.key_frame(spark, b"k" * 32))
    changed = out.select("path", F.concat("locked_text", F.lit("B=2\n")).alias("text"))
    back = {(r["path"], r["source"]) for r in unlock_files(changed, V.empty_vault(spark), originals).collect()}
    assert back == {("a/.env", "partial"), ("b/.env", "original")}  # which of two it was cannot be told
    dated = originals.withColumn("at", F.when(F.contains("text", F.lit(TOKENS[1])), 2).otherwise(1))
    newest = unlock_files(changed, V.empty_vault(spark), dated, newest="at").where("path = 'a/.env'").collect()
    assert {r["unlocked_text"] for r in newest} == {texts[1]}


def test_a_rebuild_starts_anew_with_a_fresh_salt(spark, tmp_path):
    rows = [("a.py", 3, "secret-one", 1, "r"), ("b.py", 9, "secret-one", 2, "r"), ("b.py", 1, "secret-two", 1, "s")]
    found = spark.createDataFrame(rows, "path string, start int, match string, line int, rule_id string")
    store = B.BaselineStore(spark, str(tmp_path / "baseline"))
    salt, entries = store.load()
    assert (salt, entries.count()) == ("", 0)
    assert store.rebuild(found, "path") == (1, 2)
    salt, entries = store.load()
    assert {r["hint"] for r in entries.collect()} == {"b.py:2 r", "b.py:1 s"}
    assert B.new_findings(found, entries, salt, ["path", "start"]).count() == 0
    assert store.rebuild(found.where("match = 'secret-two'"), "path") == (2, 1)
    after, entries = store.load()
    assert after != salt and B.new_findings(found, entries, after, ["path", "start"]).count() == 2
    assert store.load(1)[1].count() == 2  # who began with the version before can finish
    store.rebuild(found.limit(0), "path")
    assert store.load()[1].count() == 0 and store.versions() == [2, 3] and len(store._listed("entries")) == 2


def test_of_two_rebuilds_one_has_to_begin_again(spark, tmp_path):
    found = spark.createDataFrame([("a.py", 3, "secret-one", 1, "r")], "path string, start int, match string, line int, rule_id string")
    one = B.BaselineStore(spark, str(tmp_path / "baseline"))
    one.versions = lambda: []  # it looked before the other wrote
    B.BaselineStore(spark, str(tmp_path / "baseline")).rebuild(found, "path")
    with pytest.raises(B.BaselineConflict):
        one.rebuild(found, "path")
    assert len(one._listed("entries")) == 1
