"""SimHash, components and line dedup against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspan.llm import line_dedup, simhash
from veilspan.llm.components import components

from tests.llm.conftest import documents


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)) if shingles else 0


def slow_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


ODD = ["", "   \t\n", "one", "one two", "ONE TWO three", "x " * 3000, "é ü 漢字 İ", "a\x0bb\x0cc\rd\x1fe", "same same same same"]


@pytest.mark.parametrize("text", [*ODD, None])
def test_fingerprint_equals_its_definition(text):
    assert np.uint64(np.int64(simhash.fingerprint(text))) == np.uint64(slow_fingerprint(text))


def test_shingle_hash_is_the_engines(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert np.uint64(np.int64(row["h"])) == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42))


def near_numbers(n, rng, flips):
    """Fingerprints in groups around centres, up to ``flips`` bits away."""
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 20))]
    out = set()
    while len(out) < n:
        value = rng.choice(centres)
        for _ in range(rng.randrange(flips + 1)):
            value ^= 1 << rng.randrange(64)
        out.add(value)
    return sorted(out)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 8])
def test_links_join_what_is_within_three_bits(spark, bucket):
    values = near_numbers(400, random.Random(5), 6)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket).collect()
    mask = (1 << 64) - 1
    assert all(bin((r["a"] ^ r["b"]) & mask).count("1") <= 3 for r in found)
    want = slow_components(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & mask).count("1") <= 3])
    assert slow_components(signed, [(r["a"], r["b"]) for r in found]) == want


def test_a_bucket_returns_a_forest_not_all_pairs():
    fps = np.array([1 << i for i in range(40)], np.uint64)  # all within two bits of each other
    pivots = np.array(simhash.reference_fingerprints(), np.int64).view(np.uint64)
    a, b = simhash.forest(fps, np.bitwise_count(fps[:, None] ^ pivots), np.zeros(40, int))
    assert len(a) == 39


def test_pivots_discard_no_link():
    rng = random.Random(3)
    pivots = np.array(simhash.reference_fingerprints(), np.int64).view(np.uint64)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        d = np.bitwise_count(np.array([x, y], np.uint64)[:, None] ^ pivots).astype(int)
        assert np.abs(d[0] - d[1]).max() <= 3


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200), (None, 5), (7, 8)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def texts(rng, n):
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(6)]
    out = []
    for i in range(n):
        t = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(" ".join(t))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rows = [(i * 3 + 1, t) for i, t in enumerate([*texts(random.Random(1), 60), *ODD, None])]
    rows += [(2, rows[5][1]), (2, rows[5][1]), (None, rows[0][1])]
    docs = documents(spark, rows).withColumn("component", F.lit(1)).withColumn("fp", F.lit("x"))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).select(
        "doc_id", simhash.as_hex("fingerprint").alias("fp"), "component_id").collect())
    fps = [slow_fingerprint(t) for _, t in rows]
    own = set(fps)
    root = slow_components(own, [(a, b) for a in own for b in own if bin(a ^ b).count("1") <= 3])
    least = defaultdict(lambda: 1 << 60)
    for (i, _), f in zip(rows, fps):
        least[root[f]] = min(least[root[f]], i if i is not None else 1 << 60)
    assert got == sorted((i is None, i or 0, f"{f:016x}", least[root[f]]) for (i, _), f in zip(rows, fps))


def test_keep_one(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "other words in here now"), (None, "zz yy xx ww"), (None, "zz yy xx ww"), (None, "a b c d e f")]
    kept = simhash.keep_one(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "zz yy xx ww"), (3, "a b c d e f"), (9, "other words in here now")]
    assert simhash.keep_one(documents(spark, [])).count() == 0


BLANKS = " \t\n\x0b\x0c\r"


def slow_lines(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = low(line.strip(BLANKS))
            if len(key) >= min_chars:
                holders[key].add(i if i is not None else -(1 << 63))
    out = []
    for i, t in rows:
        own = i if i is not None else -(1 << 63)
        keep = [x for x in (t or "").split("\n") if (k := low(x.strip(BLANKS))) not in holders or len(holders[k]) < min_docs or max(holders[k]) == own]
        out.append((i, None if t is None else "\n".join(keep)))
    return out


@pytest.mark.parametrize("buffer", [line_dedup.BUFFER, 3])
def test_line_dedup_equals_brute_force(spark, buffer):
    rng = random.Random(9)
    lines = [f"line number {i} of some length" for i in range(12)] + ["short", "", "  Line Number 3 of Some Length\t", "ß" * 20, "x" * 100_000]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(1, 9)))) for i in range(80)]
    rows += [(7, rows[7][1]), (7, "line number 1 of some length\nmore"), (None, rows[3][1]), (None, "line number 2 of some length"), (90, None), (91, ""), (92, "\n\n")]
    docs = documents(spark, rows).withColumn("keep", F.lit(0)).repartition(5)
    cut = line_dedup.dedup_lines(docs, buffer=buffer)
    assert cut.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=key) == sorted(slow_lines(rows), key=key)


def test_hot_line_over_many_partitions(spark):
    rows = [(i, f"the very common line of all\nown line of document {i}") for i in range(3000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        maps = line_dedup.line_bitmaps(documents(spark, rows), buffer=50).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(r["doc_id"] for r in maps) == list(range(2999)) and {r["n_dropped"] for r in maps} == {1}
    bits = np.unpackbits(np.frombuffer(zlib.decompress(maps[0]["keep"]), np.uint8), count=2, bitorder="little")
    assert bits.tolist() == [0, 1] and maps[0]["n_lines"] == 2


def test_a_hot_line_is_split_where_nothing_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "is_small", lambda *a, **k: False)
    marked = spark.range(4000).select(F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2"), F.col("id").alias("doc_id"))
    stats = spark.createDataFrame([(1, 2, 4000, 3999)], "h1 long, h2 long, n long, top long")
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        late = line_dedup._with_stats(marked, stats)
        assert late.columns == ["h1", "h2", "doc_id", "n", "top"] and late.count() == 4000
        sizes = [r["count"] for r in late.groupBy(F.spark_partition_id().alias("part")).count().collect()]
        assert len(sizes) > 5 and max(sizes) < 1500  # 16 salts over 16 partitions
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_bitmaps(documents(spark, [])).count() == 0
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0
