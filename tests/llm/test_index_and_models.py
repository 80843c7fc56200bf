from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspan.llm import brown, k2treap, merkle
from veilspan.llm.sql import TWINS

from .conftest import DOCS, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (None, "alpha beta gamma"), (5, "Alpha İstanbul straße αβγ alpha"), (5, "alpha beta"), (5, "alpha beta"),
       (7, "..."), (8, "x" * 50_000 + " alpha"), (-3, "beta beta beta alpha")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def some_docs(n, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(n)]


# --- ranked search -----------------------------------------------------------------------

def ranked_by_hand(docs, items, top=10):
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(lower(t)))
    out = []
    for item, terms in asked.items():
        scores = []
        for place, (i, c, n) in enumerate(counts):
            m = 10 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("columns, once", [(16, 1 << 17), (1 << 14, 40)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, columns, once):
    """Small grids, several groups of terms, copies, ties, odd rows and items."""
    monkeypatch.setattr(k2treap, "COLUMNS", columns)
    docs = some_docs(150) + [(1000 + i, "aa bb cc") for i in range(30)] + ODD
    items = [(1, docs[3][1]), (2, "aa BB cc"), (3, None), (4, "..."), (5, "unknown words only zzzzzz"), (6, "alpha"), (6, "Beta ..."), (None, "gamma alpha"),
             (7, " ".join(t for _, t in docs[:40]))]
    frame = documents(spark, docs).withColumn("score", F.lit(1)).withColumn("rank", F.lit("x")).repartition(5)
    found = k2treap.search(frame, spark.createDataFrame(items, "item_id long, text string"), terms_at_once=once)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == ranked_by_hand(docs, items)


def test_ranked_search_of_nothing(spark):
    none = documents(spark, [])
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert k2treap.search(none, items).count() == 0
    assert k2treap.search(documents(spark, ODD), items.limit(0)).count() == 0


def test_treap_search_opens_less_than_all():
    rng = np.random.default_rng(1)
    rows, columns = rng.integers(0, 64, 40_000), rng.integers(0, 4096, 40_000)
    cells = np.unique(rows * 4096 + columns)
    impacts = rng.pareto(1.2, len(cells)).astype(np.int64) + 1
    grid = k2treap.Treap(cells // 4096, cells % 4096, impacts, 64, 4096)
    dense = np.zeros((64, 4096), np.int64)
    dense[cells // 4096, cells % 4096] = impacts
    for _ in range(20):
        asked = rng.choice(64, 5, replace=False)
        sums = dense[asked].sum(0)
        want = np.lexsort((np.arange(4096), -sums))[:10]
        found, scores = grid.best(asked, np.arange(4096), 10)
        assert list(found) == list(want) and list(scores) == list(sums[want])
    # A floor that nothing reaches opens nothing and returns nothing.
    assert len(grid.best(np.array([0]), np.arange(4096), 10, int(impacts.max()) + 1)[0]) == 0


def test_grid_and_counts_take_little_memory():
    """A worker's memory is short: cells are 13 bytes, texts are counted some at a time."""
    rng = np.random.default_rng(2)
    cells = np.unique(rng.integers(0, 64 * 4096, 40_000))
    grid = k2treap.Treap(cells // 4096, cells % 4096, np.ones(len(cells), np.int64), 64, 4096)
    assert grid.mask.nbytes + grid.base.nbytes + grid.top.nbytes <= 13 * len(grid.top)
    batch = pa.RecordBatch.from_pydict({"id": [*range(4999), None], "text": ["Alpha beta alpha", None, "x", "", "beta"] * 1000})
    parts = list(k2treap._counted(SimpleNamespace(value=["alpha", "beta"]))(iter([batch])))
    assert max(map(len, parts)) <= 1024 and sum(map(len, parts)) == 5000
    assert parts[0].slice(0, 5).to_pylist() == [{"id": i, "n": n, "rows": rows, "tfs": tfs} for i, (n, rows, tfs) in enumerate(
        [(3, [0, 1], [2, 1]), (0, [], []), (1, [], []), (0, [], []), (1, [1], [1])])]


def test_ranked_twin_and_query_on_skewed_rows(spark):
    rows = some_docs(300, 8)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", rows[:9])
    want = sorted((a, int(b), c, int(d)) for a, b, c, d in con.execute(TWINS["op11_ranked"]).fetchall())
    found = k2treap.search(documents(spark, rows), spark.createDataFrame(rows[:9], "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == want == sorted(ranked_by_hand(rows, rows[:9]))


# --- manifest ----------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_by_hand(leaves):
    proofs, layer = [[] for _ in leaves], [(d, [i]) for i, d in enumerate(leaves)]
    while len(layer) > 1:
        above = []
        for at in range(0, len(layer), 2):
            run = layer[at:at + 2]
            for d, ids in run:
                for i in ids:
                    proofs[i] += [x for x, others in run if others is not ids]
            above.append((sha("".join(d for d, _ in run)), [i for _, ids in run for i in ids]))
        layer = above
    return layer[0][0], proofs


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest_equals_brute_force(spark, bits):
    rng = random.Random(3)
    langs = [None, "de", "en", "zz", "é", ""]
    rows = [(i, f"text {i}", rng.choice(langs[:4]), None if i % 9 == 0 else "s", i) for i in range(77)]
    rows += [(500, None, "", "s", None), (501, "", "é", None, 3), (None, "x", "en", "s", 1), (3, "text 3", "en", "s", 3), (3, "text 3", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("rank", F.lit("own"))
    docs = docs.withColumn("leaf", merkle.row_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    leaves, tops, store, root = merkle.manifest(docs.select("doc_id", "lang", "leaf"), "lang", ["doc_id"], "leaf", bits)
    found = merkle.proofs(leaves.select("tree", "rank", "doc_id", "leaf"), tops, store, root, bits).withColumn("folded", merkle.folded(F.col("leaf"), F.col("path")))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"], r["subroot"], r["folded"], tuple(s[1:] for s in r["path"] if s)) for r in found.collect())

    def cell(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        groups[(lang is not None, (lang or "").encode())].append(((i is not None, i or 0), sha("".join(map(cell, (i, source, lang, n, text))))))
    ordered = [sorted(groups[g]) for g in sorted(groups)]
    below = [tree_by_hand([d for _, d in g]) for g in ordered]
    top, above = tree_by_hand([r for r, _ in below])
    want = sorted((*i, d, r, top, tuple(p + up)) for g, (r, proofs), up in zip(ordered, below, above) for (i, d), p in zip(g, proofs))
    assert root == top and got == want


def test_manifest_requests_and_damage(spark):
    docs = documents(spark, [(i, f"t{i}") for i in range(40)]).select("doc_id", "lang", merkle.row_digest(F.col("text")).alias("leaf"))
    leaves, tops, store, root = merkle.manifest(docs, "lang", ["doc_id"], "leaf", 3)
    some = leaves.where("doc_id IN (0, 17, 39)").select("tree", "rank", "doc_id", "leaf")
    found = merkle.proofs(some, tops, store, root, 3).withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 17, 39] and all(r["folded"] == root and r["digest"] == r["leaf"] for r in found)
    wrong = merkle.folded(F.sha2(F.lit("other"), 256), F.col("path"))
    assert merkle.proofs(some, tops, store, root, 3).where(wrong == F.lit(root)).count() == 0
    damaged = store.withColumn("children", F.translate("children", "a", "b"))
    with pytest.raises(Exception, match="does not hold what its digest says"):
        merkle.proofs(some, tops, damaged, root, 3).collect()


def test_manifest_of_one_row_and_of_none(spark):
    one = documents(spark, [(1, "t")]).select("doc_id", "lang", F.sha2("text", 256).alias("leaf"))
    leaves, tops, store, root = merkle.manifest(one, "lang", ["doc_id"], "leaf")
    row = merkle.proofs(leaves.select("tree", "rank", "leaf"), tops, store, root).first()
    assert root == row["leaf"] == row["subroot"] == row["digest"] and row["path"] == []
    leaves, tops, store, root = merkle.manifest(one.limit(0), "lang", ["doc_id"], "leaf")
    assert root is None and merkle.proofs(leaves.select("tree", "rank", "leaf"), tops, store, "").count() == 0


# --- class n-grams -----------------------------------------------------------------------

def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def two_languages(n, seed=2):
    rng = random.Random(seed)
    halves = (["der", "die", "und", "wald", "baum", "haus", "geht"], ["the", "and", "tree", "house", "goes", "wood", "with"])
    return [(i, " ".join(rng.choices(halves[i % 2], k=rng.randint(5, 40))) + f" rare{i}") for i in range(n)]


def model_by_hand(model, text):
    """The score from the model's classes and counts alone."""
    t, rest = model.tables, {r["h"]: r["n"] for r in model.words.collect()}
    rank = {h: i for i, h in enumerate(t.hashes.tolist())}
    total, before = 0.0, 0
    for word in tokens_of(text):
        data = word.encode()
        h = brown._signed(brown.xxhash.xxh64_intdigest(data))
        unit = rank[h] if rank.get(h, t.own) < t.own else t.own + brown.spelling(data)
        count = int(t.counts[rank[h]]) if h in rank else rest.get(h, 0)
        cls = int(t.of[unit])
        total += t.transitions[before, cls] + math.log10(count + 0.1) - t.denominators[cls]
        before = cls
    return total + t.transitions[before, 0]


@pytest.mark.parametrize("units, shared", [(1 << 14, 1 << 18), (6, 9)])
def test_scores_equal_brute_force(spark, monkeypatch, units, shared):
    monkeypatch.setattr(brown, "PIECE", 64)
    docs = two_languages(120) + [r for r in ODD if r[0] != 8] + [(9, "word " * 400)]
    frame = documents(spark, docs).withColumn("score", F.lit("own")).repartition(4)
    model = brown.fit(frame.where(brown.trained_on(F.col("doc_id"))), classes=5, units=units, shared=shared, sweeps=4)
    assert model.tables.own <= units and len(model.tables.hashes) <= shared
    train = Counter()
    for i, text in docs:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 10:
            train.update([*tokens_of(text), "\0end"])
    n, v = sum(train.values()), len(train)
    base = {text: sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*tokens_of(text), "\0end"]) for _, text in docs}
    got = model.score(frame.withColumn("copy", F.col("text")))
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "copy", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = [*tokens_of(r["copy"]), "\0end"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(train[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(base[r["copy"]], rel=1e-9) and r["score"] == pytest.approx(model_by_hand(model, r["copy"]), rel=1e-9)


def test_counts_are_handed_over_in_small_batches(spark):
    """A worker's memory is short: however many words and pairs there are, no batch of counts or parts is large."""
    rng = random.Random(3)
    texts = pa.array([" ".join(f"w{rng.randrange(60_000)}" for _ in range(100)) for _ in range(6000)] + [None])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    words, pairs = Counter(), Counter()
    for b in brown._word_counts(iter([batch])):
        assert len(b) <= 1 << 16
        for h, n in zip(b.column("h").to_pylist(), b.column("n").to_pylist()):
            words[h] += n
    shared = SimpleNamespace(value=np.array([brown._signed(brown.xxhash.xxh64_intdigest(b"w1"))]))
    for b in brown._pair_counts(shared, 1, 1 + brown.SPELLINGS)(iter([batch])):
        assert len(b) <= 1 << 16
        for x, n in zip(b.column("a").to_pylist(), b.column("n").to_pylist()):
            pairs[x] += n
    told = Counter(w for t in texts.to_pylist() for w in (t or "").split())
    assert words[brown._signed(brown.END_HASH)] == pairs[1 + brown.SPELLINGS] == 6001 and sum(words.values()) == sum(pairs.values()) == 606_001
    assert words[int(shared.value[0])] == pairs[0] == told["w1"] and len(words) == len(told) + 1
    model = brown.fit(documents(spark, two_languages(20)))
    assert [len(x) for x in brown._parts(SimpleNamespace(value=model.tables))(iter([texts.slice(4000).to_pandas()]))] == [1024, 977]


def test_probabilities_add_up_and_classes_help(spark):
    docs = two_languages(400)
    frame = documents(spark, docs)
    model = brown.fit(frame.where(brown.trained_on(F.col("doc_id"))), classes=4, sweeps=10)
    t = model.tables
    assert np.allclose((10.0 ** t.transitions).sum(1), 1)
    held = np.zeros(4)
    classes = t.classes()
    for i in range(len(t.hashes)):
        held[classes[i]] += t.counts[i] + 0.1
    assert np.allclose((held + 0.1)[1:], (10.0 ** t.denominators)[1:])  # one place more in each class, for an unseen word
    sums = model.score(frame.where(~brown.trained_on(F.col("doc_id")))).agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1] + 10
    unit = {brown._signed(brown.xxhash.xxh64_intdigest(w.encode())): w for w in "der die und wald baum haus geht the and tree house goes wood with".split()}
    of = {unit[h]: classes[i] for i, h in enumerate(t.hashes.tolist()) if h in unit}
    assert not {of[w] for w in "der die und wald baum haus geht".split()} & {of[w] for w in "the and tree house goes wood with".split()}


def test_exchange_never_lowers_the_likelihood(spark):
    rng = np.random.default_rng(0)
    n = rng.integers(0, 5, (30, 30))
    rights = [(u, [(int(b), int(n[u, b])) for b in range(30) if n[u, b]], [(int(a), int(n[a, u])) for a in range(30) if n[a, u]]) for u in range(30)]
    frame = spark.createDataFrame([(u, left, right) for u, right, left in rights], "unit int, left array<struct<a:int,n:bigint>>, right array<struct<b:int,n:bigint>>")
    of = np.arange(30) % 4 + 1
    of[29] = 0
    one = np.zeros((5, 5))
    np.add.at(one, (of[:, None], of[None, :]), n)
    best, pairs = brown.exchange(frame, of, 5, 6)
    two = np.zeros((5, 5))
    np.add.at(two, (best[:, None], best[None, :]), n)
    assert np.array_equal(pairs, two) and brown.likelihood(two) >= brown.likelihood(one) and best[29] == 0 and (best[:29] > 0).all()


def test_model_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    model = brown.fit(none)
    r = model.score(documents(spark, [(1, "a b"), (2, None)])).orderBy("doc_id").collect()
    assert [x["n_tokens"] for x in r] == [3, 1] and all(x["n_known"] == 0 and x["train_tokens"] == 0 and x["base_score"] == 0 and math.isfinite(x["score"]) for x in r)
    assert brown.fit(documents(spark, two_languages(20))).score(none).count() == 0
