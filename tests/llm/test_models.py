"""Quality, toxicity, neighbours and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilspan.llm import ann, packing, quality, toxicity
from veilspan.llm.common import held_out

from tests.llm.conftest import documents
from tests.llm.test_dedup import slow_components, slow_fingerprint, slow_lines
from tests.llm.test_text_operators import slow_hits

LABELS = "doc_id long, quality int, toxic int"
WORDS = [a + b for a in ("ba", "to", "ri", "me", "lu", "so", "ka", "ne") for b in ("n", "st", "ra", "li", "dor", "mi", "ve")]
BAD = ["grobian", "schuftig", "lumpen", "fieslich"]


def corpus(n=600, seed=1):
    """(doc_id, text) and labels; toxic texts hold bad words, poor ones shout, repeat or carry marks."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [a + b for a, b in zip(rng.choices(WORDS, k=160), rng.choices(WORDS, k=rng.randrange(30, 160)))]
        toxic, poor = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            for _ in range(max(2, len(words) // 20)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words)
        if poor:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w for w in t.split() for _ in range(9)),
                               lambda t: t.replace(" ", "*** "), lambda t: t.replace(" ", " | ")])(text)
        rows.append((i, text))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


def is_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_fifth(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == is_held(r["id"]) for r in got)


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs = documents(spark, rows).withColumn("label", F.lit(5)).withColumn("score_", F.lit(5))
    return rows, labels, docs, spark.createDataFrame(labels, LABELS)


def accuracy(scored, labels, at, threshold):
    truth = {r[0]: r[at] for r in labels}
    held = [(r["score"] >= threshold) == bool(truth[r["doc_id"]]) for r in scored if is_held(r["doc_id"])]
    return sum(held) / len(held)


def test_toxicity_on_held_out_rows(spark, fitted):
    rows, labels, docs, table = fitted
    model = toxicity.fit(docs, table)
    scored = model.transform(docs).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert accuracy(scored, labels, 2, 0.5) >= 0.95
    odd = model.transform(documents(spark, [(1, None), (1, ""), (2, "!!"), (3, "grobian " * 200_000)])).collect()
    assert [r["score"] for r in odd[:3]] == [odd[0]["score"]] * 3 and odd[0]["score"] < 0.5 < odd[3]["score"]


def test_toxicity_does_not_learn_from_held_out_labels(spark, fitted):
    rows, labels, docs, table = fitted
    turned = table.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, table), toxicity.fit(docs, turned)
    assert (a.slope, a.intercept) == (b.slope, b.intercept)


def test_toxicity_keeps_every_word(spark):
    """More kept words than ``slots``: the ratios are joined and no word is lost."""
    rng, rows, labels = random.Random(3), [], []
    bad = [f"schimpf{a}{b}" for a in WORDS[:30] for b in "xyz"]
    for i in range(400):
        words = [a + b for a, b in zip(rng.choices(WORDS, k=80), rng.choices(WORDS, k=80))]
        if i % 4 == 0:
            words[::9] = rng.choices(bad, k=len(words[::9]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, None), (1000, None), (1001, "..."), (None, "no id"), (0, rows[0][1]), (0, rows[0][1])]
    docs, table = documents(spark, rows).withColumn("_salt", F.lit(1)).withColumn("Digest", F.lit("d")), spark.createDataFrame(labels, LABELS)
    wide, narrow = toxicity.fit(docs, table), toxicity.fit(docs, table, slots=8)
    assert wide.shared is not None and narrow.shared is None and wide.ratios.count() > 8
    assert (narrow.slope, narrow.intercept) == pytest.approx((wide.slope, wide.intercept))
    a, b = wide.transform(docs), narrow.transform(docs)
    assert a.columns == b.columns
    key = lambda r: (str(r["doc_id"]), r["text"] or "")
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert [tuple(r)[:-1] for r in a] == [tuple(r)[:-1] for r in b]
    assert [r["score"] for r in a] == pytest.approx([r["score"] for r in b], abs=1e-9)


@pytest.mark.parametrize("labels", [[], [(1, None, None), (None, 1, 1)], [(i, 1, 0) for i in range(20)], [(i, 0, 1) for i in range(20)]])
def test_models_without_both_classes(spark, labels):
    rows, _ = corpus(20)
    docs, table = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    for module in (toxicity, quality):
        scores = {r["score"] for r in module.fit(docs, table).transform(docs).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 1
    assert toxicity.fit(documents(spark, []), table).transform(documents(spark, [])).count() == 0


def test_quality_on_held_out_rows(spark, fitted):
    rows, labels, docs, table = fitted
    model = quality.fit(docs, table)
    assert 0 < len(model.rules) < 120 and all(r.tests for r in model.rules)
    scored = model.transform(docs).collect()
    assert len(scored) == len(rows) and accuracy(scored, labels, 1, 0.3) >= 0.97
    odd = model.transform(documents(spark, [(1, None), (1, ""), (2, " \n "), (3, "x" * 300_000)])).collect()
    assert len(odd) == 4 and all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[1]["score"]


def test_statistics_of_a_small_text(spark):
    row = quality.with_statistics(documents(spark, [(1, "Aa aa aa, B!! | 12\nzz")])).first()
    stats = dict(zip(quality.STATISTICS, row["stats"]))
    assert stats["words"] == 7 and stats["chars"] == 21 and stats["different_words"] == 1.0 and stats["repeats"] == 0
    assert stats["marked_words"] == pytest.approx(1 / 7) and stats["chars_a_line"] == 10.5


def test_paths_of_a_printed_forest():
    tree = """  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 2 > 1.0E-3)
      Predict: 0.0
     Else (feature 2 <= 1.0E-3)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0"""
    assert quality.paths(tree) == {((0, "<=", 0.5),), ((0, "<=", 0.5), (2, ">", 0.001)), ((0, "<=", 0.5), (2, "<=", 0.001)), ((0, ">", 0.5),)}


def slow_nearest(rows, k, asked):
    out = []
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, v in usable:
        if asked(q):
            near = sorted(((-float((x * v).sum()), i) for i, x in usable if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def test_neighbours_equal_brute_force_when_all_leaves_are_searched(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(6) * (1 + i % 3)).round(2).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(90)]  # a group of copies larger than any list
    rows += [(400, None), (420, [0.0] * 6), (440, [1.0, float("nan")] + [0.0] * 4), (460, [float("inf")] + [0.0] * 5), (480, [None] + [1.0] * 5), (500, []), (None, rows[1][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).withColumn("rep", F.lit(1)).repartition(3)
    got = ann.nearest(table, 20, lambda v: v % 20 == 0, leaf=16, block=10, share=99).collect()
    want = slow_nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 20, lambda q: q % 20 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted(w[:3] for w in want)
    scores = {(r["query_id"], r["rank"]): r["score"] for r in got}
    assert all(abs(scores[w[0], w[1]] - w[3]) < 1e-12 for w in want)


def test_neighbours_of_few_vectors(spark):
    assert ann.nearest(spark.createDataFrame([], VECTORS), 20, lambda v: v % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0], 1)], VECTORS)
    assert ann.nearest(one, 20, lambda v: v % 20 == 0).count() == 0
    two = ann.nearest(one.union(spark.createDataFrame([(1, [0.5, 0.5], 1)], VECTORS)), 20, lambda v: v % 20 == 0).collect()
    assert [tuple(r) for r in two] == [(0, 1, 1, 0.5)]


def test_recall_of_the_production_parameters(spark):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((4000, 32))
    points /= np.linalg.norm(points, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(points)], VECTORS)
    got = ann.nearest(table, 20, lambda v: v % 20 == 0, leaf=128).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q, near in found.items():
        scores = points @ points[q]
        scores[q] = -9
        hits.append(len(near & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert len(found) == 200 and np.mean(hits) >= 0.9


def test_the_queue_is_shared_by_all_trees():
    rng = np.random.default_rng(0)
    points = rng.standard_normal((512, 8))
    forest = ann.Forest(points, 4, float(np.linalg.norm(points, axis=1).max()), trees=3)
    leaves = forest.leaves(points)
    sizes = np.stack([np.bincount(leaves[:, t], minlength=16) for t in range(3)])
    assert sizes.sum() == 3 * 512 and sizes.min() >= 24  # medians keep leaves even
    some = forest.nearest_leaves(points[0], sizes, 200)
    assert {t for t, _ in some[:3]} == {0, 1, 2} and 200 <= sum(sizes[t, x] for t, x in some) < 300
    assert len(forest.nearest_leaves(points[0], sizes, 10**9)) == 48


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with planted copies, leaks, repeated lines and toxic texts."""
    rows, labels = corpus(300, 5)
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices(WORDS, k=25))) for i in range(5)]
    clean = [i for i, (_, t) in enumerate(rows) if labels[i][2] == 0 and len(t) > 500]
    passage = "this long passage stands in several documents of the corpus and is the same in all"
    rows += [(1000 + k, rows[i][1] + (" extra" if k % 2 else "")) for k, i in enumerate(clean[:6])]
    rows += [(2000 + k, f"{' '.join(rng.choices(WORDS, k=40))} {items[k][1]}") for k in range(5)]
    rows += [(3000 + k, f"{passage}\n{' '.join(rng.choices(WORDS, k=50))}") for k in range(4)]
    rows += [(4000, None), (4001, ""), (4002, " ".join(rng.choices(WORDS, k=40_000)))]
    at = tmp_path_factory.mktemp("tables")
    documents(spark, rows).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at), rows, labels, items


def test_pipeline_stages_equal_brute_force(spark, folder):
    at, rows, labels, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]

    first = stages["toxicity"](spark, docs, at)
    assert first.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    toxic = {i for i, _, t in labels if t}
    planted = {i for i, t in rows if any(w in (t or "").lower() for w in BAD)}
    assert len(planted & kept.keys()) <= 0.08 * len(planted) and len([i for i, _ in rows if i not in planted and i not in kept]) <= 3 and toxic <= planted
    second = stages["line_dedup"](spark, first, at)
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in second.collect()}
    assert {i: t for i, (t, _) in cut.items()} == dict(slow_lines(list(kept.items())))
    assert all(t is None or n == len(t) for t, n in cut.values())
    third = stages["near_dedup"](spark, second, at)
    left = {r["doc_id"] for r in third.collect()}
    fps = {i: slow_fingerprint(t) for i, (t, _) in cut.items()}
    own = sorted(set(fps.values()))
    root = slow_components(own, [(a, b) for a in own for b in own if a < b and bin(a ^ b).count("1") <= 3])
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert left == set(least.values())
    fourth = stages["decontamination"](spark, third, at)
    clean = {r["doc_id"] for r in fourth.collect()}
    assert clean == {i for i in left if slow_hits(cut[i][0], items)[1] == 0} and not clean & set(range(2000, 2005))
    pieces = stages["packing"](spark, fourth, at).collect()
    encoder, tokens = packing.Encoder(), {}
    for r in pieces:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert tokens == {i: len(encoder.ids(cut[i][0] or "")) + 1 for i in clean}


def test_run_is_the_stages_one_after_another(spark, folder):
    at = folder[0]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, at).collect())) == sorted(map(key, docs.collect()))


def test_both_classes_keep_words_of_their_own(spark):
    """The ordinary class's share is not empty where it has most of the corpus: its own words speak for it."""
    pairs = [(p << 32 | w, t, 1 - t) for t, words, n in ((0, range(1, 5), 300), (1, range(5, 7), 60)) for w in words for p in range(n)]
    ratios, unseen = toxicity._ratios(spark.createDataFrame(pairs, "pair long, toxic long, ordinary long"), toxicity.DISCOUNT, toxicity.TIMES)
    found = {r["key"]: r["ratio"] for r in ratios.collect()}
    assert all(found[w] < 0 for w in range(1, 5)) and all(found[w] > 0 for w in (5, 6))
