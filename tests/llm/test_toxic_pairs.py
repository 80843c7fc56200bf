"""Toxicity is scored by pairs of words too, and calibrated by all rows."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspan.llm import toxicity
from veilspan.llm.common import held_out

from tests.llm.conftest import documents

WORDS = [a + b for a in ("ba", "to", "ri", "me", "lu", "so", "ka", "ne") for b in ("n", "st", "ra", "li", "dor", "mi", "ve")]


def pairs_corpus(n=500):
    """Both classes use the same words equally often; in toxic texts ``linke`` is followed by ``pfote``, in others by ``hand``, and the reverse for ``rechte``."""
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        toxic = i % 2
        words = [a + b for a, b in zip(rng.choices(WORDS, k=60), rng.choices(WORDS, k=60))]
        for first, other in (("linke", ("hand", "pfote")), ("rechte", ("pfote", "hand"))):
            for _ in range(4):
                words.insert(rng.randrange(len(words)), f"{first} {other[toxic]}")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_pairs_tell_classes_apart_that_words_do_not(spark):
    rows, labels = pairs_corpus()
    docs, table = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    assert {r["kind"] for r in model.ratios.select("kind").distinct().collect()} >= {toxicity.PAIR, toxicity.BEFORE}
    scored = model.transform(docs).where(held_out(F.col("doc_id"))).collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in scored]) >= 0.95
    joined = toxicity.fit(docs, table, slots=3)
    assert joined.shared is None
    assert {r["doc_id"]: r["score"] for r in scored} == pytest.approx({r["doc_id"]: r["score"] for r in joined.transform(docs).where(held_out(F.col("doc_id"))).collect()}, abs=1e-9)


def test_ratios_of_pairs_equal_slow_ones(spark):
    counts = [(7 << 32 | 1, 300, 0), (7 << 32 | 2, 20, 400), (7 << 32 | 3, 90, 90), (8 << 32 | 1, 5, 5)]
    found, _ = toxicity._ratios(spark.createDataFrame(counts, "pair long, toxic long, ordinary long"), 2.0, 3.0, 10.0)
    got = {(r["kind"], r["key"]): r["ratio"] for r in found.where(F.col("kind") != toxicity.WORD).collect()}
    all_t, all_o, n = 410, 490, 900

    def own(c, total, both):
        return max(c - 10 - min(3.0, (1 + n / total) / 2) * total * both / n, 0) / total

    shares = {w: (own(t, all_t, t + o), own(o, all_o, t + o), (t + o) / n) for w, t, o in ((1, 300, 0), (2, 20, 400), (3, 90, 90))}
    left_t, left_o = 1 - sum(s[0] for s in shares.values()), 1 - sum(s[1] for s in shares.values())
    want = {(toxicity.PAIR, 7 << 32 | w): np.log((a + left_t * s) / (b + left_o * s)) for w, (a, b, s) in shares.items() if a or b}
    want[toxicity.BEFORE, 7] = np.log(left_t / left_o)
    assert len(want) > 1 and got == pytest.approx(want, abs=1e-6)


def test_calibration_takes_all_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    some = spark.createDataFrame(pd.DataFrame({"x": x, "label": y}))
    here, there = toxicity._calibrated(some, 3000), toxicity._calibrated(some, 10)
    assert here == pytest.approx(there, abs=1e-7) and here[0] == pytest.approx(2, abs=0.3)
