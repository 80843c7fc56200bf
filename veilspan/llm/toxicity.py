"""Toxicity by class-conditional Kneser-Ney models.

The probability of a word is made, as Kneser and Ney do, of continuation counts: of how many
different words it follows, not of how often it occurs.  So a word that a copied document brings along a
thousand times weighs as little as one that occurs once.  The toxic and the ordinary model have
their own counts and back off, by absolute discounts, to counts that both classes share.  A count
is discounted by ``DISCOUNT`` and by ``TIMES`` what the shared counts lead one to expect, so that a
word that is rare, or belongs to a language or topic that one class happens to have more of, is left
to the shared counts and says nothing; without this, such words drown the few that matter in a
mean over all words.  Pairs of words speak in the same way: what a class has of the pairs that begin with a word
is discounted against what both classes have of them, and the ratio of a word after the word before it is the word's own ratio and that of
the pair, or of what kept pairs leave of the word before.  Pairs count documents, so that copies weigh; hence ``PAIR_DISCOUNT`` is larger.  (So the vocabulary must be larger than what one text follows a word with; on a
vocabulary of some dozens of words all continuation counts are alike.)  The score is a calibrated log-likelihood ratio for each word of the text.

All counts are made by Spark over all labelled training rows and grow with them.  Every word and pair that a class
keeps a share for has its own ratio, and so has what is left of the word before such a pair.  Up to ``SLOTS`` of them are broadcast as
sorted keys; more are joined to the pairs of the texts and summed for each text.  Words are told apart by 32-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import lookup
from .common import fresh, held_out, join_measured, saved

DISCOUNT = 2.0
PAIR_DISCOUNT = 10.0
TIMES = 3.0
SLOTS = 1 << 22
CALIBRATION_ROWS = 20_000
PIECE = 1 << 20
RIDGE = 0.05
#: Kinds of ratios.
WORD, BEFORE, PAIR = 0, 1, 2
#: ASCII bytes other than letters and digits part words.
_SPLIT = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def _words(text: str | None) -> Iterator[np.ndarray]:
    """32-bit hashes of lower-case words; long texts in parts that end at a blank."""
    data = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        found = data[at:end].split()
        if found:
            yield np.fromiter(map(zlib.crc32, found), np.uint64, len(found))
        at = end


def _pairs(words: np.ndarray) -> np.ndarray:
    """The word before (zero at the start) in the upper, the word in the lower half."""
    return (np.append(np.uint64(0), words[:-1]) << np.uint64(32)) | words


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def summed(parts: list[np.ndarray], label: int) -> pd.DataFrame:
        pairs, counts = np.unique(np.concatenate(parts), return_counts=True)
        return pd.DataFrame({"pair": pairs.view(np.int64), "toxic": counts * label, "ordinary": counts * (1 - label)})

    for batch in batches:
        for label, rows in batch.groupby("label"):
            waiting, size = [], 0
            for text in rows["text"]:
                pairs = [np.unique(_pairs(words)) for words in _words(text)]
                if pairs:  # a pair counts once for each document
                    waiting.append(np.unique(np.concatenate(pairs)))
                    size += len(waiting[-1])
                if size > 4 * PIECE:
                    yield summed(waiting, int(label))
                    waiting, size = [], 0
            if waiting:
                yield summed(waiting, int(label))


def _own(c: str, discount: float, above, total, shared):
    """What a class keeps of a count for itself, as a share of its ``total``."""
    return F.greatest(F.col(c) - F.lit(discount) - above * total * shared, F.lit(0.0)) / total


def _ratios(counts: DataFrame, discount: float, times: float, pair_discount: float = PAIR_DISCOUNT) -> tuple[DataFrame, float]:
    """(kind, key, ratio) for the words and pairs that a class keeps a share for and the words before such pairs, and the ratio of all other words.

    ratio: the logarithm of toxic over ordinary probability; of a word before, that of what its pairs leave.
    """
    seen = saved(counts.groupBy("pair").agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o")), "pairs")
    before = F.shiftrightunsigned("pair", 32).alias("h")
    seen = seen.select("pair", "t", "o", before, F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("w"))
    words = saved(seen.groupBy("w").agg(F.count_if(F.col("t") > 0).alias("t"), F.count_if(F.col("o") > 0).alias("o"),
                                        F.count("*").alias("n")), "words")
    all_t, all_o, all_n = [max(1, x or 0) for x in words.agg(F.sum("t"), F.sum("o"), F.sum("n")).first()]
    totals, shared = {"t": all_t, "o": all_o}, F.col("n") / F.lit(all_n)
    # Where a class has much of the corpus, no word can reach ``times``: halfway to what a word of its texts alone reaches.
    above = {c: min(times, (1 + all_n / totals[c]) / 2) for c in "to"}
    words = words.select("w", "n", *[_own(c, discount, F.lit(above[c]), F.lit(totals[c]), shared).alias(f"own_{c}") for c in "to"])
    kept = words.agg(F.sum("own_t"), F.sum("own_o")).first()
    left = {c: 1.0 - (x or 0.0) for c, x in zip("to", kept)}
    p = {c: F.col(f"own_{c}") + F.lit(left[c]) * shared for c in "to"}
    rows = words.where("own_t > 0 or own_o > 0").select(F.lit(WORD).alias("kind"), F.col("w").alias("key"), F.log(p["t"] / p["o"]).cast("float").alias("ratio"))
    return rows.unionByName(_pair_ratios(seen, pair_discount, times)), float(np.log(left["t"] / left["o"]))


def _pair_ratios(seen: DataFrame, discount: float, times: float) -> DataFrame:
    """The rows of ``_ratios`` for pairs and the words before them."""
    histories = saved(seen.groupBy("h").agg(F.greatest(F.sum("t"), F.lit(1)).alias("all_t"), F.greatest(F.sum("o"), F.lit(1)).alias("all_o"),
                                            F.sum(F.col("t") + F.col("o")).alias("all_n")), "histories")
    some = seen.where((F.col("t") > discount) | (F.col("o") > discount))  # no other pair keeps anything
    shared = (F.col("t") + F.col("o")) / F.col("all_n")
    own = [_own(c, discount, F.least(F.lit(times), (1 + F.col("all_n") / F.col(f"all_{c}")) / 2), F.col(f"all_{c}"), shared).alias(f"own_{c}") for c in "to"]
    kept = saved(lookup(some, histories, "h", ["pair"], "inner").select("pair", "h", shared.alias("shared"), *own).where("own_t > 0 or own_o > 0"), "kept")
    left = saved(kept.groupBy("h").agg((1 - F.sum("own_t")).alias("left_t"), (1 - F.sum("own_o")).alias("left_o")), "left")
    told = lookup(kept, left, "h", ["pair"], "inner")
    p = {c: F.col(f"own_{c}") + F.col(f"left_{c}") * F.col("shared") for c in "to"}
    pairs = told.select(F.lit(PAIR).alias("kind"), F.col("pair").alias("key"), F.log(p["t"] / p["o"]).cast("float").alias("ratio"))
    return pairs.unionByName(left.select(F.lit(BEFORE).alias("kind"), F.col("h").alias("key"), F.log(F.col("left_t") / F.col("left_o")).cast("float").alias("ratio")))


class Ratios:
    """The table that is broadcast: sorted keys of words, of words before and of pairs, and their log ratios."""

    def __init__(self, rows: pd.DataFrame, unseen: float):
        self.unseen, self.tables = float(np.float32(unseen)), []
        for kind, width in ((WORD, np.uint32), (BEFORE, np.uint32), (PAIR, np.uint64)):
            own = rows[rows["kind"] == kind]
            keys, values = own["key"].to_numpy(np.int64).view(np.uint64).astype(width), own["ratio"].to_numpy(np.float32)
            order = np.argsort(keys)
            self.tables.append((keys[order], values[order]))

    def found(self, kind: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether there is a ratio for each key, and it."""
        keys, values = self.tables[kind]
        if not len(keys):
            return np.zeros(len(asked), bool), np.zeros(len(asked))
        asked = asked.astype(keys.dtype)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return keys[at] == asked, values[at].astype(np.float64)

    def score(self, text: str | None) -> tuple[float, int]:
        """Sum of the log ratios and number of words."""
        total, n = 0.0, 0
        for words in _words(text):
            pairs, times = np.unique(_pairs(words), return_counts=True)
            n += len(words)
            known, alone = self.found(WORD, pairs & np.uint64(0xFFFFFFFF))
            led, left = self.found(BEFORE, pairs >> np.uint64(32))
            whole, ratio = self.found(PAIR, pairs)
            total += float((times * (np.where(known, alone, self.unseen) + np.where(whole, ratio, np.where(led, left, 0.0)))).sum())
        return total, n


def _pair_counts(texts: pd.Series) -> pd.DataFrame:
    out: list[tuple[list[int], list[int]]] = []
    for text in texts:
        parts = [np.unique(_pairs(words), return_counts=True) for words in _words(text)]
        out.append(([k for keys, _ in parts for k in keys.view(np.int64).tolist()], [n for _, ns in parts for n in ns.tolist()]))
    return pd.DataFrame(out, columns=["key", "n"])


class ToxicityModel:
    """A fitted model; ``transform`` adds a score between 0 and 1.

    ratios: (kind, key, ratio), saved; if there are more than ``slots`` they stay a table and are joined.
    """

    def __init__(self, ratios: DataFrame, unseen: float, slots: int, slope: float, intercept: float):
        self.ratios, self.unseen, self.slope, self.intercept = ratios, float(np.float32(unseen)), slope, intercept
        self.shared = None
        if ratios.count() <= slots:
            self.shared = ratios.sparkSession.sparkContext.broadcast(Ratios(ratios.toPandas(), unseen))

    def with_ratio(self, docs: DataFrame, text: str, name: str) -> DataFrame:
        """``docs`` plus the log-likelihood ratio for each word; zero for texts without words."""
        return docs.withColumn(name, self._narrow(F.col(text))) if self.shared is not None else self._joined(docs, text, name)

    def _narrow(self, text):
        shared = self.shared

        @F.pandas_udf("double")
        def mean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            table = shared.value
            for texts in batches:
                found = [table.score(t) for t in texts]
                yield pd.Series([total / n if n else 0.0 for total, n in found], dtype="float64")

        return mean(text)

    def _joined(self, docs: DataFrame, text: str, name: str) -> DataFrame:
        """Equal texts have one mean, so that texts are known by their digest; copies of one text do not change it."""
        digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
        counts = F.pandas_udf(_pair_counts, "key array<long>, n array<long>")
        counted = docs.select(digest.alias("digest"), counts(F.col(text)).alias("c"))
        found = counted.select("digest", F.explode(F.arrays_zip(F.col("c.key").alias("key"), F.col("c.n").alias("n"))).alias("w")).select("digest", F.col("w.key").alias("pair"), "w.n")
        parts = {"pair": (PAIR, F.col("pair")), "w": (WORD, F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), "h": (BEFORE, F.shiftrightunsigned("pair", 32))}
        for key, (kind, part) in parts.items():
            own = self.ratios.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("ratio").cast("double").alias(f"of_{key}"))
            found = lookup(found.withColumn(key, part), own, key, ["digest"], small=False)
        share = F.col("n") * (F.coalesce("of_w", F.lit(self.unseen)) + F.coalesce("of_pair", "of_h", F.lit(0.0)))
        means = saved(found.groupBy("digest").agg((F.sum(share) / F.sum("n")).alias("mean")), "means")
        rows = docs.select(F.struct("*").alias("row"), digest.alias("digest"), F.monotonically_increasing_id().alias("at"))
        return lookup(rows, means, "digest", ["at"]).select("row.*", F.coalesce("mean", F.lit(0.0)).alias(name))

    def transform(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """``docs`` plus ``name``; null and empty texts score as texts of no evidence."""
        (ratio,) = fresh(docs, "_ratio")
        odds = F.lit(self.intercept) + F.lit(self.slope) * F.col(ratio)
        return self.with_ratio(docs, text, ratio).withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).drop(ratio)


def _logistic(n: int, ones: float, middle: float, scale: float, sums) -> tuple[float, float]:
    """Slope and intercept of a ridge logistic fit in one variable, which starts at the share of ones.

    sums: from slope and intercept, in units of ``scale`` around ``middle``, the sums of e*z, e, v*z*z, v*z and v over all rows, for
    the errors e and variances v of the probabilities.
    """
    share = (ones + 0.5) / (n + 1)
    if n == 0 or not scale or ones in (0, n):
        return 0.0, float(np.log(share / (1 - share)))
    w = np.array([0.0, np.log(share / (1 - share))])
    for _ in range(100):
        ez, e, vzz, vz, v = sums(w)
        gradient = np.array([ez, e]) + RIDGE * np.array([w[0], 0])
        hessian = np.array([[vzz, vz], [vz, v]]) + np.diag([RIDGE, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * middle / scale)


def _calibrated(some: DataFrame, local_rows: int) -> tuple[float, float]:
    """``_logistic`` over all rows (x, label): up to ``local_rows`` are brought to the driver, more are summed where they are."""
    told = some.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), F.avg("x"), F.stddev_pop("x")).first()
    n, ones, middle, scale = int(told[0]), float(told[1]), told[2] or 0.0, told[3] or 0.0
    if not scale:
        return _logistic(n, ones, middle, scale, None)
    if n <= local_rows:
        seen = some.select("x", "label").toPandas()
        z, y = (seen["x"].to_numpy(float) - middle) / scale, seen["label"].to_numpy(float)

        def sums(w):
            p = 1 / (1 + np.exp(-np.clip(z * w[0] + w[1], -35, 35)))
            e, v = p - y, p * (1 - p)
            return (e * z).sum(), e.sum(), (v * z * z).sum(), (v * z).sum(), v.sum()
    else:
        def sums(w):
            odds = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col("z") * F.lit(float(w[0])) + F.lit(float(w[1]))))
            rows = some.select(((F.col("x") - F.lit(middle)) / F.lit(scale)).alias("z"), "label").withColumn("p", 1 / (1 + F.exp(-odds)))
            e, v, z = F.col("p") - F.col("label"), F.col("p") * (1 - F.col("p")), F.col("z")
            return tuple(rows.agg(F.sum(e * z), F.sum(e), F.sum(v * z * z), F.sum(v * z), F.sum(v)).first())
    return _logistic(n, ones, middle, scale, sums)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        discount: float = DISCOUNT, times: float = TIMES, slots: int = SLOTS, calibration_rows: int = CALIBRATION_ROWS) -> ToxicityModel:
    """Fits on labelled rows whose id is not held out.

    A quarter of the rows (crc32 mod 5 = 1) stays out of the counts; these calibrate the score, in Spark if
    they are more than ``calibration_rows``.  Null labels and ids are no
    labels; an id labelled twice is toxic if one label says so; repeated documents count as often as
    they occur.  Without rows of both classes the score is the share of toxic labels.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    known = saved(known.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label")), "labels")
    source = docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("text"))
    rows = join_measured(source, known, F.col("own_id") == F.col("id"), "inner")
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 5
    counts = rows.where(fold != 1).select("text", "label").mapInPandas(_counted, "pair long, toxic long, ordinary long")
    ratios, unseen = _ratios(counts, discount, times)
    model = ToxicityModel(saved(ratios, "ratios"), unseen, slots, 1.0, 0.0)
    some = saved(model.with_ratio(rows.where(fold == 1).select("text", "label", "id"), "text", "x").drop("text"), "calibration")
    slope, intercept = _calibrated(some, calibration_rows)
    model.slope, model.intercept = max(slope, 0.0), intercept
    return model


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more."""
    (score,) = fresh(docs, "_score")
    scored = fit(docs, labels, doc_id, text, **options).transform(docs, text, score)
    return scored.where(F.col(score) < threshold).drop(score)
