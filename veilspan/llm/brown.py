"""Language-model scoring by class n-grams: words fall into classes, classes follow each other.

P(text) is the product over its tokens of P(class | class before) * P(word | class).  Classes are found by
exchange: a word moves to the class that raises the likelihood of the class bigrams most, given all others.

1. Words of the training texts are counted (all of them, by 64-bit hash).
2. Exchange works on units.  A word among the ``UNITS`` most frequent is a unit of its own; every other word, known or not,
   belongs to the unit of its spelling: its last two bytes, its length and the kind of its first byte.  So each
   word has a class, also one that no training text has.
3. Pairs of neighbouring units are counted over all training texts and kept as one row per unit: its neighbours on both sides.
   A row has at most as many entries as there are units.
4. A sweep is two narrow passes over these rows: class pairs are summed, and half of the units choose
   their best class.  The driver sees the classes of the units and the class pairs only, both of fixed size.
   A sweep that does not raise the likelihood is undone and a smaller share of units moves next.
5. Emissions are (count + DELTA) / (count of the class + DELTA * (words of the class + 1)), so each class keeps a place for an unseen
   word; transitions are discounted and back off to the share of the class.
6. Texts are scored in one narrow pass: transitions, and the words among the ``SHARED`` most frequent, whose counts are
   broadcast.  The others are joined to their counts, one row for each text and word.  No such word is
   frequent, so that no key is hot; texts do not move.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, fresh, saved

CLASSES = 64
UNITS = 1 << 14
SPELLINGS = 1 << 12  # as many as ``spelling`` has bits for
SHARED = 1 << 18
SWEEPS = 8
DELTA = 0.1
DISCOUNT = 0.6
PIECE = 1 << 20
CHUNK = 1 << 19  # tokens counted at a time; Spark sums over a task before it shuffles
WORDS = 1 << 17  # different words counted at a time
AT_ONCE = 1 << 16  # rows of counts handed over at a time
TEXTS = 1 << 10  # texts scored at a time
MEMO = 1 << 18
#: The mark behind each text: its hash is no word's, since words are not empty.
END_HASH = xxhash.xxh64_intdigest(b"")


def trained_on(doc_id: Column) -> Column:
    """Nine tenths of the ids; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 != 0


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text (A-Z in lower case, parted by ASCII blanks); long texts in parts that end at a blank."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


#: What a first byte is: a letter, a digit, a mark, or a part of another alphabet.
_KIND = [1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if b < 128 else 4 for b in range(256)]


def spelling(word: bytes) -> int:
    """The spelling of a word as a number below ``SPELLINGS``."""
    ends = word[-1] + 256 * (word[-2] if len(word) > 1 else 0)
    return ((ends * 5 + _KIND[word[0]]) * 4 + min(len(word), 12) // 4) * 2654435761 % (1 << 32) >> 20


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


# --- counting ----------------------------------------------------------------------------

def _rows(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Columns as batches of at most ``AT_ONCE`` rows."""
    for at in range(0, len(next(iter(columns.values()))), AT_ONCE):
        yield pa.RecordBatch.from_pydict({name: pa.array(column[at:at + AT_ONCE]) for name, column in columns.items()})


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(words: Counter, ends: int) -> Iterator[pa.RecordBatch]:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        return _rows(h=np.append(hashes, np.uint64(END_HASH)).view(np.int64),
                     s=np.append(np.fromiter(map(spelling, words), np.int32, len(words)), np.int32(-1)),
                     n=np.append(np.fromiter(words.values(), np.int64, len(words)), ends))

    words, ends, size = Counter(), 0, 0
    for batch in batches:
        for text in batch.column("text"):
            for part in pieces(text.as_py()):
                words.update(part)
                size += len(part)
            ends += 1
            if size > CHUNK or len(words) > WORDS:
                yield from counted(words, ends)
                words, ends, size = Counter(), 0, 0
    if ends:
        yield from counted(words, ends)


class Codes(dict):
    """Codes of words: a frequent one's rank, and -1 - spelling for all others.  Words met so far are kept, up to a bound."""

    def __init__(self, ranks: dict[int, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        code = self.ranks.get(_signed(xxhash.xxh64_intdigest(word)))
        self[word] = code = -1 - spelling(word) if code is None else code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def ranks(hashes: np.ndarray) -> dict[int, int]:
    return dict(zip(hashes.tolist(), range(len(hashes))))


def unit_of(codes: np.ndarray, own: int) -> np.ndarray:
    """Units: the ``own`` most frequent words by rank, then the spellings."""
    return np.where(codes >= 0, codes, own - 1 - codes)


def _pair_counts(shared, own: int, end: int):
    """(a, b, n) for neighbouring units; ``end`` parts texts and begins the first one of all."""
    def counted(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.unique(np.concatenate(parts), return_counts=True)
        return _rows(a=(pairs >> 32).astype(np.int32), b=(pairs & 0xFFFFFFFF).astype(np.int32), n=n)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, size = Codes(ranks(shared.value)), [], 0
        for batch in batches:
            for text in batch.column("text"):
                before = end
                for part in pieces(text.as_py()):
                    if part:
                        codes = unit_of(known.of(part), own)
                        waiting.append((np.append(before, codes[:-1]) << 32) | codes)
                        before, size = codes[-1], size + len(part)
                waiting.append(np.array([(int(before) << 32) | end], np.int64))
                if size > CHUNK or len(waiting) > MEMO:
                    yield from counted(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from counted(waiting)
    return walk


# --- exchange ----------------------------------------------------------------------------

def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(pairs: np.ndarray) -> float:
    """The part of the log-likelihood that classes decide: pairs of classes against the classes alone."""
    return float(_x_log_x(pairs).sum() - _x_log_x(pairs.sum(0)).sum() - _x_log_x(pairs.sum(1)).sum())


def _by_class(ids: np.ndarray, n: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    return np.bincount(of[ids], weights=n, minlength=classes)


def _best(left: np.ndarray, right: np.ndarray, self_pairs: float, own: int, pairs: np.ndarray, logs: np.ndarray,
          rows: np.ndarray, cols: np.ndarray) -> tuple[int, float]:
    """The class (not 0, the end's) that a unit should be in, and what the likelihood gains by it.

    left, right: the unit's neighbours by class, without itself; pairs, rows, cols: counts with the unit taken out; logs: ``pairs`` in x log x.
    """
    at_r, at_l = np.flatnonzero(right), np.flatnonzero(left)
    gain = (_x_log_x(pairs[:, at_r] + right[at_r]) - logs[:, at_r]).sum(1)
    gain += (_x_log_x(pairs[at_l, :] + left[at_l, None]) - logs[at_l, :]).sum(0)
    same = np.arange(len(pairs))
    inner = pairs[same, same]
    # A class's pairs with itself take from both sides at once.
    gain += (_x_log_x(inner + left + right + self_pairs) - _x_log_x(inner + right) - _x_log_x(inner + left) + _x_log_x(inner))
    out, into = right.sum() + self_pairs, left.sum() + self_pairs
    # Whatever the class, the neighbours' own classes get their pairs back.
    rows, cols = rows + left, cols + right
    gain -= _x_log_x(rows + out) - _x_log_x(rows) + _x_log_x(cols + into) - _x_log_x(cols)
    gain[0] = -np.inf
    best = int(np.argmax(gain))
    return best, float(gain[best] - gain[own])


def _sums(shared, classes: int):
    """Class pairs of a part of the units, from their right neighbours."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shared.value, np.zeros(classes * classes)
        for batch in batches:
            for unit, right in zip(batch.column("unit").to_pylist(), batch.column("right")):
                if right.is_valid:
                    ids, n = right.values.field(0).to_numpy(), right.values.field(1).to_numpy()
                    total[of[unit] * classes:(of[unit] + 1) * classes] += _by_class(ids, n, of, classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])
    return walk


def _moves(shared, classes: int, seed: int, share: float):
    """New classes of the units that move, each seen against the counts with the moves before it in this task."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pairs = shared.value
        of, pairs = of.copy(), pairs.copy()
        rows, cols, logs = pairs.sum(1), pairs.sum(0), _x_log_x(pairs)
        for batch in batches:
            units, new = [], []
            for unit, left, right in zip(batch.column("unit").to_pylist(), batch.column("left"), batch.column("right")):
                if of[unit] == 0 or xxhash.xxh32_intdigest(str(unit), seed) >= share * (1 << 32):
                    continue
                sides = []
                for side in (left, right):
                    ids, n = (side.values.field(0).to_numpy(), side.values.field(1).to_numpy()) if side.is_valid else (np.zeros(0, np.int64), np.zeros(0))
                    itself = ids == unit
                    sides.append((_by_class(ids[~itself], n[~itself], of, classes), float(n[itself].sum())))
                (l, _), (r, own) = sides
                a = int(of[unit])

                def put(sign: float, c: int) -> None:
                    pairs[c, :] += sign * r
                    pairs[:, c] += sign * l
                    pairs[c, c] += sign * own
                    rows[:] += sign * l
                    cols[:] += sign * r
                    rows[c] += sign * (r.sum() + own)
                    cols[c] += sign * (l.sum() + own)
                    logs[c, :], logs[:, c] = _x_log_x(pairs[c, :]), _x_log_x(pairs[:, c])
                put(-1.0, a)
                b, gain = _best(l, r, own, a, pairs, logs, rows, cols)
                b = b if gain > 1e-6 else a
                put(1.0, b)
                if a != b:
                    of[unit] = b
                    units.append(unit)
                    new.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(new, pa.int32())], names=["unit", "class"])
    return walk


def exchange(neighbours: DataFrame, of: np.ndarray, classes: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the units after ``sweeps`` sweeps, and the counts of class pairs under them.

    neighbours: (unit, left, right), saved; left and right are arrays of (unit, n).  Class 0 belongs to the end alone.
    """
    context = neighbours.sparkSession.sparkContext

    def class_pairs(assigned: np.ndarray) -> np.ndarray:
        shared = context.broadcast(assigned)
        found = neighbours.select("unit", "right").mapInArrow(_sums(shared, classes), "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        pairs = np.zeros(classes * classes)
        pairs[found["at"].to_numpy(int)] = found["n"].to_numpy(float)
        shared.destroy()
        return pairs.reshape(classes, classes)

    best, pairs = of, class_pairs(of)
    score, share = likelihood(pairs), 0.5
    for sweep in range(sweeps):
        shared = context.broadcast((best, pairs))
        moved = neighbours.mapInArrow(_moves(shared, classes, sweep, share), "unit int, class int").toPandas()
        shared.destroy()
        if moved.empty:
            break
        tried = best.copy()
        tried[moved["unit"].to_numpy(int)] = moved["class"].to_numpy()
        after = class_pairs(tried)
        if likelihood(after) > score:
            gained, best, pairs, score = likelihood(after) - score, tried, after, likelihood(after)
            if gained < 1e-5 * abs(score):
                break
        else:
            share /= 2
    return best, pairs


# --- the model ---------------------------------------------------------------------------

@dataclass
class Tables:
    """What every task needs; all of it is bounded.

    hashes, counts, spellings: the most frequent words, most frequent first; own: how many of them are units; of: classes of
    the units; transitions, denominators: logarithms.
    """

    hashes: np.ndarray
    counts: np.ndarray
    spellings: np.ndarray
    own: int
    of: np.ndarray
    transitions: np.ndarray
    denominators: np.ndarray
    tokens: int
    vocabulary: int
    ends: int

    def classes(self) -> np.ndarray:
        """Classes by code: frequent words by rank, then, from the back, the spellings."""
        units = np.append(np.arange(self.own), self.own + self.spellings[self.own:])
        return self.of[np.append(units, self.own + np.arange(SPELLINGS - 1, -1, -1))]


PARTS = "n_tokens long, n_known long, base double, model double, h array<long>, n array<long>"


def _parts(shared):
    """Per text what is known without the rare words' counts; those add log10(count + DELTA) later."""
    def walk(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t: Tables = shared.value
        known, of, logs = Codes(ranks(t.hashes)), t.classes(), np.log10(t.counts + DELTA)
        whole = math.log10(t.tokens + DELTA * (t.vocabulary + 1.0))

        def one(text: str | None) -> tuple:
            before, model, counted, tokens, seen, rare = 0, 0.0, 0.0, 1, int(t.ends > 0), Counter()
            for part in pieces(text):
                if part:
                    codes = known.of(part)
                    cls, often = of[codes], codes >= 0
                    model += float(t.transitions[np.append(before, cls[:-1]), cls].sum() - t.denominators[cls].sum())
                    counted += float(logs[codes[often]].sum())
                    before, tokens, seen = int(cls[-1]), tokens + len(part), seen + int(often.sum())
                    rare.update(part[i] for i in np.flatnonzero(~often))
            base = counted + math.log10(t.ends + DELTA) - tokens * whole
            return (tokens, seen, base, model + counted + float(t.transitions[before, 0]),
                    [_signed(xxhash.xxh64_intdigest(w)) for w in rare], list(rare.values()))

        for batch in texts:
            for at in range(0, len(batch), TEXTS):
                yield pd.DataFrame([one(text) for text in batch.iloc[at:at + TEXTS]], columns=["n_tokens", "n_known", "base", "model", "h", "n"])
    return walk


class BrownModel:
    """A fitted model.  ``words``: (h, n), saved: counts of the words that are not broadcast."""

    def __init__(self, tables: Tables, words: DataFrame, pairs: np.ndarray):
        self.tables, self.words, self.pairs = tables, words, pairs
        self.shared = words.sparkSession.sparkContext.broadcast(tables)

    def score(self, docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
        """The columns ``keep`` (all but the text by default) plus n_tokens, n_known, train_tokens, base_score and score.

        One row comes out for each that goes in; null and empty texts have the end alone.  Kept columns of these names are
        left out.  Logarithms have base 10.
        """
        added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
        keep = [c for c in (keep if keep is not None else docs.columns) if c != text and c.lower() not in added]
        own, row = fresh(docs, "_parts", "_row")
        parts = docs.select(*[F.col(f"`{c}`") for c in keep], F.pandas_udf(_parts(self.shared), PARTS)(F.col(text)).alias(own))
        parts = saved(parts.withColumn(row, F.monotonically_increasing_id()), "parts")
        rare = parts.select(row, F.explode(F.arrays_zip(F.col(f"{own}.h").alias("h"), F.col(f"{own}.n").alias("n"))).alias("w")).select(row, "w.h", "w.n").join(
            self.words.withColumnRenamed("n", "c"), "h", "left")
        late = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(DELTA))
        sums = rare.groupBy(row).agg(F.sum(late).alias("late"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("more"))
        sums = sums.withColumnRenamed(row, "of_row")
        out = parts.join(sums, parts[row] == sums["of_row"], "left")
        late, more = F.coalesce("late", F.lit(0.0)), F.coalesce("more", F.lit(0))
        return out.select(*[F.col(f"`{c}`") for c in keep], F.col(f"{own}.n_tokens").alias("n_tokens"), (F.col(f"{own}.n_known") + more).alias("n_known"),
                          F.lit(self.tables.tokens).cast("long").alias("train_tokens"), (F.col(f"{own}.base") + late).alias("base_score"),
                          (F.col(f"{own}.model") + late).alias("score"))


def _most_frequent(words: DataFrame, bound: int) -> DataFrame:
    """The words above a count chosen so that at most ``bound`` of them are; words of one count are all in or all out."""
    step = F.floor(F.log2("n") * 64)
    sizes = words.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.col("step").desc()).collect()
    least, room = None, bound
    for s in sizes:
        room -= s["words"]
        if room < 0:
            break
        least = s["least"]
    return words.where(F.lit(False) if least is None else F.col("n") >= least)


def fit(docs: DataFrame, text: str = "text", classes: int = CLASSES, units: int = UNITS, shared: int = SHARED, sweeps: int = SWEEPS) -> BrownModel:
    """Learns from all rows of ``docs``.  Null texts are empty; repeated rows count as often as they occur.

    Without rows no word is known and all classes are as likely; scores are defined then too.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(text).alias("text"))
    # The spelling follows from the word, so that it is the same for all rows of a hash.
    counts = saved(source.mapInArrow(_word_counts, "h long, s int, n long").groupBy("h").agg(F.max("s").alias("s"), F.sum("n").alias("n")), "words")
    ends = counts.where("s < 0").agg(F.sum("n")).first()[0] or 0
    words = counts.where("s >= 0")
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    tokens, vocabulary = whole["tokens"] + ends, whole["words"] + (ends > 0)
    often = _most_frequent(words, shared).select("h", "s", "n").toPandas().sort_values(["n", "h"], ascending=[False, True])
    hashes, spellings, sizes = (often[c].to_numpy(np.int64) for c in ("h", "s", "n"))
    own = min(units, len(hashes))
    end = own + SPELLINGS
    # Frequent words are dealt out in turn; spellings too, by number.
    of = np.arange(end + 1) % (classes - 1) + 1
    of[end] = 0
    unit_hashes = spark.sparkContext.broadcast(hashes[:own])
    pairs = saved(source.mapInArrow(_pair_counts(unit_hashes, own, end), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    rights = pairs.groupBy(F.col("a").alias("unit")).agg(F.collect_list(F.struct("b", "n")).alias("right"))
    lefts = pairs.groupBy(F.col("b").alias("unit")).agg(F.collect_list(F.struct("a", "n")).alias("left"))
    neighbours = saved(rights.join(lefts, "unit", "full").select("unit", "left", "right"), "neighbours")
    of, between = exchange(neighbours, of, classes, sweeps)
    shares = (between.sum(0) + 0.5) / (between.sum() + 0.5 * classes)
    rows = between.sum(1, keepdims=True)
    backed = DISCOUNT * (between > 0).sum(1, keepdims=True) * shares
    transitions = np.where(rows > 0, (np.maximum(between - DISCOUNT, 0) + backed) / np.maximum(rows, 1), shares)
    # Words and tokens of each class: all by spelling, less the units of their own, which count where they are.
    by_spelling = words.groupBy("s").agg(F.sum("n").alias("n"), F.count("*").alias("w")).toPandas()
    held = np.zeros((2, classes))
    spelled = of[own + by_spelling["s"].to_numpy(int)]
    for row, all_of_it, each in ((0, by_spelling["n"].to_numpy(float), sizes[:own]), (1, by_spelling["w"].to_numpy(float), np.ones(own))):
        np.add.at(held[row], spelled, all_of_it)
        np.add.at(held[row], of[own + spellings[:own]], -each)
        np.add.at(held[row], of[:own], each)
    tables = Tables(hashes, sizes, spellings, own, of, np.log10(transitions), np.log10(held[0] + DELTA * (held[1] + 1.0)),
                    int(tokens), int(vocabulary), int(ends))
    least = None if often.empty else int(sizes[-1])
    rest = words.select("h", "n") if least is None else words.where(F.col("n") < least).select("h", "n")
    return BrownModel(tables, rest, between)
