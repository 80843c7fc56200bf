"""Packing of tokenised documents into windows by best-fit decreasing.

1. One narrow pass tokenises each document, cuts what is overlong into full windows and returns a
   row for each piece (no ids, unless asked for).
2. Best fit needs only the number of pieces of each length, at most one number a length, so the
   plan is made on the driver whatever the size of the corpus: lengths in falling order, many
   windows of one capacity at a time, and a segment tree over remaining capacities that finds the tightest open window.
3. Pieces are numbered within their length, in buckets, so that a frequent length is split over
   many tasks; the number tells the place in the plan.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import saved

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
BUCKETS = 64
PIECE_CHARS = 1 << 20
REMEMBERED = 1_000_000
#: A mark after a letter or digit begins a new piece for the tokenizer, so a blank between them changes no id.
_MARK = re.compile(r"[.,;:!?*$%#&](?<=[^\W_].)")
#: Parts pieces that are encoded together; as a word of its own it is one id, which only words have that hold it once normalised (NFC).
STOP = "`"
_ENCODERS: dict[str | None, "Encoder"] = {}


class Places(dict):
    """Numbers of pieces; a new piece gets the next number and waits to be learned."""

    def __init__(self):
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.waiting.append(piece)
        return at


class Encoder:
    """Ids of a text by a tokenizer that never joins across a blank; ids of frequent pieces are remembered."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)  # without offsets
        own = self.encode([STOP], add_special_tokens=False)[0].ids
        self.stop = own[0] if len(own) == 1 else None
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        vocabulary = tokenizer.get_vocab()
        #: By id, whether it ends a word; None if the tokenizer's ids do not tell.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool) if suffix else None
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.place = Places()
        self.starts, self.sizes, self.known = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def learn(self) -> None:
        """Encodes the waiting pieces: words of letters as one text, where each ends with the id that ends a word; the others as one text,
        parted by a mark.  Those that hold the mark go one by one, and all others do where the marks do not add up."""
        pieces, self.place.waiting = self.place.waiting, []
        first, self.known = self.known, self.known + len(pieces)
        while self.known > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        # Each has an end at least, so that as many ends as words are one for each.  What grows a mark in lower case has more.
        words = [i for i, p in enumerate(pieces) if p.isalpha() and "\u0130" not in p] if self.ends is not None else []
        if words:
            ids = self._encoded([pieces[i] for i in words], " ")
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(words) and ends[-1] == len(ids) - 1:
                self._keep(first + np.array(words), ids, np.diff(ends, prepend=-1))
            else:
                words = []
        done = set(words)
        rest = [(i, p) for i, p in enumerate(pieces) if i not in done]
        marked = [(i, p) for i, p in rest if p and self.stop is not None and STOP not in (p if p.isascii() else unicodedata.normalize("NFC", p))]
        if marked:
            ids = self._encoded([p for _, p in marked], f" {STOP} ")
            stops = np.flatnonzero(ids == self.stop)
            if len(stops) == len(marked) - 1:
                sizes = np.diff(np.concatenate(([-1], stops, [len(ids)]))) - 1
                self._keep(first + np.array([i for i, _ in marked]), np.delete(ids, stops), sizes)
            else:
                marked = []
        done.update(i for i, _ in marked)
        for i, p in rest:
            if i not in done:
                ids = self._encoded([p], "")
                self._keep(np.array([first + i]), ids, np.array([len(ids)]))

    def _encoded(self, pieces: list[str], between: str) -> np.ndarray:
        return np.array(self.encode([between.join(pieces)], add_special_tokens=False)[0].ids, np.uint32)

    def _keep(self, places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[places], self.sizes[places] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > REMEMBERED:
            self.forget()
        pieces, counts = [], []
        for text in texts:
            own = _MARK.sub(r" \g<0>", text.replace("\n", " ")).split(" ")
            pieces += own
            counts.append(len(own))
        at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        if self.place.waiting:
            self.learn()
        sizes = self.sizes[at]
        after = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.starts[at] - after + sizes, sizes) + np.arange(sizes.sum())]
        return np.split(flat, after[np.cumsum(counts) - 1][:-1])

    def many(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text; short texts are handled together, long ones in parts that end at a blank."""
        waiting, size = [], 0
        for text in texts:
            if size + len(text) > PIECE_CHARS and waiting:
                yield from self._some(waiting)
                waiting, size = [], 0
            if len(text) > PIECE_CHARS:
                parts, at = [], 0
                while at < len(text):
                    end = text.find(" ", at + PIECE_CHARS)
                    end = len(text) if end < 0 else end
                    parts += self._some([text[at:end]])
                    at = end
                yield np.concatenate(parts)
            else:
                waiting.append(text)
                size += len(text)
        if waiting:
            yield from self._some(waiting)

    def ids(self, text: str) -> np.ndarray:
        return next(self.many([text]))


def _pieces(window: int, end_id: int, path: str | None, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))  # kept between a worker's tasks
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            texts = (text.as_py() or "" for text in batch.column("text"))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.many(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start:start + window].tobytes()
                    row = (doc, start, len(piece) // 4, zlib.crc32(piece), len(ids), piece)
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return rows


class TightestOpen:
    """Segment tree over remaining capacities: the smallest one of at least a size with open windows."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.any = [False] * (2 * self.width)
        self.groups: list[deque] = [deque() for _ in range(self.width)]

    def add(self, capacity: int, first: int, n: int) -> None:
        self.groups[capacity].append((first, n))
        at = capacity + self.width
        while at and not self.any[at]:
            self.any[at] = True
            at //= 2

    def take(self, capacity: int) -> tuple[int, int]:
        group = self.groups[capacity].popleft()
        if not self.groups[capacity]:
            at = capacity + self.width
            self.any[at] = False
            while at > 1:
                at //= 2
                self.any[at] = self.any[2 * at] or self.any[2 * at + 1]
        return group

    def find(self, size: int) -> int | None:
        at = size + self.width
        if not self.any[at]:
            while at > 1 and not (at % 2 == 0 and self.any[at + 1]):
                at //= 2
            if at == 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.width


def plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Best-fit decreasing over numbers of pieces by length.

    Rows (length, first number, pieces, first window, offset), sorted: piece ``i`` of ``length`` with
    first <= i < first + pieces lies in window ``first window + i - first``.
    """
    open_windows, rows, opened = TightestOpen(window), [], 0
    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        while left:
            capacity = open_windows.find(length)
            if capacity is None:
                capacity, each = window, window // length
                first, n = opened, -(-left // each)
                opened += n
            else:
                each = capacity // length
                first, n = open_windows.take(capacity)
            full = min(n, left // each)
            part = min(left - full * each, each) if full < n else 0
            for windows, at, items in ((full, first, each), (1, first + full, part)):
                if windows and items:
                    for k in range(items):
                        rows.append((length, number, windows, at, window - capacity + k * length))
                        number += windows
                    left -= windows * items
                    open_windows.add(capacity - items * length, at, windows)
            rest = n - full - (part > 0)
            if rest:
                open_windows.add(capacity, first + n - rest, rest)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(shared):
    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows = shared.value
        keys = (rows[:, 0] << 40) + rows[:, 1]  # far fewer than 2**40 pieces of one length
        at = np.searchsorted(keys, (lengths.to_numpy() << 40) + numbers.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": rows[at, 3] + numbers.to_numpy() - rows[at, 1], "offset": rows[at, 4]})

    return place


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID,
         tokenizer: str | None = None, with_ids: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is the ids of its text and ``end_id``; null and empty texts have that id alone.
    Documents longer than ``window`` are cut into full windows and a rest; nothing else is cut.
    Sequences are numbered from 0 and filled from offset 0 without gaps.  ids: the piece as little-endian 32-bit ids.
    Repeated rows are pieces of their own; other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    pieces = saved(source.mapInArrow(_pieces(window, end_id, tokenizer, with_ids), schema), "pieces")
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = saved(rows.groupBy("length", "bucket").count(), "sizes")  # at most window * buckets rows
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(plan(counts, window))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("length", "bucket", "base")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    numbered = rows.withColumn("nth", F.row_number().over(inside)).join(bases, ["length", "bucket"])
    placed = numbered.withColumn("at", _placed(shared)("length", F.col("nth") - 1 + F.col("base")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset", *["ids"] * with_ids)


def padded_length(filled: int, window: int = WINDOW) -> int:
    """A sequence is padded to the window, except where it ends at a power of two."""
    return filled if filled and filled & (filled - 1) == 0 else window


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the padded sequences of ``pack(..., with_ids=True)``.

    A group holds one window at most.
    """

    @F.pandas_udf("binary")
    def padded(parts: pd.Series) -> pd.Series:
        joined = [b"".join(p["ids"] for p in row) for row in parts]
        return pd.Series([x + np.full(padded_length(len(x) // 4, window) - len(x) // 4, pad_id, "<u4").tobytes() for x in joined])

    part = F.struct("offset", "ids", "doc_id", "length")
    grouped = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select("sequence_id", padded("parts").alias("ids"), F.col("parts.doc_id").alias("doc_ids"),
                          F.col("parts.length").alias("lengths"))
