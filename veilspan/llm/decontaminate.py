"""Benchmark decontamination: a broadcast set of normalised item n-grams, scanned over token windows.

Words of the items become numbers; a document's words that no item has become zero.  Windows are
compared by a rolling hash over the numbers and every hit is verified on the numbers themselves.
A benchmark of more than ``BLOCK_WORDS`` words is scanned in blocks of items, each of which is
broadcast by itself, so that what is broadcast never exceeds that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, fresh, saved

N = 10
BLOCK_WORDS = 2_000_000
#: Everything but 0-9, a-z and bytes above 127 parts words; A-Z turn into a-z.
_WORD = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
_SPLIT = bytes(LOWER[b] if LOWER[b] in _WORD else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20
HITS = "n_words long, n_hit long, spans array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split()


class Grams:
    """The windows of some items: numbers of words, window hashes, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.numbers: dict[bytes, int] = {}
        self.windows: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item_id, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            if not ids:
                continue
            size = min(n, len(ids))
            known = self.windows.setdefault(size, {})
            for at in range(len(ids) - size + 1):
                found = known.setdefault(tuple(ids[at:at + size]), set())
                if item_id is not None:
                    found.add(item_id)
        self.hashes = {size: np.unique(_rolled(np.array(list(known), np.uint64)).ravel()) for size, known in self.windows.items()}

    def ids(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words, zero where no item has the word; long texts in pieces."""
        data = (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT)
        get, parts, at = self.numbers.get, [], 0
        while at < len(data):
            end = data.find(b" ", at + _PIECE)
            end = len(data) if end < 0 else end
            found = data[at:end].split()
            parts.append(np.fromiter((get(w, 0) for w in found), np.uint64, len(found)))
            at = end
        return np.concatenate(parts) if parts else np.array([], np.uint64)

    def hits(self, ids: np.ndarray) -> tuple[list[int], set[str]]:
        """Spans [from, to) of hit words as a flat list, in order and apart; items that occur."""
        marks = np.zeros(len(ids) + 1, np.int64)
        items: set[str] = set()
        for size, known in self.windows.items():
            if len(ids) < size:
                continue
            zeros = np.concatenate(([0], np.cumsum(ids == 0)))
            whole = np.flatnonzero(zeros[size:] == zeros[:-size])
            if not len(whole):
                continue
            rolled = _rolled(np.lib.stride_tricks.sliding_window_view(ids, size)[whole])
            table = self.hashes[size]
            place = np.searchsorted(table, rolled)
            place[place == len(table)] = 0
            for at in whole[table[place] == rolled].tolist():
                window = tuple(ids[at:at + size].tolist())
                if window in known:
                    items |= known[window]
                    marks[at] += 1
                    marks[at + size] -= 1
        edges = np.diff(np.concatenate(([0], (np.cumsum(marks)[:-1] > 0).astype(np.int8), [0])))
        spans = np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1).ravel().tolist()
        return spans, items


def _rolled(windows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(windows), np.uint64)
    for column in range(windows.shape[1] if windows.ndim == 2 else 0):
        out = out * _BASE + windows[:, column]
    return out


def _joined(spans: list[int]) -> list[int]:
    """Flat spans in any order, merged where they overlap or touch."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scanner(shared, n: int):
    @F.pandas_udf(HITS)
    def scan(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        grams = Grams(shared.value, n)
        for texts, before in batches:
            rows = []
            for text, spans, items in zip(texts, before["spans"], before["items"]):
                ids = grams.ids(text)
                found, named = grams.hits(ids)
                if spans is not None and len(spans):
                    found = _joined(list(spans) + found)
                rows.append((len(ids), sum(found[1::2]) - sum(found[::2]), found, sorted(named | set(items if items is not None else ()))))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "spans", "items"])

    return scan


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Distinct items in blocks of at most about ``block_words`` words, each small enough to broadcast."""
    items = saved(benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
                  .where("text is not null").distinct(), "items")
    weight = F.length("text") / 2 + 1  # at least as many as its words
    total = items.agg(F.sum(weight)).first()[0] or 0
    blocks = max(1, int(total // block_words) + 1)
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        yield [(r["item_id"], r["text"]) for r in numbered.where(F.col("block") == block).select("item_id", "text").collect()]


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
              n: int = N, block_words: int = BLOCK_WORDS, name: str = "hits") -> DataFrame:
    """``docs`` plus a struct ``name``: n_words, n_hit (words hit), spans (flat [from, to) word positions), items (sorted).

    A window is ``n`` consecutive words of an item; a shorter item is one window, an item without
    words none.  Null texts have no words.  A repeated item counts once; an item whose id is
    null marks words but is not named.  Rows keep their columns and stay apart; an empty table or benchmark is fine.
    """
    context = docs.sparkSession.sparkContext
    out = docs
    before = F.struct(F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for at, block in enumerate(_blocks(benchmark, item_id, item_text, block_words)):
        scan = _scanner(context.broadcast(block), n)
        out = out.withColumn(name, scan(F.col(text), F.col(name) if at else before))
    return out


def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, flat in zip(texts, spans):
        if text is not None and flat is not None and len(flat):
            data = text.encode("utf-8", "surrogatepass")
            parted = np.frombuffer(data.translate(_SPLIT), np.uint8) != 32
            edges = np.diff(np.concatenate(([0], parted.astype(np.int8), [0])))
            starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            kept, at = [], 0
            for a, b in zip(flat[::2], flat[1::2]):
                kept.append(data[at:starts[a]])
                at = int(ends[b - 1])
            text = b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")
        out.append(text)
    return pd.Series(out, dtype=object)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents (mode "documents") or without the hit words (mode "spans")."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    (hits,) = fresh(docs, "_hits")
    found = with_hits(docs, benchmark, text, name=hits, **options)
    if mode == "documents":
        return found.where(F.size(f"{hits}.spans") == 0).drop(hits)
    return found.withColumn(text, F.pandas_udf(_without, "string")(F.col(text), F.col(f"{hits}.spans"))).drop(hits)
