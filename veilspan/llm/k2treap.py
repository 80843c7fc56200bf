"""Ranked lexical search over a K2-treap: a compressed quadtree of the grid of terms and documents.

1. One narrow pass over whole texts counts, for each document, its terms and how often the asked ones occur.
   Only these counts are kept; statistics of all documents follow from them.
2. The documents are dealt into grids of at most ``COLUMNS`` columns; the rows of a grid are the asked terms.  A cell of
   the finest level is a term's impact in a document; a cell above holds the largest impact below it and one bit for
   each part that is not empty, so that empty parts of the grid take no room.  Rows are split in four, columns in
   two, until the rows are single: then only columns are split.
3. An item's terms are row paths.  They descend jointly, best first: a document range's bound is the sum of the
   impact maxima of its terms' cells, and a range that cannot beat the ten best so far is never opened.  A range of one
   document has its exact score.
4. The best of all grids meet in two rounds, so that no task reads more than ``SPREAD`` partial results of an item from each task.

Columns stand in the order of the documents' commonest terms, so that documents of one language or topic are
neighbours and ranges of others drop out at once.  All arithmetic is in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import LOWER, saved

COLUMNS = 1 << 14
POSTINGS = 1 << 19  # of a grid: a worker's memory is some hundred bytes for each
AT_ONCE = 1 << 10
TOP = 10
WIDE = 128       # ranges opened at a time
FRONTIER = 1 << 23  # cells that wait at most, before ranges are opened depth first
TERMS_AT_ONCE = 1 << 17
SPREAD = 16
PIECE = 1 << 20
_SPLIT = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in LOWER)


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case; long texts in parts that end at a blank."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


# --- statistics --------------------------------------------------------------------------

def _item_terms(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted({w.decode("utf-8", "replace") for part in terms_of(t) for w in part}) for t in texts], dtype=object)


COUNTED = "id long, n long, rows array<int>, tfs array<long>"


def _counted(shared):
    """The number of terms of a text, and row and count of each asked term in it."""
    def counted(ids: pa.Array, texts: pa.Array, get) -> pa.RecordBatch:
        sizes, held, rows, tfs = [], [0], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for text in texts:
            n, found = 0, []
            for part in terms_of(text.as_py()):
                n += len(part)
                found.append(np.array([i for i in map(get, part) if i is not None], np.int32))
            at, tf = np.unique(np.concatenate(found), return_counts=True) if found else (rows[0], tfs[0])
            sizes.append(n)
            held.append(held[-1] + len(at))
            rows.append(at)
            tfs.append(tf)
        ends = pa.array(held, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in ((rows, pa.int32()), (tfs, pa.int64()))]
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *lists], names=["id", "n", "rows", "tfs"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {w.encode("utf-8"): i for i, w in enumerate(shared.value)}.get
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                yield counted(part.column("id"), part.column("text"), get)
    return walk


# --- the grid ----------------------------------------------------------------------------

class Treap:
    """A K2-treap over (row, column, impact); cells of all levels lie one level after the other.

    mask: which parts of a cell are not empty; base: where the first of them lies; top: the largest impact below.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, n_rows: int, n_columns: int):
        bits = max(1, int(n_rows - 1).bit_length())
        # Two bits of the row and one of the column at each level, as long as there are bits of the row.
        self.depth = max(1, int(n_columns - 1).bit_length(), -(-bits // 2))
        self.row_bits = [max(0, min(2, bits - 2 * k)) for k in range(self.depth)]
        self.digits = np.zeros((self.depth, n_rows), np.int64)
        left = bits
        for k, b in enumerate(self.row_bits):
            left -= b
            self.digits[k] = (np.arange(n_rows) >> left) & ((1 << b) - 1)
        code = np.zeros(len(rows), np.int64)
        for k, b in enumerate(self.row_bits):
            code = (code << (b + 1)) | (self.digits[k][rows] << 1) | ((columns >> (self.depth - 1 - k)) & 1)
        order = np.argsort(code)
        code, top = code[order], impacts[order]
        levels = [(None, None, top)]
        for b in reversed(self.row_bits):
            above = code >> (b + 1)
            starts = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
            mask = np.bitwise_or.reduceat((1 << (code & ((1 << (b + 1)) - 1))).astype(np.uint8), starts)
            top = np.maximum.reduceat(top, starts)
            levels.append((mask, starts.astype(np.int32), top))
            code = above[starts]
        levels.reverse()
        sizes = np.cumsum([0] + [len(x[2]) for x in levels])
        # A cell has at most eight parts, and a grid far fewer than 2**31 cells: small types, since a worker's memory is short.
        self.mask = np.concatenate([x[0] if x[0] is not None else np.zeros(len(x[2]), np.uint8) for x in levels])
        self.base = np.concatenate([x[1] + np.int32(sizes[k + 1]) if x[1] is not None else np.zeros(len(x[2]), np.int32) for k, x in enumerate(levels)])
        self.top = np.concatenate([x[2] for x in levels])

    def best(self, rows: np.ndarray, ids: np.ndarray, top: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the ``top`` largest sums over ``rows`` that reach ``floor``, and the sums; of equal sums those of the smaller ``ids``."""
        rows = np.sort(rows)
        # Waiting ranges: level, column, bound, and where their cells are kept.
        level, column, slot = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([self.top[0] * len(rows)])
        kept, free = np.zeros((4 * WIDE, len(rows)), np.int32), np.arange(4 * WIDE - 1, 0, -1)
        columns, scores, worst = np.zeros(0, np.int64), np.zeros(0, np.int64), floor
        while len(level):
            if len(level) * len(rows) > FRONTIER:
                first = np.lexsort((-bound, -level))[:WIDE]  # the deepest first, so that ranges are closed before more are opened
            else:
                first = np.argpartition(-bound, WIDE)[:WIDE] if len(bound) > WIDE else np.arange(len(bound))
            chosen = np.zeros(len(level), bool)
            chosen[first] = True
            cell = kept[slot[chosen]]
            digit = self.digits[level[chosen][:, None], rows[None, :]] << 1
            mask, base, full = self.mask[cell], self.base[cell], cell >= 0
            opened = []
            for half in (0, 1):
                here = digit | half
                there = full & ((mask >> here) & 1 == 1)
                child = np.where(there, base + np.bitwise_count(mask & ((1 << here) - 1)), -1)
                opened.append((level[chosen] + 1, (column[chosen] << 1) | half, child, np.where(there, self.top[child], 0).sum(1)))
            at, col, cell, sums = (np.concatenate([a, b]) for a, b in zip(*opened))
            done = (at == self.depth) & (sums >= worst)
            if done.any():
                columns, scores = np.append(columns, col[done]), np.append(scores, sums[done])
                best = np.lexsort((ids[columns], -scores))[:top]
                columns, scores = columns[best], scores[best]
                worst = max(floor, scores[-1]) if len(scores) == top else floor
            going, still = (at < self.depth) & (sums >= worst), ~chosen & (bound >= worst)
            free = np.append(free, slot[~still])
            wanted = int(going.sum())
            if wanted > len(free):
                grown = np.zeros((len(kept) + max(wanted, len(kept)), len(rows)), np.int32)
                grown[:len(kept)] = kept
                free, kept = np.append(free, np.arange(len(kept), len(grown))), grown
            taken, free = free[len(free) - wanted:], free[:len(free) - wanted]
            kept[taken] = cell[going]
            level, column = np.append(level[still], at[going]), np.append(column[still], col[going])
            slot, bound = np.append(slot[still], taken), np.append(bound[still], sums[going])
        return columns, scores


def _grid_order(at: np.ndarray, columns: np.ndarray, n: np.ndarray, n_rows: int) -> np.ndarray:
    """New places of the documents: by which of the commonest terms they hold, then by length."""
    df = np.bincount(at, minlength=n_rows)
    key = np.zeros(len(n), np.int64)
    for bit, row in enumerate(np.argsort(-df, kind="stable")[:24]):
        key[columns[at == row]] |= np.int64(1) << (23 - bit)
    place = np.empty(len(n), np.int64)
    place[np.lexsort((n, key))] = np.arange(len(n))
    return place


FOUND = "item int, id long, missing boolean, row long, score long"


def _searched(shared, all_docs: int, all_terms: int, top: int):
    """Grids over the documents of one task, each searched for all items."""
    def search(parts: list[pd.DataFrame], floors: np.ndarray) -> pd.DataFrame:
        place_of, weights, asked = shared.value
        docs = pd.concat(parts, ignore_index=True)
        held = docs["rows"].map(len).to_numpy()
        at = place_of[np.concatenate(docs["rows"].to_numpy()).astype(np.int64)]
        tf, n = np.concatenate(docs["tfs"].to_numpy()).astype(np.int64), docs["n"].to_numpy(np.int64)
        m = 10 + (90 * n * all_docs) // all_terms
        impact = weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, held)))
        place = _grid_order(at, np.repeat(np.arange(len(docs)), held), n, len(weights))
        seen, out = impact > 0, []
        if seen.any():
            grid = Treap(at[seen], np.repeat(place, held)[seen], impact[seen], len(weights), len(docs))
            docs = docs.iloc[np.argsort(place)]
            ids = np.where(docs["missing"], (1 << 63) - 1, docs["id"]).astype(np.int64)
            for item, rows in enumerate(asked):
                if len(rows):
                    columns, scores = grid.best(rows, ids, top, int(floors[item]))
                    if len(scores) == top:  # what is worse than these cannot be among the best of all
                        floors[item] = scores[-1]
                    out.append(docs.iloc[columns][["id", "missing", "row"]].assign(item=item, score=scores))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["item", "id", "missing", "row", "score"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors = np.ones(len(shared.value[2]), np.int64)
        waiting, docs, postings = [], 0, 0
        for batch in batches:
            while len(batch):
                sizes = batch["rows"].map(len).to_numpy().cumsum()
                part = batch.iloc[:min(COLUMNS - docs, 1 + int(np.searchsorted(sizes, POSTINGS - postings)))]
                batch = batch.iloc[len(part):]
                waiting.append(part)
                docs, postings = docs + len(part), postings + int(sizes[len(part) - 1])
                if docs >= COLUMNS or postings >= POSTINGS:
                    yield search(waiting, floors)
                    waiting, docs, postings = [], 0, 0
        if waiting:
            yield search(waiting, floors)
    return walk


def _best(found: DataFrame, top: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "missing", "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents with a score above 0 for each item.

    Every row of ``docs`` is a document, repeated ids too; of equal scores the smaller id comes first and a null id last.
    Null and empty texts have no terms: such documents count nowhere and such items find nothing.  Rows of ``items`` that
    share an id, null too, are one item with the terms of all of them.  Ids of documents are integers.

    Items are searched in groups of about ``terms_at_once`` terms, as the terms of a group are broadcast; one group is the usual case.
    """
    words = items.select(F.col(item_id).alias("item"), F.explode(F.pandas_udf(_item_terms, "array<string>")(F.col(item_text))).alias("term")).distinct()
    words = saved(words, "item-terms")
    groups = max(1, -(-words.count() // terms_at_once))
    group = F.pmod(F.xxhash64(F.coalesce(F.col("item").cast("string"), F.lit(""))), F.lit(groups))
    parts = [_search_group(docs, words.where(group == g), top, doc_id, text) for g in range(groups)]
    found = reduce(DataFrame.unionByName, parts)
    return found.select(F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score")


def _search_group(docs: DataFrame, words: DataFrame, top: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    by_item = words.groupBy("item").agg(F.collect_set("term").alias("terms")).collect()
    terms = sorted({t for r in by_item for t in r["terms"]})
    number = dict(zip(terms, range(len(terms))))
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    counts = source.mapInArrow(_counted(spark.sparkContext.broadcast(terms)), COUNTED)
    counted = saved(counts.where("n > 0").withColumn("row", F.monotonically_increasing_id()), "counts")
    whole = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = counted.select(F.explode("rows").alias("row")).groupBy("row").count().toPandas()  # one for each asked term
    weights = np.zeros(len(terms), np.int64)
    weights[df["row"].to_numpy(int)] = np.floor(1000 * np.log((2.0 * whole["docs"] + 2.0) / (2.0 * df["count"].to_numpy(float) + 1.0))).astype(np.int64)
    # The grid's rows stand in order of weight, so that a cell of many rows bounds each of them well.
    place_of = np.empty(len(terms), np.int64)
    place_of[np.argsort(weights, kind="stable")] = np.arange(len(terms))
    asked = [np.array([place_of[number[t]] for t in r["terms"] if weights[number[t]] > 0], np.int64) for r in by_item]
    shared = spark.sparkContext.broadcast((place_of, np.sort(weights), asked))
    docs_with_terms = counted.where(F.size("rows") > 0).select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("missing"), "row", "n", "rows", "tfs")
    found = docs_with_terms.mapInPandas(_searched(shared, whole["docs"], max(1, whole["terms"]), top), FOUND)
    near = _best(found.withColumn("part", F.pmod("row", F.lit(SPREAD))), top, "item", "part").drop("rank")
    best = _best(near, top, "item")
    names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(by_item)], StructType([StructField("number", IntegerType()), StructField("name", words.schema["item"].dataType)]))
    return best.join(F.broadcast(names), F.col("item") == F.col("number")).select(
        F.col("name").alias("item"), "rank", F.when(~F.col("missing"), F.col("id")).alias("id"), "score")
