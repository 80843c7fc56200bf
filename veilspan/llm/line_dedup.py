"""Line deduplication by range-partitioned line hashes with a secondary sort.

1. One narrow pass turns each document into rows (128-bit hash of a line's key, document, packed
   line numbers), one for each different key of a document.
2. The rows are range-partitioned and sorted by hash, then by document, largest id first.  A
   hot line has as many partitions as its rows need, since the document is part of the range key.
3. Each partition is streamed: the first document of a key keeps its lines, the rows of the others
   are emitted if the key is in enough documents.  Keys at a partition's edges, and keys longer
   than a buffer, are emitted whole and marked; a partial aggregation over the marked rows decides them.
4. Dropped line numbers are folded into one compressed keep bitmap for each document.

The operator returns bitmaps, not texts; ``apply_bitmaps`` cuts the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import is_small
from .common import LOWER, fresh, join_measured, saved

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
BUFFER = 50_000
SALTS = 16
LINES = "h1 long, h2 long, doc_id long, doc_key long, n_lines int, lines binary"


def _line_rows(min_chars: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("doc_key", pa.int64()),
                        ("n_lines", pa.int32()), ("lines", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            h, docs, keys, counts, lines = [], [], [], [], []
            for text, doc, key in zip(batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("doc_key").to_pylist()):
                text = text.as_py()
                if text is None or len(text) < min_chars:
                    continue
                found: dict[bytes, list[int]] = {}
                parts = text.split("\n")
                for at, line in enumerate(parts):
                    if len(line) >= min_chars and len(line := line.strip(BLANKS)) >= min_chars:
                        found.setdefault(digest(line.encode("utf-8", "surrogatepass").translate(LOWER)), []).append(at)
                h.extend(found)
                lines.extend(np.array(x, "<u4").tobytes() for x in found.values())
                docs.extend([doc] * len(found))
                keys.extend([key] * len(found))
                counts.extend([len(parts)] * len(found))
                if len(h) >= BUFFER:
                    yield _batch(schema, h, docs, keys, counts, lines)
                    h, docs, keys, counts, lines = [], [], [], [], []
            if h:
                yield _batch(schema, h, docs, keys, counts, lines)

    return rows


def _batch(schema: pa.Schema, h: list[bytes], docs: list, keys: list, counts: list, lines: list[bytes]) -> pa.RecordBatch:
    halves = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])),
                                       pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(counts, pa.int32()),
                                       pa.array(lines, pa.binary())], schema=schema)


def _decided(rows: pd.DataFrame, min_docs: int) -> pd.DataFrame:
    """Of whole runs: the rows of all documents but a run's first, where the run has enough documents."""
    h1, h2, doc = rows["h1"].to_numpy(), rows["h2"].to_numpy(), rows["doc_id"].to_numpy()
    new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    docs = np.cumsum(new | np.append(True, doc[1:] != doc[:-1]))
    nth = docs - docs[starts][run]
    most = np.maximum.reduceat(nth, starts) + 1
    return rows[(nth > 0) & (most[run] >= min_docs)].assign(marked=False)


def _streamed(min_docs: int, buffer: int):
    """Over one partition, sorted by key and document: the rows to drop, and marked rows to be decided later."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, open_key = None, None
        for batch in batches:
            if batch.empty:
                continue
            rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            if open_key is None:
                open_key = tuple(rows.loc[0, ["h1", "h2"]])  # what came before lies in another partition
            goes_on = ((rows["h1"] == open_key[0]) & (rows["h2"] == open_key[1])).to_numpy()
            out = [rows[goes_on].assign(marked=True)]
            rows = rows[~goes_on].reset_index(drop=True)
            if len(rows):
                last = ((rows["h1"] == rows["h1"].iloc[-1]) & (rows["h2"] == rows["h2"].iloc[-1])).to_numpy()
                waiting = rows[last].reset_index(drop=True)
                if not last.all():
                    out.append(_decided(rows[~last], min_docs))
                if len(waiting) > buffer:
                    open_key = tuple(waiting.loc[0, ["h1", "h2"]])
                    out.append(waiting.assign(marked=True))
                    waiting = None
            else:
                waiting = None
            yield pd.concat(out, ignore_index=True)
        if waiting is not None:
            yield waiting.assign(marked=True)

    return walk


def _with_stats(marked: DataFrame, stats: DataFrame) -> DataFrame:
    """Marked rows with what is known of their key: broadcast where measured small, else both sides salted, so that a hot key is split."""
    if is_small(stats):
        return marked.join(F.broadcast(stats), ["h1", "h2"])
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(stats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h1", "h2", "salt"]).drop("salt")


def _bitmaps(n_lines: pd.Series, dropped: pd.Series) -> pd.DataFrame:
    counts, maps = [], []
    for n, parts in zip(n_lines, dropped):
        keep = np.ones(int(n), bool)
        keep[np.frombuffer(b"".join(parts), "<u4")] = False
        counts.append(int(n) - int(keep.sum()))
        maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
    return pd.DataFrame({"n_dropped": counts, "keep": maps})


def line_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS, buffer: int = BUFFER) -> DataFrame:
    """(doc_id, doc_key, n_lines, n_dropped, keep) for every document that loses lines.

    A line's key is the line without outer blanks and with A-Z in lower case.  Keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents stay in the largest doc_id only;
    there all their lines stay.  doc_key is the hash of the text, so that rows that share a doc_id
    with different texts are cut each by its own bitmap; they count as one document.  Rows with a
    null doc_id count as one document, smaller than any other.  keep: zlib over bits, least
    significant first, one a line.  Null and empty texts lose nothing; an empty table gives no rows.
    """
    least = F.lit(-(1 << 63)).cast("long")
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), least).alias("doc_id"),
                         F.xxhash64(F.col(text)).alias("doc_key"), F.col(text).alias("text"))
    rows = saved(source.mapInArrow(_line_rows(min_chars), LINES), "lines")
    ordered = rows.repartitionByRange(F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("doc_key"))
    ordered = ordered.sortWithinPartitions(F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("doc_key"))
    walked = saved(ordered.mapInPandas(_streamed(min_docs, buffer), LINES + ", marked boolean"), "runs")
    marked = walked.where("marked")
    # A very common key has marked rows in every task: its documents are counted by salt, then by key.
    parts = marked.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    parts = parts.agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
    stats = saved(parts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where(F.col("n") >= min_docs), "stats")
    late = _with_stats(marked, stats).where("doc_id < top")
    dropped = walked.where("not marked").select("doc_id", "doc_key", "n_lines", "lines").unionByName(
        late.select("doc_id", "doc_key", "n_lines", "lines"))
    folded = dropped.groupBy("doc_id", "doc_key").agg(F.first("n_lines").alias("n_lines"), F.collect_list("lines").alias("lines"))
    return folded.select(F.when(F.col("doc_id") != least, F.col("doc_id")).alias("doc_id"), "doc_key", "n_lines",
                         F.pandas_udf(_bitmaps, "n_dropped int, keep binary")("n_lines", "lines").alias("cut")).select("doc_id", "doc_key", "n_lines", "cut.*")


def _cut(texts: pd.Series, maps: pd.Series) -> pd.Series:
    out = []
    for text, keep in zip(texts, maps):
        if text is not None and keep is not None:
            lines = text.split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines), bitorder="little")
            text = "\n".join([x for x, b in zip(lines, bits) if b])
        out.append(text)
    return pd.Series(out, dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  n_dropped: str | None = None) -> DataFrame:
    """``docs`` with the dropped lines cut; other texts, null ones too, stay as they are.

    The texts move only if the bitmaps are too many to broadcast.  n_dropped: name of a column
    to add with the number of lines cut.
    """
    (own_id, own_key, keep, count) = fresh(docs, "_own_id", "_own_key", "_keep", "_n_dropped")
    maps = saved(bitmaps.select(F.col("doc_id").alias(own_id), F.col("doc_key").alias(own_key), F.col("keep").alias(keep),
                                F.col("n_dropped").alias(count)), "bitmaps")
    same = docs[doc_id].eqNullSafe(maps[own_id]) & (F.xxhash64(docs[text]) == maps[own_key])
    joined = join_measured(docs, maps, same, "left")
    cut = F.pandas_udf(_cut, "string")(F.when(F.col(keep).isNotNull(), F.col(text)), F.col(keep))
    out = joined.withColumn(text, F.when(F.col(keep).isNotNull(), cut).otherwise(F.col(text)))
    if n_dropped:
        out = out.withColumn(n_dropped, F.coalesce(F.col(count), F.lit(0)).cast("long"))
    return out.drop(own_id, own_key, keep, count)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with repeated lines cut from the texts."""
    return apply_bitmaps(docs, line_bitmaps(docs, doc_id, text, **options), doc_id, text)
