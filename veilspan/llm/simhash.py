"""SimHash near-duplicates: pivot distance tables discard pairs, survivors are verified.

Fingerprints that differ in at most three bits are linked.  The work is done on distinct
fingerprints:

1. Fingerprints are made in one narrow pass; copies collapse in a partial aggregation.
2. The table of Hamming distances to ``PIVOTS`` reference fingerprints is computed once per
   distinct fingerprint and carried along.
3. Which pairs meet: the bits are cut into five blocks; three differing bits leave two blocks
   whole, so two close fingerprints share one of the ten pairs of blocks.  Buckets with more than
   ``BUCKET`` members are dealt anew on the remaining bits (six blocks, three of which stay whole),
   so that no bucket grows with a group of near copies, and no link is lost.
4. Inside a bucket a pair is discarded if its distances to any pivot differ by more than three
   (the triangle inequality); survivors are verified bit by bit.  Of the links found, a bucket
   returns a spanning forest, never all its pairs.
5. Links become components by star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, fresh, saved
from .components import components

RADIUS = 3
PIVOTS = 16
BUCKET = 4096
SEED = 42


def _layout(bits: list[int], blocks: int) -> list[list[int]]:
    """``bits`` cut into ``blocks`` runs of nearly one length."""
    return [list(part) for part in np.array_split(np.array(bits), blocks)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << int(b) for b in bits)
    return value - (1 << 64) if value >> 63 else value


FIRST = [[b for block in pair for b in block] for pair in combinations(_layout(list(range(64)), 5), 2)]


def _second(first: list[int]) -> list[list[int]]:
    rest = [b for b in range(64) if b not in first]
    return [first + [b for block in some for b in block] for some in combinations(_layout(rest, 6), RADIUS)]


def reference_fingerprints(n: int = PIVOTS) -> list[int]:
    """The pivots: fixed pseudo-random fingerprints, as signed 64-bit numbers."""
    return [int(np.int64(np.uint64(xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED)))) for i in range(n)]


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of three-word shingles; no words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-3] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[2:].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 255):  # at most 255 rows a time, so that one byte holds a sum
        counts += np.unpackbits(octets[at:at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    return docs.withColumn(name, F.pandas_udf(_fingerprints, "long")(F.col(text)))


def as_hex(fingerprint_column: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint_column), 16, "0"))


def forest(fps: np.ndarray, distances: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group; rows of a group stand together.

    fps: uint64; distances: one row per fingerprint, one column per pivot.
    """
    n = len(fps)
    label = np.arange(n)
    out_a, out_b = [], []
    ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) if n else np.array([], int)
    end = np.repeat(ends, np.diff(np.concatenate(([-1], ends)))) if n else ends
    left = np.arange(n)
    for shift in range(1, n):
        left = left[left + shift <= end[left]]
        if not len(left):
            break
        first = np.abs(distances[left, 0].astype(np.int16) - distances[left + shift, 0])
        a = left[first <= RADIUS]
        b = a + shift
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        near = np.abs(distances[a].astype(np.int16) - distances[b]).max(axis=1, initial=0) <= RADIUS
        a, b = a[near], b[near]
        close = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
        a, b = a[close], b[close]
        while len(a):
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            apart = low != high
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            if not len(a):
                break
            tops, at = np.unique(high, return_index=True)
            out_a.append(a[at])
            out_b.append(b[at])
            parent = np.arange(n)
            parent[tops] = low[at]
            while not np.array_equal(parent, parent[parent]):
                parent = parent[parent]
            label = parent[label]
    if not out_a:
        return np.array([], int), np.array([], int)
    return np.concatenate(out_a), np.concatenate(out_b)


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket; a bucket that goes on in the next batch waits for it."""
    waiting: pd.DataFrame | None = None

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
        table = np.ascontiguousarray(rows[["d0", "d1"]].to_numpy(np.int64)).view(np.uint8).reshape(len(rows), -1)
        bucket = rows["level"].to_numpy(np.int64) * 4096 + rows["k"].to_numpy(np.int64)
        part = rows["part"].to_numpy(np.int64)
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]))
        a, b = forest(fps, table, np.cumsum(new))
        signed = fps.view(np.int64)
        return pd.DataFrame({"a": signed[a], "b": signed[b]})

    for batch in batches:
        rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        if rows.empty:
            continue
        last = rows.iloc[-1]
        same = ((rows["level"] == last["level"]) & (rows["k"] == last["k"]) & (rows["part"] == last["part"])).to_numpy()
        cut = len(rows) - int(same[::-1].argmin()) if not same.all() else 0
        waiting = rows.iloc[cut:].reset_index(drop=True)
        if cut:
            yield solve(rows.iloc[:cut].reset_index(drop=True))
    if waiting is not None and len(waiting):
        yield solve(waiting)


def _keyed(fps: DataFrame, masks: list[tuple[int, int]], level: int) -> DataFrame:
    """A row for each mask: the masked bits are the bucket."""
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part")) for k, m in masks])
    return fps.select("fp", "d0", "d1", F.lit(level).alias("level"), F.explode(keys).alias("key")).select(
        "fp", "d0", "d1", "level", "key.k", "key.part")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join what is within three bits, from distinct fingerprints ``fp``."""
    pivots = reference_fingerprints()
    packed = [sum((F.bit_count(F.col("fp").bitwiseXOR(F.lit(p).cast("long"))).cast("long") * F.lit(1 << (8 * i)).cast("long")
                   for i, p in enumerate(pivots[at:at + 8])), F.lit(0).cast("long")) for at in (0, 8)]
    tabled = fps.select("fp", packed[0].alias("d0"), packed[1].alias("d1"))
    rows = _keyed(tabled, [(k, _mask(bits)) for k, bits in enumerate(FIRST)], 0)
    crowded = saved(rows.groupBy("k", "part").count().where(F.col("count") > bucket).select("k", "part"), "buckets")
    if not crowded.isEmpty():
        finer = [(k * 32 + j, _mask(bits)) for k, first in enumerate(FIRST) for j, bits in enumerate(_second(first))]
        hot = rows.join(crowded, ["k", "part"], "left_semi")
        parts = [_keyed(hot.where(F.col("k") == k).select("fp", "d0", "d1"), [m for m in finer if m[0] // 32 == k], 1)
                 for k in range(len(FIRST))]
        rows = rows.join(crowded, ["k", "part"], "left_anti").select("fp", "d0", "d1", "level", "k", "part")
        for part in parts:
            rows = rows.unionByName(part)
    dealt = rows.repartition("level", "k", "part").sortWithinPartitions("level", "k", "part", "fp")
    return dealt.mapInPandas(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (signed 64 bits), component_id.

    component_id is the smallest doc_id reachable over links.  Null and empty texts have
    fingerprint zero, which links like any other.  Repeated rows stay repeated; a null doc_id
    gets the component of its text but names none (a component of null ids alone is null).
    Other columns are ignored; an empty table gives no rows.
    """
    one = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = saved(with_fingerprint(one).drop("text"), "fingerprints")
    fps = saved(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(fps.select("fp")))
    named = fps.join(found, fps["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    # Two narrow columns; a hot fingerprint is split by the skew join.
    classes = saved(named.join(least, "component").select("fp", "component_id"), "classes")
    return marked.join(classes, marked["fingerprint"] == classes["fp"]).select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the component's smallest doc_id.

    Rows that repeat this doc_id are one document: the smallest row by all its columns stays.  Rows whose doc_id is
    null stay only where their whole component has no id; then the smallest text stands for it.
    """
    classes = saved(near_duplicates(docs, doc_id, text), "components")
    (chosen, nth) = fresh(docs, "_chosen", "_nth")
    winners = classes.where("doc_id = component_id").select(F.col("doc_id").alias(chosen)).groupBy(chosen).count()
    single = winners.where("count = 1").select(chosen)
    kept = docs.join(single, docs[doc_id] == single[chosen], "left_semi")
    repeated = saved(winners.where("count > 1").select(chosen), "repeated")
    nameless = classes.where("component_id is null")
    if not repeated.isEmpty():
        from pyspark.sql import Window

        again = docs.join(repeated, docs[doc_id] == repeated[chosen], "left_semi")
        order = Window.partitionBy(doc_id).orderBy(*[c for c in docs.columns if c != doc_id])
        kept = kept.unionByName(again.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth))
    if not nameless.isEmpty():
        kept = kept.unionByName(_nameless(docs, doc_id, text, nameless))
    return kept


def _nameless(docs: DataFrame, doc_id: str, text: str, nameless: DataFrame) -> DataFrame:
    """One row for each component that consists of null ids only."""
    from pyspark.sql import Window

    (fp, component, nth) = fresh(docs, "_fp", "_component", "_nth")
    found = components(links(nameless.select(F.col("fingerprint").alias("fp")).distinct()))
    rows = with_fingerprint(docs.where(F.col(doc_id).isNull()), text, fp)
    own = nameless.select(F.col("fingerprint").alias("own")).distinct()
    rows = rows.join(own, rows[fp] == own["own"], "left_semi").join(found, F.col(fp) == found["node"], "left")
    rows = rows.withColumn(component, F.coalesce(found["component"], F.col(fp))).drop(found["component"], found["node"])
    order = Window.partitionBy(component).orderBy(*[c for c in docs.columns])
    return rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth, fp, component)
