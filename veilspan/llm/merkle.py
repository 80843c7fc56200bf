"""Merkle manifest of a dataset: a content-addressed tree whose proofs are found by descent.

Leaves are digests of rows.  Each group (a language, say) has a tree over its leaves in order of the id, and
the subroots of all groups, in order of the group, are the leaves of the tree above.  A node is the
digest of its children's digests; every two consecutive nodes have one parent, a last single one its own.

1. Rows are digested in one narrow pass; only digests and ids move from then on.
2. Leaves are range-partitioned by group and id and numbered; no group is gathered.
3. ``BITS`` levels at a time, runs of at most 2^BITS nodes become one record, (digest, children), of the
   store.  A record leaves out the levels between: they follow from the children.
4. Leaf requests descend from the root by the digits of their rank.  A record is found by its digest, checked against
   it, and opened once for each run of requests that share a prefix; the children that are not taken form a
   path segment for each digit.  At the leaf all segments, reversed, are the proof.

A request is never joined to the root by itself, so no record is hot.  Tables of any size take
ceil(log2(rows) / BITS) rounds.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import attach
from .common import saved

BITS = 12
STORE = "tier int, digest string, levels int, children string"
WIDTH = 64  # characters of a digest


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def group_key(group: Column) -> Column:
    """A text that orders groups bytewise, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _parents(nodes: list[str]) -> list[str]:
    return [sha256("".join(nodes[i:i + 2]).encode()).hexdigest() for i in range(0, len(nodes), 2)]


def _layers(children: list[str], levels: int) -> list[list[str]]:
    layers = [children]
    for _ in range(levels):
        layers.append(_parents(layers[-1]))
    return layers


def ranked(leaves: DataFrame, group: str, order: list[Column | str]) -> DataFrame:
    """``leaves`` plus ``rank`` (from 0 in each group) and ``size`` (of the group), written out.

    A group is numbered over range partitions: a row's place in its partition, plus the group's rows in earlier ones.
    """
    sorted_rows = leaves.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = saved(sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "leaves")
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = saved(parts.select(group, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                               F.sum("_rows").over(whole).alias("size")), "parts")
    return attach(placed, parts, [group, "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def depth_of(size: Column) -> Column:
    """Levels above the leaves: the logarithm of the size, rounded up."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1))).cast("int")


def _record(bits: int):
    def build(run: pd.DataFrame) -> pd.DataFrame:
        run = run.sort_values("rank")
        children, levels = run["digest"].tolist(), int(run["levels"].iloc[0])
        return pd.DataFrame({"tree": [run["tree"].iloc[0]], "rank": [int(run["rank"].iloc[0]) >> bits], "depth": [int(run["depth"].iloc[0])],
                             "digest": [_layers(children, levels)[-1][0]], "levels": [levels], "children": ["".join(children)]})
    return build


def build(leaves: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Trees over ranked leaves (tree, rank, digest, size): their roots (tree, digest, depth) and the store of records."""
    spark = leaves.sparkSession
    nodes = leaves.select("tree", "rank", "digest", depth_of(F.col("size")).alias("depth"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    roots, tiers = nodes.where("depth = 0").select("tree", "digest", "depth"), []
    for tier in range(-(-deepest // bits)):
        todo = nodes.where(F.col("depth") > tier * bits).withColumn("levels", F.least(F.lit(bits), F.col("depth") - F.lit(tier * bits)))
        runs = todo.groupBy("tree", F.shiftright("rank", bits).alias("block"))
        made = saved(runs.applyInPandas(_record(bits), "tree string, rank long, depth int, digest string, levels int, children string"), "records")
        tiers.append(made.select(F.lit(tier).alias("tier"), "digest", "levels", "children"))
        nodes = made.select("tree", "rank", "digest", "depth")
        roots = roots.unionByName(nodes.where(F.col("depth") <= (tier + 1) * bits).select("tree", "digest", "depth"))
    store = spark.createDataFrame([], STORE)
    for made in tiers:
        store = store.unionByName(made.dropDuplicates(["digest"]))  # equal content is one record
    return roots, store


def _segments(digest: str, levels: int, children: str | None) -> tuple[list[str], list[list[str]]]:
    """The children of a record and, for each, the siblings from the record down: ``<`` before, ``>`` behind, empty if none."""
    nodes = [digest] if children is None else [children[i:i + WIDTH] for i in range(0, len(children), WIDTH)]
    layers = _layers(nodes, levels)
    if layers[-1] != [digest]:
        raise ValueError(f"record {digest} does not hold what its digest says")

    def sibling(layer: list[str], at: int) -> str:
        other = at ^ 1
        return "" if other >= len(layer) else ("<" if other < at else ">") + layer[other]
    return nodes, [[sibling(layers[k], at >> k) for k in range(levels - 1, -1, -1)] for at in range(len(nodes))]


def _opened(bits: int):
    def walk(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                nodes, segments = _segments(r.digest, int(r.levels), r.children)
                path = list(r.path)
                out.extend((r.tree, (int(r.at) << bits) + i, node, int(r.below) - int(r.levels), path + segment)
                           for i, (node, segment) in enumerate(zip(nodes, segments)))
            yield pd.DataFrame(out, columns=["tree", "at", "digest", "below", "path"])
    return walk


def _delivered(bits: int, columns: list[str]):
    def walk(asked: pd.DataFrame, opened: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or opened.empty:
            return pd.DataFrame(columns=[*columns, "digest", "path"])
        r = opened.iloc[0]
        nodes, segments = _segments(r["digest"], int(r["levels"]), r["children"])
        digit = asked["rank"].to_numpy() & ((1 << bits) - 1)
        above = list(r["path"])
        out = asked[columns].copy()
        out["digest"] = [nodes[i] for i in digit]
        out["path"] = [(above + segments[i])[::-1] for i in digit]
        return out
    return walk


def descend(store: DataFrame, starts: DataFrame, requests: DataFrame, bits: int = BITS) -> DataFrame:
    """``requests`` (tree, rank, more) plus ``digest``, the leaf that is found there, and ``path``, leaf to root.

    starts: (tree, digest, depth, path): the root of each tree with what was collected above it, from the top.
    A request beyond its tree raises; one for an unknown tree gives no row.
    """
    frame = starts.select("tree", F.lit(0).cast("long").alias("at"), "digest", F.col("depth").alias("below"), "path")
    deepest = starts.agg(F.max("depth")).first()[0] or 0
    for tier in range(-(-deepest // bits) - 1, 0, -1):
        asked = requests.select("tree", F.shiftright("rank", bits * tier).alias("at")).distinct()
        open_now = frame.where(F.col("below") > tier * bits).join(store.where(F.col("tier") == tier).drop("tier"), "digest")
        deeper = open_now.select("tree", "at", "digest", "below", "path", "levels", "children").mapInPandas(
            _opened(bits), "tree string, at long, digest string, below int, path array<string>")
        deeper = deeper.join(asked, ["tree", "at"], "left_semi")
        frame = saved(frame.where(F.col("below") <= tier * bits).unionByName(deeper), "descent")
    last = store.where("tier = 0").drop("tier")
    ready = frame.join(last, "digest", "left").select("tree", F.col("at").alias("block"), "digest", F.coalesce("levels", F.lit(0)).alias("levels"),
                                                      "children", "path")
    columns = requests.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    both = requests.groupBy("tree", F.shiftright("rank", bits).alias("block")).cogroup(ready.groupBy("tree", "block"))
    return both.applyInPandas(_delivered(bits, columns), f"{schema}, digest string, path array<string>")


def manifest(leaves: DataFrame, group: str, order: list[str], digest: str, bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame, str | None]:
    """The whole forest: ranked leaves, tree roots (tree, rank, digest, depth), the store, and the root's digest.

    leaves: one row per leaf with its group (any value, null too), the columns that order it, and its digest; further columns stay.
    Null ids come first; leaves of one id stand in order of their digests, so that repeated rows have a defined place.
    An empty table has no root.
    """
    rows = ranked(leaves.withColumn("tree", group_key(F.col(group))), "tree", [*order, digest])
    below, store = build(rows.select("tree", "rank", "size", F.col(digest).alias("digest")), bits)
    tops = ranked(below.withColumn("all", F.lit("")), "all", ["tree"])
    above, upper = build(tops.select(F.col("all").alias("tree"), "rank", "size", "digest"), bits)
    root = above.first()
    store = store.withColumn("upper", F.lit(False)).unionByName(upper.withColumn("upper", F.lit(True)))
    return rows, tops.select("tree", "rank", "digest", "depth"), store, None if root is None else root["digest"]


def proofs(requests: DataFrame, tops: DataFrame, store: DataFrame, root: str, bits: int = BITS) -> DataFrame:
    """``requests`` (tree, rank, more) plus ``digest`` (leaf), ``subroot`` and ``path``, all found by descent from ``root``."""
    spark = requests.sparkSession
    size = F.lit(tops.count())
    start = spark.range(1).select(F.lit("").alias("tree"), F.lit(root).alias("digest"), depth_of(size).alias("depth"), F.array().cast("array<string>").alias("path"))
    wanted = tops.join(requests.select("tree").distinct(), "tree", "left_semi")
    asked = wanted.select(F.lit("").alias("tree"), "rank", F.col("tree").alias("below"), "depth")
    found = saved(descend(store.where("upper").drop("upper"), start, asked, bits), "subroots")
    # What was collected above comes first again, as the descent goes on.
    starts = found.select(F.col("below").alias("tree"), "digest", "depth", F.reverse("path").alias("path"))
    out = descend(store.where("NOT upper").drop("upper"), starts, requests, bits)
    return attach(out, starts.select("tree", F.col("digest").alias("subroot")), ["tree"])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    def step(node: Column, sibling: Column) -> Column:
        other = F.substring(sibling, 2, WIDTH)
        return F.sha2(F.when(F.startswith(sibling, F.lit("<")), F.concat(other, node)).otherwise(F.concat(node, other)), 256)
    return F.aggregate(path, leaf, step)


def siblings(path: Column) -> Column:
    """All sibling digests of a path as one text, leaf to root."""
    return F.array_join(F.transform(path, lambda s: F.substring(s, 2, WIDTH)), "")
