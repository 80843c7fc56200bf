"""Nearest neighbours by a forest of random-projection trees with one shared priority queue.

1. Equal vectors form a class; only classes are indexed.  A class keeps its ``k + 1`` smallest ids,
   which is all that a list of ``k`` neighbours without the query itself can hold.
2. The trees are fitted on at most ``SAMPLE`` vectors: a node splits at the median of the projections on a
   random direction.  Every class is dealt to its leaf in every tree.  Neighbouring leaves of a tree lie together in
   tiles of at most ``BLOCK`` classes, and a larger leaf in several tiles.
3. For each query one priority queue over the nodes of all trees yields the leaves in the order of their
   distance from the query, until they hold ``share`` times the number of classes, copies in other
   trees counted, and at least ``least``.
4. Queries, in blocks of at most about ``BLOCK``, meet the classes of their leaves by tile: a query goes to a tile once, with
   the leaves that it visits there, and comes back with one list.  The exact inner products, in double precision, of
   the candidates rank them.  Lists are merged row after row in the order of queries, so that neither side of
   a meeting, nor the lists of a query, nor a batch grow with the data.

For the largest inner product, vectors get one more component that gives all of them the largest
norm; a query has zero there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import saved

TREES = 3
LEAF = 1024
MAX_DEPTH = 12
SAMPLE = 65_536
BLOCK = 65_536
TILES = 64
SLAB, PENDING = 512, 1 << 18
SENT = 4096
SHARE = 1.2
LEAST = 2_000
SEED = 11


class Forest:
    """Directions and medians of all trees; a tree's nodes are numbered as a heap from 1."""

    def __init__(self, sample: np.ndarray, depth: int, norm: float, trees: int = TREES, seed: int = SEED):
        self.depth, self.norm = depth, norm
        rng = np.random.default_rng(seed)
        width = sample.shape[1] + 1
        self.directions = rng.standard_normal((trees, max(1, depth), width)) / np.sqrt(width)
        self.medians = np.zeros((trees, 1 << depth))
        points = self.lifted(sample)
        for t in range(trees):
            seen = points @ self.directions[t].T
            node = np.ones(len(points), np.int64)
            for level in range(depth):
                order = np.lexsort((seen[:, level], node))
                starts = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
                for at, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                    self.medians[t, (1 << level) + at] = np.median(seen[order[a:b], level]) if b > a else 0.0
                node = 2 * node + (seen[:, level] > self.medians[t, node])

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.norm ** 2 - (vectors ** 2).sum(axis=1)))
        return np.concatenate((vectors, rest[:, None]), axis=1)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        points, out = self.lifted(vectors), []
        for directions, medians in zip(self.directions, self.medians):
            seen = points @ directions.T
            node = np.ones(len(points), np.int64)
            for level in range(self.depth):
                node = 2 * node + (seen[:, level] > medians[node])
            out.append(node - (1 << self.depth))
        return np.stack(out, axis=1)

    def nearest_leaves(self, query: np.ndarray, sizes: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """(tree, leaf), nearest first, until they hold ``enough`` classes; sizes: by tree and leaf."""
        seen, first = self.directions @ np.append(query, 0.0), 1 << self.depth
        at = np.repeat(np.arange(self.depth), 1 << np.arange(self.depth))  # level of each node from 1
        margins = (seen[:, at] - self.medians[:, 1:]).tolist()
        counts = sizes.tolist()
        queue = [(0.0, t, 1) for t in range(len(self.directions))]
        out, held = [], 0
        while queue and held < enough:
            away, t, node = heapq.heappop(queue)
            if node >= first:
                if counts[t][node - first]:
                    out.append((t, node - first))
                    held += counts[t][node - first]
                continue
            margin = margins[t][node - 1]
            near, far = (2 * node + 1, 2 * node) if margin > 0 else (2 * node, 2 * node + 1)
            heapq.heappush(queue, (away, t, near))
            heapq.heappush(queue, (away + margin * margin, t, far))
        return out


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    """The values of a list column, one list after another."""
    parts = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in table[name].chunks]
    return np.concatenate(parts) if parts else np.zeros(0)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``k`` best different ids, queries in order, best first, ties by id; an id has one score for a query."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, scores = query[new], ids[new], scores[new]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], ids[kept], scores[kept]


def _tiles(sizes: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """For each tree and leaf the number of its first tile and of its tiles; a tile holds leaves of one tree, or a part of one leaf."""
    first, parts, number = np.zeros(sizes.shape, np.int64), np.maximum(1, -(-sizes // tile)), 0
    for t, counts in enumerate(sizes.tolist()):
        room = 0
        for leaf, n in enumerate(counts):
            if not n:
                continue
            if n > room:
                start, number = number, number + int(parts[t, leaf])
                room = tile
            first[t, leaf] = start
            room = room - n if parts[t, leaf] == 1 else 0
    return first, parts


def _indexed(shared):
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = shared.value
        for batch in batches:
            if len(batch):
                leaves = forest.leaves(_stacked(batch["vector"]))
                for t in range(leaves.shape[1]):
                    yield pd.DataFrame({"tree": t, "leaf": leaves[:, t], "rep": batch["rep"], "vector": batch["vector"]})

    return deal


def _searched(shared, enough: float):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, sizes, first, parts = shared.value
        rows, columns = [], ["query", "tile", "leaves", "vector"]
        for batch in batches:
            for query, vector in zip(batch["rep"], batch["vector"]):
                found = np.array(sorted(forest.nearest_leaves(np.asarray(vector, np.float64), sizes, enough)))
                of = first[found[:, 0], found[:, 1]]
                starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                for a, b in zip(starts, [*starts[1:], len(of)]):
                    rows += [(query, int(of[a]) + part, found[a:b, 1], vector) for part in range(parts[tuple(found[a])])]
                if len(rows) >= SENT:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return search


def _reranked(k: int):
    none = pa.table({"query": pa.array([], pa.int64()), "reps": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})

    def sifted(best: tuple, waiting: list, ids: np.ndarray, part: np.ndarray, held: np.ndarray, slack: np.ndarray) -> tuple:
        """The ``k`` best of each query, by exact score, among ``best`` and those that wait with a score that may be rounded."""
        at, member, score = [np.concatenate(x) for x in zip(*waiting)]
        order = np.lexsort((-score, at))
        at, member, score = at[order], member[order], score[order]
        starts = np.searchsorted(at, np.arange(len(part) + 1))
        full = np.flatnonzero(np.diff(starts) >= k)
        floor = np.full(len(part), -np.inf)
        floor[full] = score[starts[full] + k - 1] - slack[full]
        near = score >= floor[at]
        at, member = at[near], member[near]
        # One order of summation, whatever the tile.
        exact = [(held[member[i:i + SENT]] * part[at[i:i + SENT]]).sum(axis=1) for i in range(0, len(at), SENT)]
        return _best(*[np.concatenate(x) for x in zip(best, (at, ids[member], np.concatenate(exact)))], k)

    def ranked(part: np.ndarray, visits: np.ndarray, ids: np.ndarray, held: np.ndarray, bounds: np.ndarray, slack: np.ndarray) -> tuple:
        """(query, id, score) of the ``k`` best of each query, by number, in the leaves that it visits; slack: what rounding may hide."""
        best, floor = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(len(part), -np.inf)
        waiting, size = [], 0
        for leaf, (begin, end) in enumerate(zip(bounds[:-1], bounds[1:])):
            asked = np.flatnonzero(visits[:, leaf])
            for at in range(begin, end, 4 * SLAB) if len(asked) else ():
                scores = part[asked] @ held[at:min(end, at + 4 * SLAB)].T
                new, n = np.flatnonzero(np.isneginf(floor[asked])), scores.shape[1]
                if len(new) and n > k:
                    floor[asked[new]] = np.partition(scores[new], n - k, axis=1)[:, n - k] - slack[asked[new]]
                row, column = np.nonzero(scores >= floor[asked, None])
                waiting.append((asked[row], column + at, scores[row, column]))
                size += len(row)
                if size > PENDING:
                    best, waiting, size = sifted(best, waiting, ids, part, held, slack), [], 0
                    ends = np.searchsorted(best[0], np.arange(len(part) + 1))
                    full = np.flatnonzero(np.diff(ends) == k)
                    floor[full] = best[2][ends[full + 1] - 1] - slack[full]
        return sifted(best, waiting, ids, part, held, slack) if size else best

    def rerank(queries: pa.Table, members: pa.Table) -> pa.Table:
        if not len(queries) or not len(members):
            return none
        leaf, ids = members["leaf"].to_numpy(), members["rep"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        held = _flat(members, "vector").reshape(len(members), -1)[order]
        ids, leaves = ids[order], np.unique(leaf)
        bounds = np.append(np.searchsorted(leaf[order], leaves), len(leaf))
        asked, vectors = queries["query"].to_numpy(), _flat(queries, "vector").reshape(len(queries), -1)
        counts = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in queries["leaves"].chunks])
        visited = _flat(queries, "leaves")
        place = np.searchsorted(leaves, visited)
        known = leaves[np.minimum(place, len(leaves) - 1)] == visited
        visits = np.zeros((len(queries), len(leaves)), bool)
        visits[np.repeat(np.arange(len(queries)), counts)[known], place[known]] = True
        slack = 8 * held.shape[1] * np.finfo(float).eps * np.linalg.norm(held, axis=1).max() * np.linalg.norm(vectors, axis=1)
        found = []
        for at in range(0, len(asked), SLAB):
            part = slice(at, at + SLAB)
            query, reps, scores = ranked(vectors[part], visits[part], ids, held, bounds, slack[part])
            found.append((asked[part][query], reps, scores))
        query, reps, scores = [np.concatenate(x) for x in zip(*found)]
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(starts, len(query)), pa.int32())
        return pa.table({"query": pa.array(query[starts], pa.int64()), "reps": pa.ListArray.from_arrays(offsets, pa.array(reps, pa.int64())),
                         "scores": pa.ListArray.from_arrays(offsets, pa.array(scores, pa.float64()))})

    return rerank


def _merged(k: int):
    """The lists of each query made one, from rows in the order of queries; only one query's rows wait for the next batch."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(parts):
            return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.float64())],
                                              names=["query", "rep", "score"])

        open_ = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            counts = batch.column("reps").value_lengths().to_numpy(zero_copy_only=False)
            own = (np.repeat(batch.column("query").to_numpy(), counts), batch.column("reps").flatten().to_numpy(), batch.column("scores").flatten().to_numpy())
            found = _best(*[np.concatenate(x) for x in zip(open_, own)], k)
            if not len(found[0]):
                continue
            last = np.searchsorted(found[0], found[0][-1])
            open_ = tuple(x[last:] for x in found)
            if last:
                yield rows([x[:last] for x in found])
        if len(open_[0]):
            yield rows(open_)

    return merge


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector): without null ids and without vectors that are null, empty, zero, or hold null, NaN or infinite components."""
    wide = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), wide.alias("vector")).where("vec_id is not null and size(vector) > 0")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, k: int, is_query, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = TREES,
            leaf: int = LEAF, share: float = SHARE, least: int = LEAST, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query among all other rows.

    is_query: a condition on vec_id.  Score: the inner product in double precision; ties go to the smaller vec_id.  All
    vectors must have one length; those that ``usable`` leaves out take no part.  A repeated vec_id counts once for
    each vector it has.  Fewer candidates give fewer rows; without usable vectors there are none.
    """
    context = vectors.sparkSession.sparkContext
    rows = saved(usable(vectors, vec_id, embedding).distinct(), "vectors")
    class_of = rows.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.max(is_query(F.col("vec_id"))).alias("asked"), F.count("*").alias("n"))
    classes = saved(class_of.withColumn("rep_norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))), "classes")
    total, norm, shortest, longest = classes.agg(F.count("*"), F.max("rep_norm"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shortest != longest:
        raise ValueError(f"vectors of different lengths: {shortest} and {longest}")
    drawn = classes.select("vector").orderBy(F.xxhash64("rep")).limit(min(sample, total)).toPandas()
    depth = int(np.clip(np.ceil(np.log2(max(1, total / leaf))), 0, min(MAX_DEPTH, np.log2(max(1, len(drawn) / 16)))))
    forest = Forest(_stacked(drawn["vector"]), depth, norm, trees)
    shared = context.broadcast(forest)
    index = saved(classes.select("rep", "vector").mapInPandas(_indexed(shared), "tree int, leaf int, rep long, vector array<double>"), "index")
    counted = index.groupBy("tree", "leaf").count().collect()  # at most trees * 2**MAX_DEPTH rows
    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in counted:
        sizes[r["tree"], r["leaf"]] = r["count"]
    first, parts = _tiles(sizes, min(block, max(leaf, int(trees * total / TILES))))
    places = [(t, n, int(first[t, n]), int(parts[t, n])) for t, n in np.argwhere(sizes).tolist()]
    places = vectors.sparkSession.createDataFrame(places, "tree long, leaf long, first long, parts long")
    asked = classes.where("asked").select("rep", "vector")
    blocks = F.lit(max(1, -(-asked.count() // block)))
    found = asked.mapInPandas(_searched(context.broadcast((forest, sizes, first, parts)), max(share * total, least)),
                              "query long, tile long, leaves array<long>, vector array<double>")
    found = found.withColumn("block", F.pmod(F.xxhash64("query"), blocks))
    held = index.join(F.broadcast(places), ["tree", "leaf"]).select(
        "leaf", "rep", "vector", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("tile"),
        F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("block"))
    lists = found.groupBy("tile", "block").cogroup(held.groupBy("tile", "block")).applyInArrow(
        _reranked(k + 1), "query long, reps array<long>, scores array<double>")
    top = lists.repartition("query").sortWithinPartitions("query").mapInArrow(_merged(k + 1), "query long, rep long, score double")
    return _spelled_out(saved(top, "near"), rows, classes, is_query, k)


def _spelled_out(near: DataFrame, rows: DataFrame, classes: DataFrame, is_query, k: int) -> DataFrame:
    """From classes to ids: the smallest ids of each near class, for every query row of the query's class."""
    shared = classes.where("n > 1").select("vector", "rep")
    copies = rows.join(shared, "vector").select("rep", "vec_id")  # rows of classes with more than one
    first = Window.partitionBy("rep").orderBy("vec_id")
    few = copies.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).select("rep", "vec_id")
    single = classes.where("n = 1").select("rep", F.col("rep").alias("vec_id"))
    members = single.unionByName(few)
    candidates = near.join(members, "rep").select("query", "vec_id", "score")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best_ids = candidates.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    askers = single.unionByName(copies).where(is_query(F.col("vec_id"))).select(F.col("rep").alias("query"), F.col("vec_id").alias("query_id"))
    lists = best_ids.join(askers, "query").where("vec_id <> query_id")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lists.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
