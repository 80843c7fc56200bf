"""What moves between the steps of a neighbour search does not grow with leaves, nor with lists of a query."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa

from veilspan.llm import ann


def test_tiles_hold_whole_leaves_or_parts_of_one():
    sizes = np.array([[5, 0, 3, 9, 2, 25, 4, 4], [1, 1, 1, 1, 1, 1, 1, 1]])
    first, parts = ann._tiles(sizes, 10)
    assert parts.tolist()[0] == [1, 1, 1, 1, 1, 3, 1, 1] and set(parts[1]) == {1}
    assert [first[0, i] for i in (0, 2, 3, 4, 5, 6, 7)] == [0, 0, 1, 2, 3, 6, 6] and set(first[1]) == {7}


def test_a_query_goes_to_a_tile_once():
    rng = np.random.default_rng(0)
    points = rng.standard_normal((4096, 8))
    forest = ann.Forest(points, 7, float(np.linalg.norm(points, axis=1).max()), trees=3)
    leaves = forest.leaves(points)
    sizes = np.stack([np.bincount(leaves[:, t], minlength=128) for t in range(3)])
    first, parts = ann._tiles(sizes, 1100)
    asked = pd.DataFrame({"rep": np.arange(40), "vector": list(points[:40])})
    sent = pd.concat(ann._searched(SimpleNamespace(value=(forest, sizes, first, parts)), 5000)(iter([asked])))
    assert not sent.duplicated(["query", "tile"]).any() and len(sent) <= 40 * 12
    for query, rows in sent.groupby("query"):
        told = {(int(np.flatnonzero((first == tile).any(axis=1))[0]), int(leaf)) for tile, own in zip(rows["tile"], rows["leaves"]) for leaf in own}
        assert told == set(forest.nearest_leaves(points[query], sizes, 5000))


def test_lists_of_a_query_are_merged_across_batches():
    def batch(query, lists):
        return pa.RecordBatch.from_pydict({"query": pa.array(query, pa.int64()), "reps": pa.array([[i for i, _ in x] for x in lists], pa.list_(pa.int64())),
                                           "scores": pa.array([[s for _, s in x] for x in lists], pa.list_(pa.float64()))})

    batches = [batch([1, 2], [[(5, .9), (6, .1)], [(8, .5), (9, .4)]]), batch([], []), batch([2, 2], [[(8, .5), (3, .4)], [(1, .45)]]), batch([2, 4], [[(7, .2)], [(1, 1.)]])]
    rows = [tuple(r.values()) for b in ann._merged(3)(iter(batches)) for r in b.to_pylist()]
    assert rows == [(1, 5, .9), (1, 6, .1), (2, 8, .5), (2, 1, .45), (2, 3, .4), (4, 1, 1.)]


def test_ties_and_large_numbers_in_many_slabs():
    """Exact scores and smallest ids, also where products of large vectors are rounded and more members tie than wait at a time."""
    rng = np.random.default_rng(2)
    held = np.round(rng.standard_normal((9000, 4))) * 1e6 + 1e-3
    held[:8000] = held[0]
    ids, leaf = rng.permutation(9000), np.arange(9000) % 3
    asked = held[rng.integers(0, 9000, 700)]
    members = pa.table({"leaf": leaf, "rep": ids, "vector": pa.array(held.tolist(), pa.list_(pa.float64()))})
    queries = pa.table({"query": np.arange(700), "leaves": pa.array([[0, 2]] * 700, pa.list_(pa.int64())), "vector": pa.array(asked.tolist(), pa.list_(pa.float64()))})
    got = ann._reranked(5)(queries, members).to_pylist()
    assert [r["query"] for r in got] == list(range(700))
    seen = leaf != 1
    for r in got[::23]:
        scores = (held[seen] * asked[r["query"]]).sum(axis=1)
        order = np.lexsort((ids[seen], -scores))[:5]
        assert r["reps"] == ids[seen][order].tolist() and r["scores"] == scores[order].tolist()
