"""Which texts are the beginning of a known name, or begin with one: a prefix join by sorting.

Texts and names are sorted together, by range.  The names that begin with a text follow it at once, so that its next
name tells.  A name that a text begins with stands before it, and then all names between begin with that name
too: it is enough to know the shortest name that the last one begins with, which one pass over the sorted names carries
along.  Of each partition only its first name and the carried one are needed elsewhere.  Nothing is exploded,
and a stem that all texts share is split like any other range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .joins import cut_lineage

SUMMARY = "part int, first string, carried string"


def _summarised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first name of a partition, and the shortest name that its last one begins with."""
    first = carried = None
    for batch in batches:
        for name in batch["text"][batch["known"]]:
            first = name if first is None else first
            carried = name if carried is None or not name.startswith(carried) else carried
    if first is not None:
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "first": [first], "carried": [carried]})


def _edges(summary: list) -> dict[int, tuple[str | None, str | None]]:
    """For each partition with names: what is carried into the next one, and its first name."""
    carried, out = None, {}
    for row in sorted(summary, key=lambda r: r["part"]):
        carried = row["carried"] if carried is None or not row["carried"].startswith(carried) else carried
        out[row["part"]] = (carried, row["first"])
    return out


def _near(shared):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges, part = shared.value, TaskContext.get().partitionId()
        carried = next((edges[p][0] for p in sorted(edges, reverse=True) if p < part), None)
        following = next((edges[p][1] for p in sorted(edges) if p > part), None)
        waiting: list[str] = []  # texts that are a beginning of the last one: the next name decides them all
        for batch in batches:
            near = []
            for text, known in zip(batch["text"], batch["known"]):
                # Only a text that this one begins with can still be the beginning of a name to come.
                if known:
                    near += [t for t in waiting if text.startswith(t)]
                    waiting = []
                    carried = text if carried is None or not text.startswith(carried) else carried
                elif carried is not None and text.startswith(carried):
                    near.append(text)
                else:
                    while waiting and not text.startswith(waiting[-1]):
                        waiting.pop()
                    waiting.append(text)
            if near:
                yield pd.DataFrame({"text": near})
        if following is not None:
            near = [t for t in waiting if following.startswith(t)]
            if near:
                yield pd.DataFrame({"text": near})
    return walk


def near_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """The distinct values of the one column ``text`` that begin with a value of the one column ``name``, or are the beginning of one.

    Null texts and names are near nothing; equal ones are near each other; the empty text is the beginning of any name.
    """
    both = (texts.select(F.col("text"), F.lit(False).alias("known")).where("text IS NOT NULL")
            .unionByName(names.select(F.col("name").alias("text"), F.lit(True).alias("known")).where("text IS NOT NULL")).distinct())
    # A text stands before the name that equals it.
    ranged = cut_lineage(both.repartitionByRange("text", "known").sortWithinPartitions("text", "known"))
    edges = _edges(ranged.mapInPandas(_summarised, SUMMARY).collect())
    shared = texts.sparkSession.sparkContext.broadcast(edges)
    return ranged.mapInPandas(_near(shared), "text string")


__all__ = ["near_names"]
