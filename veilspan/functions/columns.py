"""Small building blocks for per-row array work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times.

    The value becomes a lambda variable, which the optimizer never inlines, so an expensive
    expression is not repeated for each reference.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def _fold(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.array_append(acc, F.when(last.isNull(), x).otherwise(combine(last, x)))
    return F.aggregate(values, empty("int"), step)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive prefix scan of an int array.

    Folding appends to an array, which copies it; done in chunks the copies stay at about
    n * sqrt(n) for texts with very many matches instead of n * n.
    """
    def chunked(arr: Column) -> Column:
        n = F.size(arr)
        starts = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
        inner = F.transform(starts, lambda c: _fold(F.slice(arr, c * CHUNK + 1, F.lit(CHUNK)), combine))

        def stitch(chunks: Column) -> Column:
            carried = _fold(F.transform(chunks, lambda ch: F.element_at(ch, -1)), combine)
            return let(carried, lambda carry: F.flatten(F.transform(
                chunks, lambda ch, k: F.when(k == 0, ch).otherwise(
                    F.transform(ch, lambda x: combine(F.element_at(carry, k), x))))))
        return let(inner, stitch)

    return let(values, lambda arr: F.when(F.size(arr) <= CHUNK, _fold(arr, combine)).otherwise(chunked(arr)))


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def contains_any(text: Column, literals) -> Column:
    return any_of([F.contains(text, F.lit(x)) for x in literals])
