"""Registered queries: name to (query, SQL twin or None)."""

from . import detection, events, masking

REGISTRY = {**detection.QUERIES, **masking.QUERIES, **events.QUERIES}
