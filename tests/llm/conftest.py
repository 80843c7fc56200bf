from __future__ import annotations

import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path.insert(0, str(ROOT))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """A documents table; rows are (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows], DOCS)
