"""Streams over tables that are folders of files, and over tables without rows."""

from __future__ import annotations

import pytest

from veilspan.plans import events as E
from veilspan.plans.events import QUERIES

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("rows", [[(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for c in range(2) for t in range(4)], []])
@pytest.mark.parametrize("name", ["stream_redact", "stream_decisions"])
def test_a_table_may_be_a_folder(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, TURNS).repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(99, 0, "user", "of another table")], TURNS).write.parquet(f"{tmp_path}/conversations_old.parquet")
    got = QUERIES[name][0](spark, str(tmp_path))
    assert sorted(r["row_id"] for r in got.collect()) == sorted(c * 1000 + t for c, t, *_ in rows)


def test_a_batch_of_events_is_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for c in range(40) for t in range(4)]
    spark.createDataFrame(rows, TURNS).repartition(4).write.option("maxRecordsPerFile", 40).parquet(f"{tmp_path}/conversations.parquet")
    base = f"{tmp_path}/base"
    monkeypatch.setattr(E, "_new_folder", lambda _: base)
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        got = QUERIES["stream_results"][0](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["row_id"] for r in got) == sorted(c * 1000 + t for c, t, *_ in rows)
    assert all(len(spark.read.parquet(f"{base}/events/calls{half}").inputFiles()) > 1 for half in (0, 1))
    assert len(list((tmp_path / "base" / "out").glob("batch=*"))) in (3, 4)
