"""Deliveries come from prices stored once, and a merge stores its batch alone: rows of the table are written once."""

from boutlog import ingest, registry
from boutlog.streaming import upserts


def test_the_log_and_the_table_are_written_once(spark, monkeypatch):
    kept, batches = [], []
    real = ingest.stored
    monkeypatch.setattr(ingest, "stored", lambda df: kept.append(df) or real(df))
    monkeypatch.setattr(upserts, "stored", lambda df: batches.append(df) or real(df))
    assert registry.QUERIES["incremental_upsert"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(kept) == 1
    assert len(batches) == ingest.SLICES + 1
