"""Bridges from Structured Streaming into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from colonnade.session import Session


def upsert_stream(session: Session, table: str, stream: DataFrame, order: str | None = None) -> DataStreamWriter:
    """A writer that upserts each micro-batch by key; of rows with one key the one with the largest `order` counts.

    Upserts are idempotent, so a batch that is replayed after a failure leaves the same table.
    """
    space, _, name = table.partition(".")
    found = session.catalog.table(space, name)
    keys = [c.name for c in [*found.partition, *found.clustering]]

    def take(batch: DataFrame, _: int) -> None:
        columns = [c for c in batch.columns if c not in keys]
        rank = F.struct(F.col(order), *(F.col(c) for c in columns if c != order)) if order else F.struct(*columns)
        newest = batch.groupBy(*keys).agg(F.max(rank).alias("r")).select(*keys, "r.*")
        session.apply_changes(table, newest)

    return stream.writeStream.foreachBatch(take)
