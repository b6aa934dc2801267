"""Keeping an index in step with a stream of text records.

Each micro-batch replaces the sources that it holds; an index build is idempotent by the
sources' hashes, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandweave.operators.semantic import index_records

RECORD = "source_id string, entity_id string, source_kind string, entity_types array<string>, text string"


def index_stream(records: DataFrame, store_path: str, checkpoint: str, *, embed=None, available_now: bool = True, **settings) -> StreamingQuery:
    """Starts a query that indexes streamed text records, source by source."""

    def one(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        if not rows.isEmpty():
            index_records(rows, store_path, embed=embed, partial=True, **settings)
        rows.unpersist()

    writer = records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
