"""Incremental maintenance of a full-text index from a stream of node rows.

Each micro-batch replaces the postings of the nodes in it. The batch number makes a replayed batch harmless:
a batch not later than the last one applied is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pelagraph.operators.search import TextIndex


class MaintainedIndex:
    def __init__(self, index: TextIndex, key: str):
        self.index, self.key, self.applied = index, key, -1

    def apply(self, rows: DataFrame, batch: int) -> None:
        """rows: new or changed nodes; of several rows of one key, any one counts."""
        if batch <= self.applied:
            return
        self.index = self.index.updated(rows.dropDuplicates([self.key]), self.key)
        self.applied = batch

    def follow(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
