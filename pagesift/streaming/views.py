"""A stored view kept up by a stream: each micro-batch adds its partial rows, and
every ``compact_every`` batches a new base is made. The number of a micro-batch
names its folder, so a batch that is run again after a failure changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.views import View
from ..sinks import views


def keep_view(events: DataFrame, view: View, path: str, checkpoint: str, compact_every: int = 20,
              trigger: dict | None = None) -> StreamingQuery:
    """Start the stream (``availableNow`` unless ``trigger`` says otherwise)."""
    def batch(rows: DataFrame, number: int) -> None:
        views.add_batch(view, rows, path, number)
        if number % compact_every == compact_every - 1:
            views.compact(view, rows.sparkSession, path)

    return (events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
