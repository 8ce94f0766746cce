"""Streaming.

The reference reads finite files only: it has no stream source, watermark,
event-time window or state.  Nothing here re-implements one.  The single
helper applies the batch scoring plan to each micro-batch of new rows, for
callers who receive scoring rows as a stream (``foreachBatch``), so the same
operators serve both modes.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame


def score_micro_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str,
                        checkpoint: str, fmt: str = "parquet"):
    """Start a query that scores each micro-batch with the batch plan ``score``
    into its own folder ``path/batch=<id>``.  A batch that is retried after a failure
    replaces its folder, so its rows are there once."""
    def _sink(batch: DataFrame, epoch: int) -> None:
        score(batch).write.mode("overwrite").format(fmt).save(f"{path}/batch={epoch}")

    return (stream.writeStream.foreachBatch(_sink)
            .option("checkpointLocation", checkpoint).start())
