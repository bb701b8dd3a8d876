"""Incremental refresh as a stream: each micro-batch of files merges into a versioned index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedupe import first_per_key


def refresh_stream(files: DataFrame, sink: str, checkpoint: str, derive, key: str = "path", order: str = "ts") -> StreamingQuery:
    """Runs derive(rows) on each batch's newest row of a key and appends the result under sink, a folder for each batch.

    A batch that is run again overwrites its own folder, so the sink holds each batch once."""

    def write(batch: DataFrame, number: int) -> None:
        derive(first_per_key(batch, [key], order, last=True)).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
