"""Resumable landing: the same sink as the batch job, over newly arrived records only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from meshframe.sources.sinks import land_corpus


def land_stream(records: DataFrame, path: str, checkpoint: str, key: str = "stem", points: str = "points") -> StreamingQuery:
    """Process everything that has arrived since the last run, then stop.

    A micro-batch is appended; what is landed is neither read nor rewritten but for folders due for compaction. The corpus has one
    record per key when it is read, so a repeated micro-batch changes nothing.
    """
    return (
        records.writeStream.foreachBatch(lambda batch, _: land_corpus(batch, path, key, points))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
