"""Streams against an index: each micro-batch is a query, so no state and no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinmesh.functions.text import Serializer
from kinmesh.operators.linker import LinkageIndex
from kinmesh.sources.records import Source


def link_stream(
    stream: DataFrame, index: LinkageIndex, *, id_column: str, sink: Callable[[DataFrame, int], None], checkpoint: str,
    serializer: Serializer | None = None, once: bool = False,
) -> StreamingQuery:
    """Link a stream's records with the index; `sink` gets each batch's outcomes and its number.

    A batch may come again after a failure, with its number: a sink that overwrites by number is exactly-once.
    """

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            sink(index.query(Source(df, id_column, serializer)).outcomes, number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
