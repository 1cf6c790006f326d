"""Indexing a stream of requests: an extension; the batch interface is `Engine.index`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources.ingest import from_json_text


def index_stream(engine: Engine, requests: DataFrame, checkpoint: str, column: str = "value", once: bool = False) -> StreamingQuery:
    """Index each micro-batch of a stream of JSON requests, one a row.

    A micro-batch is one commit of the store. After a failure the last one may be indexed again, which changes nothing:
    the same ids are written over and postings are sets. Late documents go to the shard of their own day.
    """

    def commit(batch: DataFrame, _: int) -> None:
        engine.index(from_json_text(batch, column))

    writer = requests.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
