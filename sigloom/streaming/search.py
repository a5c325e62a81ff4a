"""Search of a stream of queries against an index that stands still: stateless, append mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sigloom.operators import search


def search_stream(queries: DataFrame, signature: DataFrame, samples: DataFrame, k: int, h: int, m: int, sink: Callable[[DataFrame, int], None], threshold: float = 1.0, score: bool = False, checkpoint: str | None = None) -> StreamingQuery:
    """Each micro-batch of (query_id, seq) is one bulk search, handed to `sink(hits, batch)`."""

    def one(batch: DataFrame, number: int) -> None:
        sink(search.search(batch.select("query_id", "seq"), signature, samples, k, h, m, threshold, score), number)

    writer = queries.writeStream.outputMode("append").foreachBatch(one).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
