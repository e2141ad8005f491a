"""Documents that arrive as a stream become index generations, one for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import build_index
from ..operators.mutate import sanitised_upload
from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """stream(filename, path, text, page_texts, doc_seq). Each micro-batch is a small segment; names are made safe, and of a name that comes more than once in a batch the last doc_seq counts."""

    def put(batch: DataFrame, number: int) -> None:
        store.upsert(build_index(sanitised_upload(batch)))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
