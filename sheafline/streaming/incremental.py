"""Extension: new chunks of a stream are embedded and appended to an index as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sheafline.operators.retrieval import hash_index


def index_stream(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start appending the chunks of a streaming frame to the two tables under ``path``.

    A batch that is run again after a failure overwrites its own share, so each chunk is
    appended once.
    """

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        hash_index(batch.select("chunk_id", "text"), "chunk_id").write.mode("overwrite").parquet(f"{path}/vectors/batch={number}")

    return chunks.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
