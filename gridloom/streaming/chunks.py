"""Chunks of corpora that arrive as files of blocks.

A corpus is chunked as a whole, so a file must hold whole corpora; each
micro-batch is chunked like a batch and appended under its batch number, so a
batch that is repeated after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking
from ..schemas import BLOCK


def read_blocks(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(BLOCK).option("maxFilesPerTrigger", max_files).parquet(folder)


def stream_chunks(blocks: DataFrame, target: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    def batch(rows: DataFrame, number: int) -> None:
        chunking.build_chunks(rows, **options).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = blocks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
