"""Incremental ingest: a stream of files whose new blobs are appended to a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import dedup
from cairn.operators.chunking import ChunkerConfig, cdc_chunks


def ingest(files: DataFrame, table: str, checkpoint: str, config: ChunkerConfig = ChunkerConfig(), path_col: str = "path", content_col: str = "content") -> StreamingQuery:
    """Append (blob_id, length, copies, batch) of blobs that ``table`` doesn't have yet.

    Each batch is one run: chunk, reduce to distinct ids, anti-join with what is stored. A
    batch writes its own folder, replacing what an attempt before it left, and looks only at
    folders of other batches: run again after a failure, it has the same result.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        # The batch needs no cache: the files are read once, by the aggregation.
        chunks = cdc_chunks(df, config, path_col, content_col)
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        schema = "blob_id string, length long, copies long, batch long"
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(table)
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        known = spark.read.schema(schema).parquet(table).filter(f"batch <> {number}") if there else spark.createDataFrame([], schema)
        fresh = dedup.new_blobs(chunks, known)
        fresh.selectExpr("*", f"{number}L AS batch").write.mode("overwrite").partitionBy("batch").parquet(table)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
