"""What is new, what is known, and the figures of a run.

Everything here is exact and needs a chunk's id and length only; bytes are fetched last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.errors import CairnError, Kind
from cairn.functions.scalars import dedup_ratio


def distinct_blobs(chunks: DataFrame) -> DataFrame:
    """blob_id, length, copies: partial counts leave each task before the shuffle."""
    return chunks.groupBy("blob_id").agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("copies"))


def new_blobs(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct blobs that the index doesn't have: blob_id, length, copies.

    Aggregated before the join, so a chunk that half the files share is one row in it, and
    both sides are hashed on blob_id once.
    """
    return distinct_blobs(chunks).join(index.select("blob_id"), "blob_id", "left_anti")


def run_stats(chunks: DataFrame, index: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row: blobs and bytes, new and deduplicated, their ratio; files and bytes if given.

    The order in which chunks arrive makes no difference.
    """
    known = distinct_blobs(chunks)
    if index is not None:
        known = known.join(index.select("blob_id", F.lit(True).alias("stored")).dropDuplicates(["blob_id"]), "blob_id", "left")
    else:
        known = known.withColumn("stored", F.lit(None).cast("boolean"))
    fresh = F.col("stored").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = known.agg(
        zero(F.sum("copies")).alias("chunks"),
        zero(F.sum(F.when(fresh, 1))).alias("blobs_new"),
        zero(F.sum(F.when(fresh, F.col("length")))).alias("bytes_new"),
        zero(F.sum(F.col("copies") * F.col("length"))).alias("bytes_read"),
    )
    out = out.select(
        "chunks",
        "blobs_new",
        (F.col("chunks") - F.col("blobs_new")).alias("blobs_deduped"),
        "bytes_new",
        (F.col("bytes_read") - F.col("bytes_new")).alias("bytes_deduped"),
        dedup_ratio(F.col("bytes_read") - F.col("bytes_new"), F.col("bytes_new")).alias("dedup_ratio"),
    )
    if files is not None:
        total = files.agg(F.count(F.lit(1)).alias("files_total"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes_total"))
        out = out.crossJoin(total)  # one row each
    return out


def over_byte_cap(files: DataFrame, cap: int, by: tuple[str, ...] = ()) -> DataFrame:
    """bytes, and whether reading them would pass the cap (0: none), of all files or by some columns."""
    out = files.groupBy(*by).agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    return out.withColumn("over", (F.lit(cap) > 0) & (F.col("bytes") > cap))


def check_byte_cap(files: DataFrame, cap: int) -> None:
    """Refuse a run that would read more than ``cap`` bytes, before anything is written."""
    found = over_byte_cap(files, cap).first()
    if found.over:
        raise CairnError(Kind.INVALID, "backup", f"{found.bytes} bytes exceed the cap of {cap}")


def estimate(files: DataFrame, target: int) -> DataFrame:
    """One row: files, bytes and the requests that storing them would take."""
    from cairn.functions.scalars import requests

    out = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    return out.withColumn("requests", requests(F.col("bytes"), target))
