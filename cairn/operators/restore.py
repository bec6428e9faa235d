"""Rebuilding files from blobs, verified and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import is_content


def fetch(refs: DataFrame, index: DataFrame, packs: DataFrame) -> DataFrame:
    """path, idx, blob_id, data of referenced blobs, cut from their packs.

    Ids are in lower-case hex and meet as bytes, which are half as long. Locations are joined
    first; a pack's bytes move once to where its entries are.
    """
    blob = F.unhex("blob_id").alias("blob")
    located = refs.select("path", "idx", blob).join(index.select(blob, "pack_id", "offset", "length"), "blob")
    data = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return located.join(packs.select("pack_id", "content"), "pack_id").select("path", "idx", F.lower(F.hex("blob")).alias("blob_id"), data.alias("data"))


def rebuild(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """path, size, content, ok: files (path, size) put together from blobs (path, idx, blob_id, data).

    ``ok`` says that every blob hashed to its id, none was missing and the size is right.
    A file of nearly 2 GiB or more must be written chunk by chunk instead (``ordered``).
    """
    good = F.min(is_content(F.col("data"), F.col("blob_id"))).alias("good")
    parts = blobs.groupBy("path").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY idx)").alias("p"), good)
    out = files.select("path", "size").join(parts, "path", "left")
    content = F.coalesce("p", F.lit(b""))
    out = out.select("path", "size", content.alias("content"), F.coalesce("good", F.lit(True)).alias("good"))
    return out.select("path", "size", "content", (F.col("good") & (F.octet_length("content") == F.col("size"))).alias("ok"))


def ordered(blobs: DataFrame, partitions: int) -> DataFrame:
    """Blobs of each file in one partition and in order, for writing files of any size."""
    return blobs.repartition(partitions, "path").sortWithinPartitions("path", "idx")
