"""Integrity: references without blobs, blobs without packs, packs without references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import is_content


def dangling(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Referenced blobs that the index doesn't have, with the first snapshot that does: blob_id, snapshot_id."""
    first = refs.groupBy("blob_id").agg(F.min("snapshot_id").alias("snapshot_id"))
    return first.join(index.select("blob_id"), "blob_id", "left_anti")


def referenced_packs(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Packs that hold a referenced blob; a dangling blob marks none."""
    ids = refs.select("blob_id").distinct()
    return index.select("blob_id", "pack_id").join(ids, "blob_id", "left_semi").select("pack_id").distinct()


def missing_packs(refs: DataFrame, index: DataFrame, present: DataFrame) -> DataFrame:
    return referenced_packs(refs, index).join(present.select("pack_id"), "pack_id", "left_anti")


def orphan_packs(refs: DataFrame, index: DataFrame, present: DataFrame) -> DataFrame:
    return present.join(referenced_packs(refs, index), "pack_id", "left_anti")


def broken_blobs(index: DataFrame, packs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Blobs whose bytes don't hash to their id: blob_id, pack_id, and the index's columns of ``carry``.

    A pack's bytes meet its entries once; what is read is sliced and hashed in the JVM.
    """
    data = F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    both = index.join(packs.select("pack_id", "content"), "pack_id")
    return both.filter(~is_content(data, F.col("blob_id"))).select("blob_id", "pack_id", *carry)


def _blobs(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Referenced blobs with their pack, null where the index has none."""
    return refs.select("blob_id").distinct().join(index.select("blob_id", "pack_id"), "blob_id", "left")


def _packs(blobs: DataFrame, present: DataFrame) -> DataFrame:
    """Every pack that is used or there: pack_id, used, there, size."""
    used = blobs.filter("pack_id is not null").select("pack_id").distinct().withColumn("used", F.lit(True))
    size = F.max("size") if "size" in present.columns else F.lit(None).cast("long")
    there = present.groupBy("pack_id").agg(size.alias("size")).withColumn("there", F.lit(True))
    return used.join(there, "pack_id", "full").select("pack_id", F.coalesce("used", F.lit(False)).alias("used"), F.coalesce("there", F.lit(False)).alias("there"), "size")


def summary(refs: DataFrame, index: DataFrame, present: DataFrame) -> DataFrame:
    """One row of a structural report; orphans never make it fail.

    References meet the index once, and packs in use those in the store once; the counts
    are aggregates over these two joins.
    """
    count = lambda c: F.count(F.when(c, 1))
    blobs = _blobs(refs, index)
    packs = _packs(blobs, present).agg(count(F.col("there")).alias("packs"), count(~F.col("there")).alias("missing"), count(~F.col("used")).alias("orphans"))
    out = refs.agg(F.count_distinct("snapshot_id").alias("snapshots"))
    out = out.crossJoin(blobs.agg(F.count(F.lit(1)).alias("blobs_referenced"), count(F.col("pack_id").isNull()).alias("dangling"))).crossJoin(packs)
    out = out.withColumn("ok", (F.col("dangling") == 0) & (F.col("missing") == 0))
    return out.select("snapshots", "packs", "blobs_referenced", "dangling", "missing", "orphans", "ok")


def reclaimable(refs: DataFrame, index: DataFrame, present: DataFrame) -> DataFrame:
    """One row: packs and bytes that a collection would free, none unless the report is ok."""
    count = lambda c: F.count(F.when(c, 1))
    blobs, orphan = _blobs(refs, index), ~F.col("used")
    packs = _packs(blobs, present).agg(count(orphan).alias("n"), F.coalesce(F.sum(F.when(orphan, F.col("size"))), F.lit(0)).cast("long").alias("b"), count(~F.col("there")).alias("missing"))
    out = packs.crossJoin(blobs.agg(count(F.col("pack_id").isNull()).alias("dangling")))
    ok = (F.col("missing") == 0) & (F.col("dangling") == 0)
    return out.select(F.when(ok, F.col("n")).otherwise(F.lit(0)).alias("packs"), F.when(ok, F.col("b")).otherwise(F.lit(0)).alias("bytes"), ok.alias("allowed"))
