"""Block devices: listing written blocks, and what changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import checksum_ok, expired

# Bounds of the block service.
BLOCK_SIZE = 512 << 10
LEAST_PAGE, MOST_PAGE = 100, 10_000
TOKEN_MINUTES, SNAPSHOT_DAYS = 60, 7
GIB = 1 << 30


def volume_size(gib: int) -> int:
    return gib * GIB


def listed(blocks: DataFrame) -> DataFrame:
    """Written blocks of a sparse device in order: block_index, blob_id."""
    return blocks.select("block_index", "blob_id")


def disordered(blocks: DataFrame, within: str = "snapshot") -> DataFrame:
    """Rows of a listing (snapshot, place, block_index) that don't exceed the one before."""
    before = F.lag("block_index").over(Window.partitionBy(within).orderBy("place"))
    return blocks.withColumn("before", before).filter("block_index <= before").drop("before")


def changed(now: DataFrame, then: DataFrame, keys: tuple[str, ...] = ("block_index",)) -> DataFrame:
    """Blocks of ``now`` that are new or differ from ``then``: keys, blob_id, is_new."""
    old = then.select(*keys, F.col("blob_id").alias("old_id"), F.lit(True).alias("there"))
    both = now.select(*keys, "blob_id").join(old, list(keys), "left")
    return both.filter(F.col("there").isNull() | (F.col("blob_id") != F.col("old_id"))).select(*keys, "blob_id", F.col("there").isNull().alias("is_new"))


def unreadable(blocks: DataFrame, now) -> DataFrame:
    """Blocks that may not be used: token expired, length out of bounds or checksum wrong."""
    n = F.octet_length("data")
    why = F.when(expired(F.col("expiry"), now), "expired").when(n > BLOCK_SIZE, "too long").when(~checksum_ok(F.col("data"), F.col("checksum")), "checksum")
    return blocks.withColumn("why", why).filter("why is not null")


def costs(devices: DataFrame, page: int = MOST_PAGE, price_list: float = 0.0006, price_read: float = 0.003) -> DataFrame:
    """Requests and price of each device (size, written), by the figures of ``request_cost``."""
    lists = F.ceil(F.col("written") / page).cast("long")
    price = lists / 1000 * price_list + F.col("written") / 1000 * price_read
    return devices.withColumns({"blocks": F.floor(F.col("size") / BLOCK_SIZE).cast("long"), "list_requests": lists, "get_requests": F.col("written").cast("long"), "usd": price})


def request_cost(size: int, written: int, page: int = MOST_PAGE, price_list: float = 0.0006, price_read: float = 0.003) -> dict:
    """Requests for a device of ``size`` bytes with ``written`` blocks, and their price per thousand."""
    lists, reads = -(-written // page), written
    return {"blocks": size // BLOCK_SIZE, "list_requests": lists, "get_requests": reads, "usd": lists / 1000 * price_list + reads / 1000 * price_read}
