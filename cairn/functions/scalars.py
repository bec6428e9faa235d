"""Column expressions: content addresses, checksums, formats and predicates.

All are built-in Catalyst expressions, so they fold, prune and compile with the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_ID = "0" * 64


def content_id(data: Column) -> Column:
    """SHA-256 of binary data in lower-case hex."""
    return F.sha2(data, 256)


def is_content(data: Column, blob_id: Column) -> Column:
    return content_id(data) == blob_id


def parse_id(text: Column) -> Column:
    """An id in lower case, or null when it isn't 64 hex digits; upper case is accepted."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.lower(text))


def short_id(blob_id: Column) -> Column:
    return F.substring(blob_id, 1, 12)


def shard_of(blob_id: Column) -> Column:
    """The first byte in hex: the shard of the index and the folder of packs."""
    return F.substring(blob_id, 1, 2)


def is_zero(blob_id: Column) -> Column:
    return blob_id == ZERO_ID


def checksum(data: Column) -> Column:
    """SHA-256 in base64, as block services state it."""
    return F.base64(F.unhex(F.sha2(data, 256)))


def checksum_ok(data: Column, stated: Column, algorithm: Column | None = None) -> Column:
    """Whether a stated checksum holds; null when the algorithm isn't known."""
    ok = checksum(data) == stated
    return ok if algorithm is None else F.when(F.upper(algorithm) == "SHA256", ok)


def byte_range(data: Column, offset: Column, length: Column) -> Column:
    """``length`` bytes from ``offset``: to the end if negative, short past it; null for a negative offset."""
    n = F.octet_length(data)
    take = F.when(length < 0, n).otherwise(length)
    take = F.greatest(F.lit(0), F.least(take, n - offset))
    return F.when(offset >= 0, F.substring(data, (offset + 1).cast("int"), take.cast("int")))


def human_bytes(n: Column) -> Column:
    """Bytes with one decimal in steps of 1024, up to PiB; halves go to the even digit."""
    out = F.format_string("%d B", n)
    for i, unit in enumerate("KMGTP", 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {unit}iB", F.bround(n / float(1024**i), 1))).otherwise(out)
    return out


def dedup_ratio(deduped: Column, new: Column) -> Column:
    """Share of bytes that were known already; 0 when there are none."""
    return F.coalesce(F.try_divide(deduped.cast("double"), (new + deduped).cast("double")), F.lit(0.0))


def valid_key(key: Column) -> Column:
    """Object keys: 1 to 1024 bytes, relative, no NUL or backslash, no empty or dotted segment."""
    segments = F.split(key, "/", -1)
    return (
        key.isNotNull()
        & F.octet_length(key).between(1, 1024)
        & ~F.contains(key, F.lit("\x00"))
        & ~F.contains(key, F.lit("\\"))
        & F.forall(segments, lambda s: ~s.isin("", ".", ".."))
    )


def safe_path(path: Column) -> Column:
    """Restore paths: not empty, relative, and never above the target."""
    return path.isNotNull() & (path != "") & ~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\x00")) & F.forall(F.split(path, "/", -1), lambda s: s != "..")


def expired(expiry: Column, now: Column) -> Column:
    return expiry.isNotNull() & (now > expiry)


def page_size(asked: Column, default: int, least: int = 100, most: int = 10_000) -> Column:
    """A page size within a service's bounds; 0 stands for the default."""
    return F.least(F.greatest(F.when(asked == 0, F.lit(default)).otherwise(asked), F.lit(least)), F.lit(most))


def requests(total_bytes: Column, target: int) -> Column:
    """Store requests of a run: one per pack, and index and manifest."""
    if target <= 0:
        return F.lit(0).cast("long")
    return F.ceil(total_bytes / target).cast("long") + 2


def pack_key(pack_id: Column) -> Column:
    return F.concat(F.lit("packs/"), shard_of(pack_id), F.lit("/"), pack_id)


def pack_id_of(key: Column) -> Column:
    """The id in a pack's key, null for stray names."""
    return parse_id(F.substring_index(key, "/", -1))


def walk_order(path: Column) -> Column:
    """Sort key of a depth-first walk with sorted directories: the path's segments."""
    return F.split(path, "/", -1)


def config_problem(least: Column, average: Column, most: Column, normalization: Column, target: Column) -> Column:
    """Why sizes can't be a repository's, or null."""
    return (
        F.when(least <= 0, "no least size")
        .when((average <= least) | (most < average), "sizes out of order")
        .when(average.bitwiseAND(average - 1) != 0, "average not a power of two")
        .when(~normalization.between(0, 3), "normalization out of range")
        .when(target <= 0, "pack target of no size")
    )


def longest_wait(attempt: Column, throttled: Column, base: float = 0.1, most: float = 10.0, factor: float = 3.0) -> Column:
    """Seconds below which the wait after an attempt is drawn."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt) * F.when(throttled, F.lit(factor)).otherwise(F.lit(1.0)))


def status_kind(status: Column) -> Column:
    """The kind of error that an HTTP status means, by the table of ``kind_of_status``."""
    from cairn.errors import kind_of_status

    known = {s: kind_of_status(s).value for s in range(400, 600)}
    named = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.element_at(named, status.cast("int")), F.lit(kind_of_status(0).value))


def retryable(kind: Column) -> Column:
    from cairn.errors import Kind

    return kind.isin(Kind.THROTTLED.value, Kind.TRANSIENT.value)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def snapshot_problem(kind: Column, block_size: Column, files: Column, blocks: Column) -> Column:
    """Why a manifest is invalid, or null.

    ``files`` is array<struct<path, size, ...>>, ``blocks`` array<struct<index, blob>>; null
    stands for none.
    """
    no = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return (
        F.when(~F.coalesce(kind, F.lit("")).isin("files", "blocks"), "unknown kind")
        .when((kind == "files") & ~no(blocks), "blocks among files")
        .when((kind == "blocks") & ~no(files), "files among blocks")
        .when((kind == "blocks") & (F.coalesce(block_size, F.lit(0)) <= 0), "block size missing")
        .when(F.exists(files, lambda f: F.coalesce(f["path"], F.lit("")) == ""), "file without path")
        .when(F.exists(files, lambda f: f["size"] < 0), "file of negative size")
        .when(F.exists(blocks, lambda b: b["index"] < 0), "block of negative index")
        .when(F.exists(blocks, lambda b: is_zero(b["blob"])), "block without id")
    )
