"""The index: where each blob is stored. First insert wins; kept as a keyed table."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.errors import CairnError, Kind, kind_of_os
from cairn.functions.scalars import shard_of

SCHEMA = "blob_id string, pack_id string, offset long, length long"


def first_wins(entries: DataFrame) -> DataFrame:
    """One location per blob: that of the least (pack_id, offset).

    A minimum over a struct, so a blob with many locations is reduced in the tasks that
    read them; no window gathers them.
    """
    best = F.min(F.struct("pack_id", "offset", "length")).alias("at")
    return entries.groupBy("blob_id").agg(best).select("blob_id", "at.pack_id", "at.offset", "at.length")


def insert(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that a merge would append: new blobs only, one location each."""
    return first_wins(entries).join(index.select("blob_id"), "blob_id", "left_anti")


def delete(index: DataFrame, blob_ids: DataFrame) -> DataFrame:
    return index.join(blob_ids.select("blob_id"), "blob_id", "left_anti")


def lookup(blob_ids: DataFrame, index: DataFrame) -> DataFrame:
    """Each asked id with its location, null where unknown."""
    return blob_ids.join(index, "blob_id", "left")


def rebuild(pack_entries: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """The index from pack headers; with ``present``, of packs that are still there only."""
    if present is not None:
        pack_entries = pack_entries.join(present.select("pack_id"), "pack_id", "left_semi")
    return first_wins(pack_entries)


def size(index: DataFrame) -> DataFrame:
    """One row: the number of blobs that the index has."""
    return index.agg(F.count(F.lit(1)).alias("blobs"))


def dumped(index: DataFrame) -> DataFrame:
    """The exchange format of each shard: shard, entries, content, its entries by blob id."""
    import pyarrow as pa

    def encoded(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("blob_id", "pack_id", "offset", "length")), strict=True))
        return pa.table([pa.array([rows[0][0][:2]], pa.string()), pa.array([len(rows)], pa.int64()), pa.array([dump(rows)], pa.binary())], names=["shard", "entries", "content"])

    return index.groupBy(shard_of(F.col("blob_id")).alias("shard")).applyInArrow(encoded, "shard string, entries long, content binary")


def loaded(dumps: DataFrame) -> DataFrame:
    """The index of such contents again."""
    import pyarrow as pa

    def parse(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                cols = list(zip(*load(content), strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 2 + [pa.int64()] * 2, strict=True)], names=["blob_id", "pack_id", "offset", "length"])

    return dumps.select("content").mapInArrow(parse, SCHEMA)


def shard_histogram(index: DataFrame) -> DataFrame:
    """Entries of each of the 256 shards, empty ones included."""
    shards = index.sparkSession.range(256).select(F.lower(F.lpad(F.hex("id"), 2, "0")).alias("shard"))
    counts = index.groupBy(shard_of(F.col("blob_id")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return shards.join(counts, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shard_stats(index: DataFrame) -> DataFrame:
    """Mean, least, most and population deviation over the 256 shards."""
    return shard_histogram(index).agg(F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.stddev_pop("n").alias("sigma"))


# The exchange format of an index, little-endian.
MAGIC, ENTRY, MOST_ENTRIES = b"DBIDX001", struct.Struct("<32s32sQQ"), 512 << 20


def dump(entries: Iterable[tuple[str, str, int, int]]) -> bytes:
    """An index as one object, for exchange with other tools; tables stay in Parquet."""
    body = [ENTRY.pack(bytes.fromhex(b), bytes.fromhex(p), o, n) for b, p, o, n in entries]
    return MAGIC + struct.pack("<Q", len(body)) + b"".join(body)


def load(data: bytes) -> list[tuple[str, str, int, int]]:
    def corrupt(why: str):
        raise CairnError(Kind.CORRUPT, "index", why)

    if len(data) < 16:
        corrupt("header cut short")
    if data[:8] != MAGIC:
        corrupt("bad magic")
    (count,) = struct.unpack_from("<Q", data, 8)
    if count > MOST_ENTRIES:
        corrupt(f"{count} entries exceed the limit")
    if len(data) < 16 + count * ENTRY.size:
        corrupt("entries cut short")
    if len(data) > 16 + count * ENTRY.size:
        corrupt("bytes after the last entry")
    out: dict[str, tuple] = {}
    for b, p, o, n in ENTRY.iter_unpack(data[16:]):
        if o >= 1 << 63 or n >= 1 << 63:
            corrupt("negative offset or length")
        out.setdefault(b.hex(), (b.hex(), p.hex(), o, n))
    return list(out.values())




PART = 100_000


def _dtype():
    import numpy as np

    return np.dtype([("blob_id", "S32"), ("pack_id", "S32"), ("offset", "<u8"), ("length", "<u8")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table of a dump in a file, read by tasks in parts; what ``load`` refuses is refused here."""
    import numpy as np

    def corrupt(why: str):
        raise CairnError(Kind.CORRUPT, "index", why)

    try:
        with open(path, "rb") as f:
            start, total = f.read(16), os.fstat(f.fileno()).st_size
    except OSError as e:
        raise CairnError(kind_of_os(e), "index", e) from e
    if len(start) < 16 or total < 16 + min(struct.unpack_from("<Q", start, 8)[0], MOST_ENTRIES) * ENTRY.size:
        load(start)  # says what is wrong
    (count,) = struct.unpack_from("<Q", start, 8)
    if start[:8] != MAGIC or count > MOST_ENTRIES:
        load(start)
    if total > 16 + count * ENTRY.size:
        corrupt("bytes after the last entry")
    kind, size, last, rising = _dtype(), ENTRY.size, b"", True
    for at in range(0, count, PART):
        rows = np.fromfile(path, kind, min(PART, count - at), offset=16 + at * size)
        if ((rows["offset"] | rows["length"]) >> np.uint64(63)).any():
            corrupt("negative offset or length")
        ids = np.ascontiguousarray(rows["blob_id"])
        rising = rising and bool((at == 0 or ids[0] > last) and (ids[1:] > ids[:-1]).all())
        last = ids[-1]

    def parse(batches):
        import pyarrow as pa

        def hexed(column):
            text = np.ascontiguousarray(column).tobytes().hex().encode()
            return pa.Array.from_buffers(pa.string(), len(column), [None, pa.py_buffer(np.arange(len(column) + 1, dtype=np.int32) * 64), pa.py_buffer(text)])

        for batch in batches:
            for part in batch.column(0).to_pylist():
                for at in range(part * PART, min(count, (part + 1) * PART), 10_000):
                    rows = np.fromfile(path, _dtype(), min(10_000, count - at), offset=16 + at * size)
                    cols = [hexed(rows["blob_id"]), hexed(rows["pack_id"]), *(pa.array(rows[c].astype(np.int64)) for c in ("offset", "length"))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(at, at + len(rows)))], names=["blob_id", "pack_id", "offset", "length", "place"])

    parts = -(-count // PART)
    d = spark.range(0, parts, 1, max(1, min(parts, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(parse, f"{SCHEMA}, place long")
    if not rising:  # the first of each blob; ids that rise have no other
        best = F.min(F.struct("place", "pack_id", "offset", "length")).alias("at")
        d = d.groupBy("blob_id").agg(best).select("blob_id", "at.*")
    return d.select("blob_id", "pack_id", "offset", "length")


def write(index: DataFrame, path: str) -> None:
    """``dump`` of a table, by blob id, into a file that tasks can open: each writes its shards where they belong."""
    counts = {r.shard: r.n for r in shard_histogram(index).collect()}
    begin, at, size = {}, 16, ENTRY.size
    for shard in sorted(counts):
        begin[shard], at = at, at + counts[shard] * size
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<Q", (at - 16) // size))
        f.truncate(at)
    raw = index.select(F.unhex("blob_id").alias("blob_id"), F.unhex("pack_id").alias("pack_id"), "offset", "length")

    def put(batches):
        import numpy as np
        import pyarrow as pa

        done: dict[str, int] = {}
        for batch in batches:
            rows = np.empty(batch.num_rows, _dtype())
            for i, name in enumerate(rows.dtype.names):
                rows[name] = batch.column(i).to_pylist() if i < 2 else batch.column(i).to_numpy()
            heads = np.frombuffer(rows.tobytes(), np.uint8)[::size]
            ends = [*(np.flatnonzero(np.diff(heads)) + 1).tolist(), len(rows)]
            with open(path, "r+b") as f:
                for a, b in zip([0, *ends], ends, strict=False):
                    if a < b:
                        shard = f"{heads[a]:02x}"
                        f.seek(begin[shard] + done.get(shard, 0) * size)
                        f.write(rows[a:b].tobytes())
                        done[shard] = done.get(shard, 0) + b - a
        yield pa.RecordBatch.from_arrays([pa.array([sum(done.values())], pa.int64())], names=["n"])

    # A task that runs again writes the same bytes to the same places.
    dealt = raw.repartition(F.substring("blob_id", 1, 1)).sortWithinPartitions("blob_id")
    dealt.mapInArrow(put, "n long").agg(F.sum("n")).collect()
