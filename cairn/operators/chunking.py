"""Content-defined and fixed-size chunking.

The boundary test is a rolling hash over the last 64 bytes. Instead of rolling it byte by
byte, the kernel builds it for a whole buffer with six shift-and-add doublings and looks up
the first hit of each chunk; only the chain of cuts is sequential, one step per chunk.
Chunks leave as rows of (path, idx, offset, length, blob_id), with their bytes only when
asked for: what is compared, counted and joined later is about a hundred bytes a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.errors import CairnError, Kind
from cairn.functions.scalars import content_id
from cairn.plans.durable import pick

U = np.uint64

# The seed and constants of the generator that fills the byte table, and the
# default sizes. They are part of the stored format.
SEED = 0x9E3779B97F4A7C15
STEP, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
DEFAULT_SIZES = (16 << 10, 64 << 10, 256 << 10)
DEFAULT_NORMALIZATION = 2
MOST_BITS = 48


def byte_table() -> np.ndarray:
    """256 words of a splitmix generator, in the order of bytes."""
    state = np.arange(1, 257, dtype=U) * U(STEP) + U(SEED)
    z = (state ^ (state >> U(30))) * U(MIX_1)
    z = (z ^ (z >> U(27))) * U(MIX_2)
    return z ^ (z >> U(31))


GEAR = byte_table()


def spread_mask(bits: int) -> int:
    """``bits`` ones, evenly over the places 16 to 63, where the hash has seen most bytes."""
    if bits <= 1:
        return 1 << 16
    return sum({1 << (16 + i * 47 // (bits - 1)) for i in range(bits)})


@dataclass(frozen=True)
class ChunkerConfig:
    """Sizes in bytes; ``normalization`` makes cuts rarer before the average and likelier after."""

    min_size: int = DEFAULT_SIZES[0]
    avg_size: int = DEFAULT_SIZES[1]
    max_size: int = DEFAULT_SIZES[2]
    normalization: int = DEFAULT_NORMALIZATION

    def __post_init__(self):
        def refuse(why: str):
            raise CairnError(Kind.INVALID, "chunker config", why)

        if self.min_size <= 0:
            refuse("min must be 1 at least")
        if not self.min_size < self.avg_size <= self.max_size:
            refuse("sizes must be min < avg <= max")
        if self.avg_size & (self.avg_size - 1):
            refuse("avg must be a power of two")
        if not 0 <= self.normalization <= 3:
            refuse("normalization must be from 0 to 3")

    @property
    def masks(self) -> tuple[int, int]:
        """Strict, for bytes before the average, and loose."""
        bits = self.avg_size.bit_length() - 1
        return spread_mask(min(MOST_BITS, bits + self.normalization)), spread_mask(max(1, bits - self.normalization))


SMALL = ChunkerConfig(64, 256, 1024, 2)
SEGMENT = 1 << 15  # bytes whose hashes fit a core's cache


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash at every byte over it and the 63 before, modulo 2**64."""
    h = GEAR[data]
    for w in (1, 2, 4, 8, 16, 32):
        if len(h) > w:
            h[w:] += h[:-w] << U(w)
    return h


def scan(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ``rolling`` of the segment there), in buffers that the next segment uses again."""
    most = min(len(data), SEGMENT + 63)
    place, hashes, moved = np.empty(most, np.intp), np.empty(most, U), np.empty(most, U)
    for start in range(0, len(data), SEGMENT):
        before = min(63, start)
        part = data[start - before : start + SEGMENT]
        n = len(part)
        place[:n] = part
        h = np.take(GEAR, place[:n], out=hashes[:n], mode="clip")
        for w in (1, 2, 4, 8, 16, 32):
            if n > w:
                np.add(h[w:], np.left_shift(h[:-w], U(w), out=moved[: n - w]), out=h[w:])
        yield start, h[before:]


def _hits(data: np.ndarray, masks: tuple[int, int]) -> list[np.ndarray]:
    """Places whose hash passes each mask; a segment at a time, so memory is bounded."""
    out: list[list[np.ndarray]] = [[], []]
    held = np.empty(min(len(data), SEGMENT), U)
    for start, h in scan(data):
        for k, mask in enumerate(masks):
            out[k].append(np.flatnonzero(np.bitwise_and(h, U(mask), out=held[: len(h)]) == 0) + start)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def cuts(data: bytes | memoryview, config: ChunkerConfig) -> list[int]:
    """Ends of the chunks of a buffer; none for an empty one.

    A chunk's hash begins anew at its byte ``min_size``: there the last 63 bytes aren't all
    its own, so its first 63 tests are made on its own bytes alone.
    """
    view = np.frombuffer(data, np.uint8)
    n, ends, at = len(view), [], 0
    if not n:
        return ends
    strict, loose = (U(m) for m in config.masks)
    hits: list[np.ndarray] | None = None
    while at < n:
        a, top = at + config.min_size, min(at + config.max_size, n)
        normal = min(at + config.avg_size, n)
        if a >= top:
            at = top
            ends.append(at)
            continue
        warm = min(a + 63, top)
        h = rolling(view[a:warm])
        places = np.arange(a, warm)
        near = np.flatnonzero((h & np.where(places < normal, strict, loose)) == 0)
        if len(near):
            at = a + int(near[0]) + 1
        else:
            if hits is None:
                hits = _hits(view, config.masks)
            found = top
            for place, lo, hi in ((hits[0], warm, normal), (hits[1], max(warm, normal), top)):
                k = np.searchsorted(place, lo)
                if lo < hi and k < len(place) and place[k] < hi:
                    found = int(place[k]) + 1
                    break
            at = found
        ends.append(at)
    return ends


AT_ONCE = 4 << 20
WARM = np.arange(1, 64, dtype=U)


def cuts_of(files: list[bytes], config: ChunkerConfig) -> list[np.ndarray]:
    """Ends of the chunks of several small files, all chains a step at a time.

    The files lie end to end. A chunk's own hash at its first 63 tests is the hash over 64
    bytes less what stood before the chunk's byte ``min_size``; later ones need no care.
    """
    sizes = np.array([len(f) for f in files], np.int64)
    data = np.frombuffer(b"".join(files), np.uint8)
    h = np.zeros(len(data) + 63, U)
    for start, part in scan(data):
        h[start : start + len(part)] = part
    after = np.lib.stride_tricks.sliding_window_view(h, 63)
    strict, loose = (U(m) for m in config.masks)
    never = np.iinfo(np.int64).max
    strict_hits, loose_hits = (np.append(np.flatnonzero((h[: len(data)] & m) == 0), never) for m in (strict, loose))
    first = np.cumsum(sizes) - sizes
    file, at, end = np.arange(len(files)), first.copy(), first + sizes
    keep = sizes > 0
    file, at, end = file[keep], at[keep], end[keep]
    who, where = [], []
    while len(at):
        a, top, normal = at + config.min_size, np.minimum(at + config.max_size, end), np.minimum(at + config.avg_size, end)
        cut = top.copy()
        go = np.flatnonzero(a < top)
        if len(go):
            b, t, m = a[go], top[go], normal[go]
            own = after[b]
            own -= h[b - 1][:, None] << WARM
            if config.avg_size - config.min_size >= 63:  # all these tests stand before the average
                own &= strict
            else:
                own &= np.where(b[:, None] + np.arange(63) < m[:, None], strict, loose)
            near = own == 0
            step = near.argmax(axis=1)
            found = np.where(near[np.arange(len(b)), step] & (b + step < t), b + step, never)
            warm = np.minimum(b + 63, t)
            later = strict_hits[np.searchsorted(strict_hits, warm)]
            late = loose_hits[np.searchsorted(loose_hits, np.maximum(warm, m))]
            later = np.where(later < m, later, np.where(late < t, late, t - 1))
            cut[go] = np.where(found < never, found, later) + 1
        who.append(file)
        where.append(cut)
        more = cut < end
        file, at, end = file[more], cut[more], end[more]
    if not who:
        return [np.zeros(0, np.int64) for _ in files]
    whose, ends = np.concatenate(who), np.concatenate(where)
    order = np.argsort(whose, kind="stable")  # steps are in order, so a file's cuts stay so
    ends = ends[order] - first[whose[order]]
    return np.split(ends, np.cumsum(np.bincount(whose, minlength=len(files)))[:-1])


def all_cuts(files: list[bytes], config: ChunkerConfig) -> Iterator[np.ndarray | list[int]]:
    """``cuts`` of each file: small ones together, large ones alone and in segments."""
    held, size = [], 0
    for f in files:
        if held and size + len(f) > AT_ONCE:
            yield from cuts_of(held, config)
            held, size = [], 0
        if len(f) > AT_ONCE:
            yield cuts(f, config)
        else:
            held.append(f)
            size += len(f)
    if held:
        yield from cuts_of(held, config)


def split(data: bytes, config: ChunkerConfig) -> list[bytes]:
    ends = cuts(data, config)
    return [data[i:j] for i, j in zip([0, *ends], ends)]  # noqa: B905


def stream(read, config: ChunkerConfig, size: int = 4 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, chunk) of a byte stream; ``read(n)`` gives b'' at its end.

    A read error is raised once what came before it has been given.
    """
    held, offset, error, done = b"", 0, None, False
    while not done:
        try:
            more = read(size)
        except Exception as e:
            more, error = b"", e
        done = not more
        held += more
        ends = cuts(held, config)
        start = 0
        for end in ends:
            # A chunk near the end of what is held could be cut elsewhere with more bytes.
            if not done and len(held) - start < config.max_size:
                break
            yield offset + start, held[start:end]
            start = end
        held, offset = held[start:], offset + start
    if error is not None:
        raise error


CHUNK_FIELDS = "idx int, offset long, length long, blob_id string"


def cdc_chunks(files: DataFrame, config: ChunkerConfig = ChunkerConfig(), path_col: str = "path", content_col: str = "content", with_data: bool = False) -> DataFrame:
    """Content-defined chunks of every file: path, idx, offset, length, blob_id (and data).

    A file stays in one task; files are dealt out by the scan, nothing is shuffled, unless
    the scan has fewer parts than there are cores. Null content is empty, and an empty file
    has no chunk.
    """
    d = pick(files, _path=path_col, _content=content_col).withColumn("_content", F.col("_content").cast("binary"))
    kind = d.schema["_path"].dataType.simpleString()
    cores = files.sparkSession.sparkContext.defaultParallelism
    if not files.isStreaming and d.rdd.getNumPartitions() < cores:
        d = d.repartition(cores)

    def chunk(batches):
        for batch in batches:
            paths, row = batch.column(0), []
            idx, offset, length, ids, data = [], [], [], [], []
            contents = [c or b"" for c in batch.column(1).to_pylist()]
            for i, (content, ends) in enumerate(zip(contents, all_cuts(contents, config), strict=True)):
                view, start = memoryview(content), 0
                for k, end in enumerate(map(int, ends)):
                    row.append(i)
                    idx.append(k)
                    offset.append(start)
                    length.append(end - start)
                    ids.append(hashlib.sha256(view[start:end]).hexdigest())
                    if with_data:
                        data.append(content[start:end])
                    start = end
            cols = [paths.take(pa.array(row, pa.int32())), pa.array(idx, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.string())]
            names = ["path", "idx", "offset", "length", "blob_id"]
            if with_data:
                cols, names = [*cols, pa.array(data, pa.binary())], [*names, "data"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return d.mapInArrow(chunk, f"path {kind}, {CHUNK_FIELDS}" + (", data binary" if with_data else ""))


def streamed_chunks(files: DataFrame, config: ChunkerConfig = ChunkerConfig(), read: int = 1 << 20) -> DataFrame:
    """The chunks of files (path, content) read as streams, ``read`` bytes at a time: as ``cdc_chunks`` gives them."""
    import io

    kind = files.schema["path"].dataType.simpleString()

    def chunk(batches):
        for batch in batches:
            for i, content in enumerate(batch.column(1).to_pylist()):
                parts = [(o, len(d), hashlib.sha256(d).hexdigest()) for o, d in stream(io.BytesIO(content or b"").read, config, read)]
                if parts:
                    o, n, b = zip(*parts, strict=True)
                    path = batch.column(0).take(pa.array([i] * len(parts)))
                    yield pa.RecordBatch.from_arrays([path, pa.array(range(len(parts)), pa.int32()), pa.array(o, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.string())], names=["path", "idx", "offset", "length", "blob_id"])

    return files.select("path", "content").mapInArrow(chunk, f"path {kind}, {CHUNK_FIELDS}")


def fixed_blocks(files: DataFrame, size: int, path_col: str = "path", content_col: str = "content", with_data: bool = False) -> DataFrame:
    """Blocks of ``size`` bytes (the last may be shorter), in built-in expressions only."""
    d = pick(files, path=path_col, _content=content_col).withColumn("_content", F.coalesce(F.col("_content").cast("binary"), F.lit(b"")))
    n = F.octet_length("_content")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    d = d.select("path", "_content", F.posexplode(starts).alias("idx", "_start"))
    data = F.substring(F.col("_content"), F.col("_start") + 1, F.lit(size))
    out = d.select("path", "idx", F.col("_start").cast("long").alias("offset"), F.octet_length(data).cast("long").alias("length"), content_id(data).alias("blob_id"), *([data.alias("data")] if with_data else []))
    return out


def size_distribution(chunks: DataFrame, config: ChunkerConfig) -> DataFrame:
    """One row: n, mean, min, p10, p50, p90, p99, max and chunks cut at the largest size.

    The last chunk of every file is left out, its size being the file's doing. A percentile
    is the value at place floor((n - 1) * p) of the sorted sizes. Sizes are counted first,
    so what is sorted has at most a row per possible size.
    """
    from pyspark.sql import Window

    last = F.max("idx").over(Window.partitionBy("path"))
    body = chunks.select("idx", "length", last.alias("last")).filter("idx < last")
    counts = body.groupBy("length").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(F.lit(0)).orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(0))))
    pick_at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * F.lit(p)), F.col("length")))
    return ranked.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        (F.sum(F.col("length") * F.col("c")) / F.sum("c")).alias("mean"),
        F.min("length").alias("min"),
        *[pick_at(p / 100).alias(f"p{p}") for p in (10, 50, 90, 99)],
        F.max("length").alias("max"),
        F.coalesce(F.sum(F.when(F.col("length") == config.max_size, F.col("c"))), F.lit(0)).alias("forced"),
    )


def resync(before: DataFrame, after: DataFrame, shift: int = 1) -> DataFrame:
    """One row: boundaries of ``after``, and those that stand ``shift`` bytes on from one of ``before``.

    A boundary is a chunk's end; the end of the file counts.
    """
    ends = lambda c: c.select("path", (F.col("offset") + F.col("length")).alias("end"))
    old = ends(before).withColumn("end", F.col("end") + shift).withColumn("met", F.lit(1))
    return ends(after).join(old, ["path", "end"], "left").agg(F.count(F.lit(1)).alias("boundaries"), F.count("met").alias("matched"), (F.count("met") / F.count(F.lit(1))).alias("rate"))
