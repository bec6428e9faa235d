"""Packs: which blobs go together, and the files that hold them.

Assembly is an ordered fold with a reset (a pack is closed by the blob that fills it), which
no window frame expresses. It runs over ids and lengths only, lane by lane: blobs are dealt
into lanes by the head of their id, so the fold is as wide as there are lanes, and whatever
order chunks arrive in, the same blobs make the same packs.
"""

from __future__ import annotations

import hashlib
import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.errors import CairnError, Kind

# The pack format, little-endian, header at the tail.
MAGIC, TRAILER, VERSION = b"DBPACK01", struct.Struct("<I8s"), 1
MOST_HEADER = 32 << 20
TARGET = 16 << 20
TAIL_GUESS = 64 << 10


def assemble(blobs: DataFrame, target: int = TARGET, lane_digits: int = 2, order: tuple[str, ...] = ("blob_id",)) -> DataFrame:
    """Give every blob its pack: lane, pack (number in the lane), seq, offset, blob_id, length.

    ``blobs`` has a row per blob. A pack is full when its size has reached ``target``; the
    last of a lane may be smaller; no blob is split. Lanes are the first hex digits of ids.
    """
    lane = F.substring("blob_id", 1, lane_digits) if lane_digits else F.lit("")
    d = blobs.select(lane.alias("lane"), "blob_id", "length", *[c for c in order if c not in ("blob_id", "length")])
    dealt = d.repartition("lane").sortWithinPartitions("lane", *order)

    def fold(batches):
        at, pack, seq, offset = None, 0, 0, 0
        for batch in batches:
            lanes, lengths = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            packs, seqs, offsets = [], [], []
            for x, n in zip(lanes, lengths, strict=True):
                if x != at:
                    at, pack, seq, offset = x, 0, 0, 0
                elif offset >= target:
                    pack, seq, offset = pack + 1, 0, 0
                packs.append(pack)
                seqs.append(seq)
                offsets.append(offset)
                seq, offset = seq + 1, offset + n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packs, pa.int64()), pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64()), batch.column(1), batch.column(2)], names=["lane", "pack", "seq", "offset", "blob_id", "length"])

    return dealt.mapInArrow(fold, "lane string, pack long, seq long, offset long, blob_id string, length long")


def pack_rows(assembled: DataFrame) -> DataFrame:
    """One row per pack: lane, pack, blobs, size."""
    return assembled.groupBy("lane", "pack").agg(F.count(F.lit(1)).alias("blobs"), F.sum("length").alias("size"))


def encode(blobs: list[tuple[str, bytes]]) -> tuple[str, bytes, list[dict]]:
    """A pack file: (pack_id, bytes, entries). A blob that repeats is stored once."""
    body, entries, seen = bytearray(), [], set()
    for blob_id, data in blobs:
        if blob_id not in seen:
            seen.add(blob_id)
            entries.append({"id": blob_id, "offset": len(body), "length": len(data)})
            body += data
    if not entries:
        raise CairnError(Kind.INVALID, "pack", "a pack needs a blob")
    header = json.dumps({"version": VERSION, "entries": entries}, separators=(",", ":")).encode()
    if len(header) > MOST_HEADER:
        raise CairnError(Kind.INVALID, "pack", f"header of {len(header)} bytes")
    body += header + TRAILER.pack(len(header), MAGIC)
    return hashlib.sha256(body).hexdigest(), bytes(body), entries


FILES = "lane string, pack long, pack_id string, blobs long, size long, content binary"


def files(assembled: DataFrame, data: DataFrame) -> DataFrame:
    """Pack files of assembled blobs (``data``: blob_id, data): lane, pack, pack_id, blobs, size, content.

    A pack's blobs meet in one task, which holds no more than a pack and its last blob.
    """

    def encoded(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["seq"].to_pylist(), table["blob_id"].to_pylist(), table["data"].to_pylist(), strict=True), key=lambda r: r[:2])
        pack_id, body, entries = encode([(b, d) for _, b, d in rows])
        lane, pack = table["lane"][0].as_py(), table["pack"][0].as_py()
        return pa.table([pa.array([lane], pa.string()), pa.array([pack], pa.int64()), pa.array([pack_id], pa.string()), pa.array([len(entries)], pa.int64()), pa.array([len(body)], pa.int64()), pa.array([body], pa.binary())], names=[f.split()[0] for f in FILES.split(", ")])

    return assembled.select("lane", "pack", "seq", "blob_id").join(data.select("blob_id", "data"), "blob_id").groupBy("lane", "pack").applyInArrow(encoded, FILES)


def problems(packs: DataFrame) -> DataFrame:
    """pack_id and what kind of error opening a pack file (pack_id, content) gives, null if none."""

    def check(batches):
        for batch in batches:
            kinds = []
            for c in batch.column(1).to_pylist():
                try:
                    read_header(lambda o, n, c=c: c[o : o + n], len(c))
                    kinds.append(None)
                except CairnError as e:
                    kinds.append(e.kind.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], names=["pack_id", "problem"])

    return packs.select("pack_id", "content").mapInArrow(check, "pack_id string, problem string")


def verified(packs: DataFrame) -> DataFrame:
    """pack_id and how many blobs of each pack were read and hashed to their ids; an error if one doesn't."""

    def read(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Reader(c).verify() for c in batch.column(1).to_pylist()], pa.int64())], names=["pack_id", "blobs"])

    return packs.select("pack_id", "content").mapInArrow(read, "pack_id string, blobs long")


def lookup(entries: DataFrame, pack_ids: DataFrame) -> DataFrame:
    """Asked (pack_id, blob_id) with offset and length in the pack, null where it has no such blob."""
    return pack_ids.join(entries, ["pack_id", "blob_id"], "left")


class ShortTail(Exception):
    """A tail that doesn't hold the header; ``need`` bytes from the end would."""

    def __init__(self, need: int):
        super().__init__(f"the last {need} bytes are needed")
        self.need = need


def parse_tail(tail: bytes, size: int) -> list[dict]:
    """Entries of a pack of ``size`` bytes, from its last bytes; every length is checked first."""

    def fail(why: str, kind: Kind = Kind.CORRUPT):
        raise CairnError(kind, "pack", why)

    if len(tail) > size:
        fail("more bytes than the pack has", Kind.INVALID)
    if len(tail) < TRAILER.size:
        raise ShortTail(TRAILER.size)
    n, magic = TRAILER.unpack(tail[-TRAILER.size :])
    if magic != MAGIC:
        fail("bad magic")
    if n == 0:
        fail("empty header")
    if n > MOST_HEADER:
        fail("header too long")
    need = n + TRAILER.size
    if need > size:
        fail("header longer than the pack")
    if len(tail) < need:
        raise ShortTail(need)
    try:
        header = json.loads(tail[len(tail) - need : len(tail) - TRAILER.size])
        version, entries = header["version"], header["entries"] or []
        spans = [(e["offset"], e["length"], e["id"]) for e in entries]
    except (ValueError, KeyError, TypeError) as e:
        raise CairnError(Kind.CORRUPT, "pack", f"header: {e}") from e
    if version != VERSION:
        fail(f"format version {version}", Kind.UNSUPPORTED)
    if not spans:
        fail("no entries")
    if any(o < 0 or k < 0 or o + k > size - need for o, k, _ in spans):
        fail("an entry lies outside the data")
    return entries


def read_header(read_range, size: int) -> list[dict]:
    """Entries through ``read_range(offset, n)``: one guess at the tail, one exact retry."""
    if size < TRAILER.size:
        raise CairnError(Kind.CORRUPT, "pack", "shorter than a trailer")
    n = min(size, TAIL_GUESS)
    try:
        return parse_tail(read_range(size - n, n), size)
    except ShortTail as e:
        return parse_tail(read_range(size - e.need, e.need), size)


class Reader:
    """Verified reads of one pack held as bytes."""

    def __init__(self, data: bytes):
        self.data = data
        self.entries = {e["id"]: e for e in parse_tail(data, len(data))}

    def lookup(self, blob_id: str) -> dict | None:
        return self.entries.get(blob_id)

    def read(self, blob_id: str) -> bytes:
        e = self.lookup(blob_id)
        if e is None:
            raise CairnError(Kind.NOT_FOUND, "pack", blob_id[:12])
        data = self.data[e["offset"] : e["offset"] + e["length"]]
        if hashlib.sha256(data).hexdigest() != blob_id:
            raise CairnError(Kind.CORRUPT, "pack", f"blob {blob_id[:12]} doesn't hash to its id")
        return data

    def verify(self) -> int:
        return sum(1 for b in self.entries if self.read(b) is not None)


def entries_of(packs: DataFrame) -> DataFrame:
    """pack_id, blob_id, offset, length of pack files (pack_id, content), parsed in tasks."""

    def parse(batches):
        for batch in batches:
            rows = [(p, e["id"], e["offset"], e["length"]) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in parse_tail(c, len(c))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["pack_id", "blob_id", "offset", "length"])

    return packs.select("pack_id", "content").mapInArrow(parse, "pack_id string, blob_id string, offset long, length long")
