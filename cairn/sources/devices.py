"""Block devices: a paged listing service, checked reads, a data source that reads in tasks, and fakes."""

from __future__ import annotations

import base64
import hashlib
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.errors import CairnError, Kind
from cairn.operators.blocks import BLOCK_SIZE, LEAST_PAGE, MOST_PAGE, volume_size
from cairn.plans.shipping import ship


@dataclass(frozen=True)
class BlockRef:
    index: int
    token: str
    expiry: float | None = None

    def expired(self, now: float) -> bool:
        return self.expiry is not None and now > self.expiry


@dataclass(frozen=True)
class ChangedRef:
    ref: BlockRef
    is_new: bool


def clamp_page(asked: int, default: int = MOST_PAGE) -> int:
    return min(MOST_PAGE, max(LEAST_PAGE, asked or default))


class BlockSource:
    """A device behind a paged service: ``service`` lists, lists changes and reads blocks."""

    block_size = BLOCK_SIZE

    def __init__(self, service, snapshot: str, policy=None, verify: bool = True, clock=time.time):
        self.service, self.snapshot, self.policy, self.verify, self.clock = service, snapshot, policy, verify, clock

    def _call(self, op):
        return self.policy.run(op) if self.policy else op()

    def size(self) -> int:
        return volume_size(self._call(lambda: self.service.list_blocks(self.snapshot, None, 100))["volume_gib"])

    def _pages(self, ask) -> Iterator[dict]:
        """Pages until there is no next token; an empty page ends nothing."""
        token, last = None, -1
        while True:
            page = self._call(lambda t=token: ask(t))
            for b in page["blocks"]:
                if b["index"] <= last:
                    raise CairnError(Kind.CORRUPT, "list blocks", f"index {b['index']} after {last}")
                last = b["index"]
                yield b
            token = page.get("next")
            if not token:
                return

    def list_blocks(self, first: int = 0, end: int | None = None) -> Iterator[BlockRef]:
        """Written blocks in order, from ``first`` on and before ``end``; pages are asked for as they are needed."""
        for b in self._pages(lambda t: self.service.list_blocks(self.snapshot, t, MOST_PAGE, first)):
            if end is not None and b["index"] >= end:
                return
            yield BlockRef(b["index"], b["token"], b.get("expiry"))

    def list_changed(self, since: str) -> Iterator[ChangedRef]:
        for b in self._pages(lambda t: self.service.list_changed(since, self.snapshot, t, MOST_PAGE)):
            if not b.get("second"):
                raise CairnError(Kind.CORRUPT, "list changed blocks", f"block {b['index']} has no token")
            yield ChangedRef(BlockRef(b["index"], b["second"], b.get("expiry")), not b.get("first"))

    def read_block(self, ref: BlockRef) -> bytes:
        """A block's bytes; an expired token isn't tried, a wrong checksum isn't retried."""
        if not ref.token:
            raise CairnError(Kind.INVALID, "read block", "no token")
        if ref.expired(self.clock()):
            raise CairnError(Kind.EXPIRED, "read block", f"token of block {ref.index}")

        def once() -> bytes:
            got = self.service.read_block(self.snapshot, ref.index, ref.token)
            data = got["data"]
            if len(data) > BLOCK_SIZE or len(data) != got.get("length", len(data)):
                raise CairnError(Kind.CORRUPT, "read block", f"{len(data)} bytes")
            if self.verify:
                check(data, got["checksum"], got.get("algorithm", "SHA256"))
            return data

        return self._call(once)


def check(data: bytes, stated: str, algorithm: str = "SHA256") -> None:
    if algorithm.upper() != "SHA256":
        raise CairnError(Kind.UNSUPPORTED, "checksum", algorithm)
    if base64.b64encode(hashlib.sha256(data).digest()).decode() != stated:
        raise CairnError(Kind.CORRUPT, "checksum", "doesn't hold")


DEVICE = "block_index long, blob_id string, length long"


class BlockReader(DataSourceReader):
    """Reads a device in tasks, each a range of block indexes.

    A task lists its own range and reads a block when its token is at hand, so no listing
    passes through the driver and no token waits longer than the rest of its page. A
    snapshot doesn't change: a task that runs again gives the same rows.
    """

    def __init__(self, source: BlockSource, parts: int, with_data: bool):
        self.source, self.parts, self.with_data = source, parts, with_data

    def partitions(self) -> list[InputPartition]:
        # Of an empty device there is one range as well: without any, Spark reads one that isn't given.
        blocks = max(1, -(-self.source.size() // self.source.block_size))
        step = max(1, -(-blocks // self.parts))
        return [InputPartition((i, min(i + step, blocks))) for i in range(0, blocks, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for ref in self.source.list_blocks(*partition.value):
            data = self.source.read_block(ref)
            row = (ref.index, hashlib.sha256(data).hexdigest(), len(data))
            yield (*row, data) if self.with_data else row


def table(spark: SparkSession, source: BlockSource, parts: int = 0, with_data: bool = False) -> DataFrame:
    """The written blocks of a device: block_index, blob_id, length, and data if asked for.

    ``source`` goes to the tasks, so its service must be one that can be pickled. There are
    ``parts`` ranges, or four to a core. Nothing is held but a page of the listing and a block.
    """
    ship(spark)
    ranges = parts or 4 * spark.sparkContext.defaultParallelism
    short = f"cairn-device-{uuid.uuid4().hex}"

    class Device(DataSource):
        @classmethod
        def name(cls) -> str:
            return short

        def schema(self) -> str:
            return DEVICE + (", data binary" if with_data else "")

        def reader(self, schema) -> BlockReader:
            return BlockReader(source, ranges, with_data)

    spark.dataSource.register(Device)
    return spark.read.format(short).load()


@dataclass
class FakeService:
    """Sparse devices in memory: snapshots of {index: bytes}; ``faults`` are raised by the next calls."""

    snapshots: dict[str, dict[int, bytes]]
    volume_gib: int = 8
    page: int = 2
    lifetime: float | None = 3600
    empty_pages: int = 0
    corrupt: set[int] = field(default_factory=set)
    faults: list[Exception] = field(default_factory=list)
    now: float = 0.0

    def _call(self) -> None:
        if self.faults:
            raise self.faults.pop(0)

    def _paged(self, rows: list[dict], token: str | None) -> dict:
        start, empties = (int(x) for x in (token or "0/0").split("/"))
        if empties < self.empty_pages:
            return {"blocks": [], "next": f"{start}/{empties + 1}", "volume_gib": self.volume_gib}
        end = start + self.page
        return {"blocks": rows[start:end], "next": f"{end}/0" if end < len(rows) else None, "volume_gib": self.volume_gib}

    def _expiry(self) -> float | None:
        return None if self.lifetime is None else self.now + self.lifetime

    def list_blocks(self, snapshot: str, token: str | None, page: int, first: int = 0) -> dict:
        self._call()
        return self._paged([{"index": i, "token": f"{snapshot}:{i}", "expiry": self._expiry()} for i in sorted(self.snapshots[snapshot]) if i >= first], token)

    def list_changed(self, first: str, second: str, token: str | None, page: int) -> dict:
        self._call()
        a, b = self.snapshots[first], self.snapshots[second]
        rows = [{"index": i, "first": f"{first}:{i}" if i in a else None, "second": f"{second}:{i}", "expiry": self._expiry()} for i in sorted(b) if a.get(i) != b[i]]
        return self._paged(rows, token)

    def read_block(self, snapshot: str, index: int, token: str) -> dict:
        self._call()
        if token != f"{snapshot}:{index}":
            raise CairnError(Kind.INVALID, "read block", "wrong token")
        data = self.snapshots[snapshot][index]
        stated = base64.b64encode(hashlib.sha256(data).digest()).decode()
        return {"data": data[:-1] + b"!" if index in self.corrupt else data, "length": len(data), "checksum": stated, "algorithm": "SHA256"}


@dataclass
class PatternService:
    """A device whose blocks follow from their index: ``blocks`` of them, but every ``hole``-th; needs no memory."""

    blocks: int
    hole: int = 3

    def list_blocks(self, snapshot: str, token: str | None, page: int, first: int = 0) -> dict:
        start = int(token) if token else first
        end = min(start + page, self.blocks)
        rows = [{"index": i, "token": f"{snapshot}:{i}"} for i in range(start, end) if i % self.hole]
        gib = -(-self.blocks * BLOCK_SIZE // volume_size(1))
        return {"blocks": rows, "next": str(end) if end < self.blocks else None, "volume_gib": gib}

    def read_block(self, snapshot: str, index: int, token: str) -> dict:
        data = f"{snapshot} {index}".encode()
        return {"data": data, "length": len(data), "checksum": base64.b64encode(hashlib.sha256(data).digest()).decode()}
