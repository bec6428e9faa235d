"""A repository: packs, index and manifests of backed-up trees in an object store.

A run lists the tree, chunks it in Spark tasks, keeps the chunks that no pack holds, folds
them into packs and has tasks write the pack files; the manifest comes last, by conditional
creation, and makes the run visible. The index is an object that can always be rebuilt from
the packs' headers, and entries count only for packs that exist, so a run that died leaves
packs that a later one adopts or a collection removes.

The driver holds names and sizes of packs. Files, blobs and index entries stay in tables: the tree is
listed, the index read and written, and manifests are read in tasks. Only a manifest's text passes
through the driver when it is written, part by part, since its id is one hash of it all.
"""

from __future__ import annotations

import functools
import json
import os
import socket
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairn.errors import CairnError, Kind
from cairn.operators import dedup, index, packs, snapshots
from cairn.operators.chunking import ChunkerConfig, cdc_chunks
from cairn.plans.durable import discard, durable
from cairn.sources import files
from cairn.sources.stores import HIDDEN, LocalStore, Store

CONFIG, INDEX, SNAPSHOTS, PACKS = "config", "index/index", "snapshots/", "packs/"
VERSION = 1


def now() -> str:
    return datetime.now(timezone.utc).isoformat().replace("+00:00", "Z")


@dataclass(frozen=True)
class Config:
    format_version: int = VERSION
    created_at: str = ""
    chunker_min_size: int = ChunkerConfig.min_size
    chunker_avg_size: int = ChunkerConfig.avg_size
    chunker_max_size: int = ChunkerConfig.max_size
    chunker_normalization: int = ChunkerConfig.normalization
    pack_target_size: int = packs.TARGET

    def validate(self) -> Config:
        if self.format_version != VERSION:
            raise CairnError(Kind.UNSUPPORTED, "config", f"format version {self.format_version}")
        try:
            self.chunker()
        except CairnError as e:
            raise CairnError(Kind.CORRUPT, "config", e) from e
        if self.pack_target_size <= 0:
            raise CairnError(Kind.CORRUPT, "config", "pack target of no size")
        return self

    def chunker(self) -> ChunkerConfig:
        return ChunkerConfig(self.chunker_min_size, self.chunker_avg_size, self.chunker_max_size, self.chunker_normalization)


def pack_key(pack_id: str) -> str:
    return f"{PACKS}{pack_id[:2]}/{pack_id}"


def is_id(text: str) -> bool:
    return len(text) == 64 and all(c in "0123456789abcdefABCDEF" for c in text)


class Fetched(Sequence):
    """A list whose members come from where they are kept whenever it is looked into."""

    def __init__(self, fetch: Callable[[], Iterable], size: int | None = None):
        self.fetch, self.size = fetch, size

    def __iter__(self) -> Iterator:
        return iter(self.fetch())

    def __len__(self) -> int:
        if self.size is None:
            self.size = sum(1 for _ in self)
        return self.size

    def __getitem__(self, i):
        return list(self)[i]

    def __eq__(self, other) -> bool:
        return isinstance(other, Sequence) and len(self) == len(other) and all(a == b for a, b in zip(self, other, strict=True))

    __hash__ = None


@dataclass
class Report:
    """What verification found; orphans never make it fail."""

    snapshots: int = 0
    packs: int = 0
    blobs_referenced: int = 0
    blobs_read: int = 0
    missing_packs: Sequence[str] = field(default_factory=list)
    dangling_blobs: Sequence[str] = field(default_factory=list)
    orphan_packs: Sequence[str] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not (self.problems or self.missing_packs or self.dangling_blobs)

    def summary(self) -> str:
        return (
            f"{'ok' if self.ok else 'FAILED'}: {self.snapshots} snapshots, {self.packs} packs, {self.blobs_referenced} blobs referenced, {self.blobs_read} read, "
            f"{len(self.missing_packs)} missing packs, {len(self.dangling_blobs)} dangling blobs, {len(self.orphan_packs)} orphan packs"
        )


class Repository:
    """Opened with ``create`` or ``open``; ``root`` is where tasks write packs, on a shared path.

    ``tables`` hold the index, each blob in one of them; ``close`` deletes them.
    """

    def __init__(self, spark: SparkSession, store: Store, config: Config):
        self.spark, self.store, self.config = spark, store, config
        self.tables: list[DataFrame] = []

    def close(self) -> None:
        discard(*self.tables)
        self.tables = []

    @classmethod
    def create(cls, spark: SparkSession, store: Store, config: Config | None = None) -> Repository:
        config = (config or Config(created_at=now())).validate()
        if not store.create(CONFIG, json.dumps(asdict(config), indent=2).encode()):
            raise CairnError(Kind.ALREADY_EXISTS, "init", "there is one already")
        return cls(spark, store, config)

    @classmethod
    def open(cls, spark: SparkSession, store: Store) -> Repository:
        try:
            data = store.get(CONFIG)
        except CairnError as e:
            if e.kind is Kind.NOT_FOUND:
                raise CairnError(Kind.NOT_FOUND, "open", "no configuration found") from e
            raise
        try:
            known = json.loads(data)
            config = Config(**{k: known[k] for k in Config.__dataclass_fields__ if k in known})
        except (ValueError, TypeError) as e:
            raise CairnError(Kind.CORRUPT, "open", e) from e
        out = cls(spark, store, config.validate())
        present = out.packs()
        try:
            stored = index.read(spark, out.path(INDEX)).join(present, "pack_id", "left_semi").select("blob_id", "pack_id", "offset", "length")
            out.tables = [durable(stored, "index")]
        except CairnError as e:
            if e.kind not in (Kind.NOT_FOUND, Kind.CORRUPT):
                raise
        out.adopt(present.join(out.index_table().select("pack_id").distinct(), "pack_id", "left_anti"))
        return out

    # Packs and index.

    def present_packs(self) -> tuple[list[tuple[str, int]], list[str]]:
        """(pack_id, size) of the packs in the store, and keys that name none."""
        good, stray = [], []
        for o in self.store.list(PACKS):
            name = o.key.rpartition("/")[2]
            (good if is_id(name) else stray).append((name, o.size) if is_id(name) else o.key)
        return good, stray

    def path(self, key: str) -> str:
        """Where tasks find an object."""
        if not isinstance(self.store, LocalStore):
            raise CairnError(Kind.UNSUPPORTED, "repository", "tasks read and write packs in a folder that they share")
        return str(self.store._path(key).absolute())

    def packs(self) -> DataFrame:
        """pack_id, size of the packs in the store."""
        import pyarrow as pa

        found = [(o.key.rpartition("/")[2], o.size) for o in self.store.list(PACKS) if is_id(o.key.rpartition("/")[2])]
        columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.int64()))]
        return self.spark.createDataFrame(pa.table(columns, names=["pack_id", "size"]))

    def headers(self, present: DataFrame) -> DataFrame:
        """The index entries that packs (pack_id, size) hold, by their headers."""
        root = self.path(CONFIG).removesuffix(CONFIG)

        def read(batches):
            import pyarrow as pa

            store = LocalStore(root)
            for batch in batches:
                for p, size in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                    found = packs.read_header(lambda o, n, p=p: store.get_range(pack_key(p), o, n), size)
                    cols = [[e["id"] for e in found], [p] * len(found), [e["offset"] for e in found], [e["length"] for e in found]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 2 + [pa.int64()] * 2, strict=True)], names=["blob_id", "pack_id", "offset", "length"])

        dealt = present.select("pack_id", "size").repartition(4 * self.spark.sparkContext.defaultParallelism)
        return dealt.mapInArrow(read, index.SCHEMA)

    def adopt(self, present: DataFrame) -> None:
        """Take packs into the index by their headers; the first to hold a blob keeps it."""
        if not present.isEmpty():
            self.tables.append(durable(index.insert(self.index_table(), self.headers(present)), "adopted"))

    def rebuild_index(self) -> None:
        self.close()
        self.adopt(self.packs())
        self.save_index()

    def save_index(self) -> None:
        self.path(INDEX)
        self.store.fill(INDEX, functools.partial(index.write, self.index_table()))

    def index_table(self) -> DataFrame:
        if len(self.tables) > 8:  # a plan of many runs would be long
            whole = durable(functools.reduce(DataFrame.unionAll, self.tables), "index")
            discard(*self.tables)
            self.tables = [whole]
        return functools.reduce(DataFrame.unionAll, self.tables) if self.tables else self.spark.createDataFrame([], index.SCHEMA)

    @property
    def entries(self) -> dict[str, tuple]:
        """All of the index on the driver, for repositories that fit there."""
        return {r.blob_id: tuple(r) for r in self.index_table().collect()}

    def blob(self, blob_id: str) -> bytes:
        import hashlib

        at = self.index_table().filter(F.col("blob_id") == blob_id).first()
        if at is None:
            raise CairnError(Kind.NOT_FOUND, "blob", blob_id[:12])
        _, p, o, n = at
        data = self.store.get_range(pack_key(p), o, n)
        if hashlib.sha256(data).hexdigest() != blob_id:
            raise CairnError(Kind.CORRUPT, "blob", f"{blob_id[:12]} doesn't hash to its id")
        return data

    # Manifests.

    def save_snapshot(self, snapshot: dict, rows: DataFrame) -> dict:
        """Store a manifest of ``rows`` (path, size, mode, mod_time, chunks); it comes back with its id, and ``files`` that are fetched."""
        import hashlib

        self.path(SNAPSHOTS + "x")
        bare, empty = snapshot | {"id": "", "files": []}, rows.isEmpty()
        snapshots.validate(bare)
        compact, indented = (((snapshots.canonical(bare, n), "") if empty else snapshots.around(bare, "files", n)) for n in (None, 2))
        now, id_ = hashlib.sha256(compact[0].encode()), ""

        def write(path: str) -> None:
            nonlocal id_
            # The id stands before what it is the hash of: its place is filled in at the end.
            hole = "0" * 64
            begin = indented[0].replace('"id": ""', f'"id": "{hole}"', 1).encode()
            with open(path, "wb") as f:
                f.write(begin)
                if not empty:
                    for i, r in enumerate(snapshots.texts(snapshots.ordered(rows), 2).toLocalIterator(prefetchPartitions=True)):
                        now.update(((snapshots.between() if i else "") + r.compact).encode())
                        f.write(((snapshots.between(2) if i else "") + r.indented).encode())
                now.update(compact[1].encode())
                f.write(indented[1].encode())
                id_ = now.hexdigest()
                f.seek(begin.index(hole.encode()))
                f.write(id_.encode())

        spare = f"{SNAPSHOTS}{HIDDEN}{uuid.uuid4().hex}"  # named when its id is known
        self.store.fill(spare, write)
        try:
            self.store.fill(SNAPSHOTS + id_, lambda path: os.replace(self.path(spare), path), anew=True)
        finally:
            self.store.delete(spare)
        return bare | {"id": id_, "files": Fetched(lambda: self.load_snapshot(id_)["files"], snapshot["stats"]["files_total"])}

    def load_snapshot(self, snapshot_id: str) -> dict:
        try:
            s = json.loads(self.store.get(SNAPSHOTS + snapshot_id))
            s["files"] = s.get("files") or []
            for f in s["files"]:
                f["chunks"] = f["chunks"] or []
        except (ValueError, KeyError, TypeError) as e:
            raise CairnError(Kind.CORRUPT, "snapshot", e) from e
        snapshots.verify(s)
        snapshots.validate(s)
        return s

    def list_snapshots(self) -> list[dict]:
        """Each manifest by id, read and checked in tasks; ``files`` and ``blocks`` are fetched when they are looked into."""
        names = sorted(o.key.removeprefix(SNAPSHOTS) for o in self.store.list(SNAPSHOTS))
        paths = [(self.path(SNAPSHOTS + n),) for n in names]

        def check(row):
            try:
                return json.dumps(snapshots.head(row.file)), None, None
            except CairnError as e:
                return None, e.kind.value, str(e.cause)

        out = []
        if paths:
            d = self.spark.createDataFrame(paths, "file string").repartition(min(len(paths), 4 * self.spark.sparkContext.defaultParallelism))
            for doc, kind, why in d.rdd.map(check).collect():
                if doc is None:
                    raise CairnError(Kind(kind), "snapshot", why)
                out.append(json.loads(doc))
        lazy = lambda s, k: Fetched(lambda: self.load_snapshot(s["id"]).get(k) or [])
        return [s | {k: lazy(s, k) for k in ("files", "blocks")} for s in sorted(out, key=lambda s: s["id"])]

    def references(self, known: list[dict]) -> DataFrame:
        """snapshot, place, path, size, mode, mod_time, chunks of manifests that were listed."""
        paths = self.spark.createDataFrame([(self.path(SNAPSHOTS + s["id"]),) for s in known], "file string")
        return snapshots.rows(paths.repartition(max(1, min(len(known), 4 * self.spark.sparkContext.defaultParallelism))))

    def resolve(self, ref: str) -> dict:
        known = self.list_snapshots()
        if not known:
            raise CairnError(Kind.NOT_FOUND, "snapshots", "there are none")
        if ref == "latest":
            best = max(s["created_at"] for s in known)
            return next(s for s in known if s["created_at"] == best)
        found = [s for s in known if s["id"] == ref or (len(ref) >= 8 and s["id"].startswith(ref))]
        if len(found) != 1:
            raise CairnError(Kind.NOT_FOUND if not found else Kind.INVALID, "snapshots", f"{ref!r} matches {len(found)}")
        return found[0]

    # Runs.

    def backup(self, source: str, dry_run: bool = False, max_bytes: int = 0, skip_unreadable: bool = False, hostname: str | None = None, progress: Callable[[dict], None] | None = None, pack_tasks: int = 0) -> dict:
        """Store a tree; the snapshot, with an empty id after a dry run.

        ``pack_tasks`` bounds the tasks that write packs. ``progress`` is told what tasks observed as they read (files, bytes, chunks), and
        then what of it was new.
        """
        began = time.monotonic_ns()
        listed = files.entries(self.spark, source, skip_unreadable)
        dedup.check_byte_cap(listed, max_bytes)
        tree = files.read(self.spark, source, skip_unreadable, listed=listed)
        # Chunked once: ids and bytes are written, so that what is hashed is what is packed.
        seen, cut = Observation(), Observation()
        tree = tree.observe(seen, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        parts = cdc_chunks(tree, self.config.chunker(), with_data=True).observe(cut, F.count(F.lit(1)).alias("chunks"))
        chunks = durable(parts, "chunks")
        ids = chunks.drop("data")
        if progress:
            progress(dict(seen.get) | dict(cut.get))
        stats = dedup.run_stats(ids, self.index_table(), listed).first().asDict()
        if progress:
            progress({k: stats[k] for k in ("blobs_new", "blobs_deduped")})
        fresh = dedup.new_blobs(ids, self.index_table())
        # As many lanes as their packs stay mostly full: sixteen of one digit, and so on.
        lanes = next((d for d in (3, 2, 1) if stats["bytes_new"] >= 4 * 16**d * self.config.pack_target_size), 0)
        plan = durable(packs.assemble(fresh, self.config.pack_target_size, lane_digits=lanes), "plan")
        written = self._write_packs(plan, chunks, dry_run, pack_tasks)
        rows = durable(listed.join(snapshots.manifest(ids, listed).select("path", "chunks"), "path"), "manifest")
        discard(chunks, plan)
        keys = ("files_total", "bytes_total", "blobs_new", "blobs_deduped", "bytes_new", "bytes_deduped")
        numbers = {k: stats[k] for k in keys} | {"blocks_total": 0, "packs_written": written, "duration_ns": time.monotonic_ns() - began}
        snapshot = {"id": "", "kind": "files", "created_at": now(), "source": os.path.abspath(source), "hostname": hostname or socket.gethostname(), "stats": numbers}
        if dry_run:
            return snapshot | {"files": Fetched(lambda: (r.asDict() for r in snapshots.ordered(rows).toLocalIterator()), stats["files_total"])}
        self.save_index()
        saved = self.save_snapshot(snapshot, rows)
        discard(rows)
        return saved

    def estimate(self, source: str, skip_unreadable: bool = False) -> dict:
        """Files, bytes and requests of a backup, from the listing alone."""
        return dedup.estimate(files.entries(self.spark, source, skip_unreadable), self.config.pack_target_size).first().asDict()

    def _write_packs(self, plan: DataFrame, chunks: DataFrame, dry_run: bool, tasks: int = 0) -> int:
        """Have the packs written, one group of rows to a pack; the number of packs."""
        if dry_run:
            return packs.pack_rows(plan).count()
        # Only the data of new blobs is moved, one copy of each from every task.
        data = chunks.select("blob_id", "data").join(plan.select("blob_id"), "blob_id", "left_semi").dropDuplicates(["blob_id"])
        root = str(self.store.root) if isinstance(self.store, LocalStore) else None
        fsync = getattr(self.store, "fsync", True)

        def write(table):
            import pyarrow as pa

            rows = sorted(zip(table["seq"].to_pylist(), table["blob_id"].to_pylist(), table["data"].to_pylist(), strict=True))
            pack_id, body, entries = packs.encode([(b, d) for _, b, d in rows])
            # Named by its content: a task that runs again writes the same object.
            LocalStore(root, fsync).create(pack_key(pack_id), body)
            return pa.table({"blob_id": [e["id"] for e in entries], "pack_id": [pack_id] * len(entries), "offset": [e["offset"] for e in entries], "length": [e["length"] for e in entries]}, schema=pa.schema([("blob_id", pa.string()), ("pack_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

        if root is None:
            raise CairnError(Kind.UNSUPPORTED, "backup", "tasks write packs to a folder that they share")
        rows = plan.select("lane", "pack", "seq", "blob_id").join(data, "blob_id")
        rows = rows.repartition(tasks, "lane", "pack") if tasks > 0 else rows
        done = durable(rows.groupBy("lane", "pack").applyInArrow(write, index.SCHEMA), "written")
        written = done.agg(F.count_distinct("pack_id")).first()[0]
        if written:
            self.tables.append(done)
        return written

    def restore(self, ref: str, target: str, overwrite: bool = False) -> dict:
        """Write a snapshot's files below ``target``, each checked against its ids and size."""
        snapshot = self.resolve(ref)
        if snapshot["kind"] != "files":
            raise CairnError(Kind.UNSUPPORTED, "restore", "a blocks snapshot has no files")
        base = Path(target).resolve()
        rows = durable(self.references([snapshot]), "files")
        parts = F.split("path", "/")
        bad = rows.filter((F.length("path") == 0) | F.startswith("path", F.lit("/")) | F.contains("path", F.lit("\0")) | F.array_contains(parts, "..")).first()
        if bad:
            raise CairnError(Kind.INVALID, "restore", bad.path)
        # A file's blobs with their locations are gathered, in order; all are known before a byte is written.
        refs = rows.select("place", F.posexplode("chunks").alias("idx", "blob_id"))
        at = F.struct("idx", "blob_id", "pack_id", "offset", "length")
        found = refs.join(self.index_table(), "blob_id", "left").groupBy("place").agg(F.sort_array(F.collect_list(at)).alias("parts"))
        work = durable(rows.drop("chunks", "snapshot").join(found, "place", "left"), "work")
        lost = work.select(F.explode("parts").alias("p")).filter("p.pack_id IS NULL").agg(F.count_distinct("p.blob_id")).first()[0]
        if lost:
            raise CairnError(Kind.NOT_FOUND, "restore", f"{lost} blobs are not in the index")
        root = str(self.store.root)
        base.mkdir(parents=True, exist_ok=True)
        where = str(base)

        def put(row):
            return 1, write_file(LocalStore(root), where, row, overwrite)

        count, total = work.rdd.map(put).fold((0, 0), lambda a, b: (a[0] + b[0], a[1] + b[1]))
        discard(rows, work)
        return {"files": count, "bytes": int(total), "snapshot": snapshot["id"]}

    def verify(self, full: bool = False) -> Report:
        """Look for references without blobs, blobs without packs and packs without references."""
        return self._inspect(full)[0]

    def _inspect(self, full: bool = False) -> tuple[Report, DataFrame]:
        """The report, and pack_id, size of the packs that nothing references."""
        stray = [o.key for o in self.store.list(PACKS) if not is_id(o.key.rpartition("/")[2])]
        present = self.packs()
        report = Report(packs=present.count(), problems=[f"{k} is not a pack" for k in sorted(stray)])
        known = self.list_snapshots()
        report.snapshots = len(known)
        if not known:
            report.orphan_packs = self._fetched(present.select("pack_id"))
            return report, present
        referenced = self.references(known).select(F.explode("chunks").alias("blob_id")).distinct()
        at = durable(referenced.join(self.index_table(), "blob_id", "left"), "located")
        other = at.filter("pack_id IS NULL").select("blob_id")
        if not other.isEmpty():  # what the index object says, packs that are gone included
            try:
                other = other.join(index.read(self.spark, self.path(INDEX)), "blob_id", "left")
                first = at
                at = durable(first.filter("pack_id IS NOT NULL").unionByName(other), "located")
                discard(first)
            except CairnError as e:
                if e.kind not in (Kind.NOT_FOUND, Kind.CORRUPT):
                    raise
        report.blobs_referenced = at.count()
        used = at.filter("pack_id IS NOT NULL").select("pack_id").distinct()
        report.dangling_blobs = self._fetched(at.filter("pack_id IS NULL").select("blob_id"))
        report.missing_packs = self._fetched(used.join(present, "pack_id", "left_anti"))
        orphans = present.join(used, "pack_id", "left_anti")
        orphans = self.spark.createDataFrame(orphans.toArrow())  # no longer read from what goes
        report.orphan_packs = self._fetched(orphans.select("pack_id"))
        if full:
            read = durable(self._read_blobs(at.join(present, "pack_id", "left_semi").select("blob_id", "pack_id", "offset", "length")), "read")
            report.blobs_read = read.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            report.problems += [r.problem for r in read.filter("problem IS NOT NULL").collect()]
            discard(read)
        if not report.dangling_blobs and not report.missing_packs:
            discard(at)  # else the report fetches from it
        return report, orphans

    @staticmethod
    def _fetched(names: DataFrame) -> Sequence[str]:
        n = names.count()
        return Fetched(lambda: (r[0] for r in names.orderBy(names.columns[0]).toLocalIterator()), n) if n else []

    def _read_blobs(self, at: DataFrame) -> DataFrame:
        """n, problem: how many blobs were read and hashed to their ids, and a row for each that didn't."""
        root = str(self.store.root)

        def read(batches):
            import hashlib

            import pyarrow as pa

            store = LocalStore(root)
            for batch in batches:
                good, bad = 0, []
                for b, p, o, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    try:
                        if hashlib.sha256(store.get_range(pack_key(p), o, n)).hexdigest() != b:
                            raise CairnError(Kind.CORRUPT, "blob", f"{b[:12]} doesn't hash to its id")
                        good += 1
                    except CairnError as e:
                        bad.append(str(e))
                yield pa.RecordBatch.from_arrays([pa.array([good] + [0] * len(bad), pa.int64()), pa.array([None, *bad], pa.string())], names=["n", "problem"])

        # One pack's blobs lie in one task, in their order.
        return at.repartition("pack_id").sortWithinPartitions("pack_id", "offset").mapInArrow(read, "n long, problem string")

    def collect_garbage(self, dry_run: bool = False) -> dict:
        """Delete packs that nothing references; refused unless the repository verifies."""
        report, orphans = self._inspect()
        if not report.ok:
            raise CairnError(Kind.CORRUPT, "gc", report.summary())
        out = {"packs": len(report.orphan_packs), "bytes": orphans.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], "dry_run": dry_run}
        if not dry_run and report.orphan_packs:
            # The index goes first: were it to outlive the packs, a later run would trust it.
            self.store.delete(INDEX)
            for p in report.orphan_packs:
                self.store.delete(pack_key(p))
            self.rebuild_index()
        return out


def nanoseconds(rfc3339: str) -> int:
    """Since 1970, of a UTC time with up to nine decimals."""
    whole, _, part = rfc3339.removesuffix("Z").partition(".")
    seconds = int(datetime.fromisoformat(whole).replace(tzinfo=timezone.utc).timestamp())
    return seconds * 1_000_000_000 + int(part.ljust(9, "0")[:9] or 0)


def safe_path(path: str) -> bool:
    return bool(path) and not path.startswith("/") and "\0" not in path and ".." not in path.split("/")


def write_file(store: Store, base: str, row, overwrite: bool) -> int:
    """One file from its verified blobs; what was written goes again if anything fails."""
    import hashlib

    path = os.path.join(base, row.path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if overwrite and os.path.lexists(path):
        os.unlink(path)
    try:
        out = open(path, "xb")
    except FileExistsError as e:
        raise CairnError(Kind.ALREADY_EXISTS, "restore", row.path) from e
    try:
        with out:
            for p in row.parts or ():
                data = store.get_range(pack_key(p.pack_id), p.offset, p.length)
                if hashlib.sha256(data).hexdigest() != p.blob_id:
                    raise CairnError(Kind.CORRUPT, "restore", f"{row.path}: {p.blob_id[:12]}")
                out.write(data)
            size = out.tell()
        if size != row.size:
            raise CairnError(Kind.CORRUPT, "restore", f"{row.path}: {size} bytes, not {row.size}")
        os.chmod(path, row.mode & 0o7777)
        ns = nanoseconds(row.mod_time)
        os.utime(path, ns=(ns, ns))
    except BaseException:
        os.unlink(path)
        raise
    return size
