"""File trees as a table: path, size, mode, mod_time and, read by tasks, content."""

from __future__ import annotations

import functools
import itertools
import os
import stat
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.errors import CairnError, Kind, kind_of_os
from cairn.plans.durable import durable

ENTRY = "path string, size long, mode int, mod_time string"


def open_root(root: str) -> Path:
    path = Path(root)
    if not path.exists():
        raise CairnError(Kind.NOT_FOUND, "source", root)
    if not path.is_dir():
        raise CairnError(Kind.INVALID, "source", f"{root} is not a directory")
    return path.resolve()


def rfc3339(ns: int) -> str:
    """UTC with as many decimals of a nanosecond as there are."""
    seconds, rest = divmod(ns, 1_000_000_000)
    text = datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    part = f"{rest:09d}".rstrip("0")
    return f"{text}.{part}Z" if part else f"{text}Z"


def walk(root: Path, skip_unreadable: bool = False) -> Iterator[tuple[str, int, int, str]]:
    """Regular files depth first, each directory by name; links and devices are left out.

    What goes away meanwhile is skipped; what can't be read is too, if asked for.
    """

    def visit(prefix: str):
        for e in sorted(scan(root, prefix, skip_unreadable), key=lambda e: os.fsencode(e[0])):
            if e[4]:
                yield from visit(e[0] + "/")
            else:
                yield e[:4]

    yield from visit("")


def scan(root: str | Path, prefix: str, skip_unreadable: bool = False) -> Iterator[tuple[str, int, int, str, bool]]:
    """One directory's regular files and directories (the last field), as the system gives them."""
    try:
        found = os.scandir(os.path.join(root, prefix))
    except FileNotFoundError:
        return
    except PermissionError as e:
        if skip_unreadable:
            return
        raise CairnError(Kind.PERMISSION, "walk", e) from e
    with found:
        for e in found:
            name = f"{prefix}{e.name}"
            try:
                if e.is_dir(follow_symlinks=False):
                    yield name, 0, 0, "", True
                elif e.is_file(follow_symlinks=False):
                    if skip_unreadable and not os.access(e.path, os.R_OK):
                        continue
                    s = e.stat(follow_symlinks=False)
                    yield name, s.st_size, stat.S_IMODE(s.st_mode), rfc3339(s.st_mtime_ns), False
            except FileNotFoundError:
                continue
            except OSError as x:
                if not skip_unreadable:
                    raise CairnError(kind_of_os(x), "walk", x) from x


#: Names that a task lists before it hands on the directories that are left.
SPREE = 10_000


def entries(spark: SparkSession, root: str, skip_unreadable: bool = False) -> DataFrame:
    """The tree's files without their content, listed in tasks; the driver sees no name.

    A task that has listed ``SPREE`` names leaves its other directories to the next round, so
    there are a few rounds, and a small tree takes one. The root must be a path that executors
    can open. The table is written once: however often it is read, it is one listing.
    """
    base = str(open_root(root))

    def listed(batches):
        for batch in batches:
            for start in batch.column(0).to_pylist():
                todo, n = [start], 0
                while todo and n < SPREE:
                    found = scan(base, todo.pop(), skip_unreadable)
                    while rows := list(itertools.islice(found, 4096)):
                        n += len(rows)
                        todo += [r[0] + "/" for r in rows if r[4]]
                        yield _batch([r for r in rows if not r[4]])
                yield _batch([(folder, 0, 0, "", True) for folder in todo])

    todo, levels = spark.createDataFrame([("",)], "path string"), []
    while not todo.isEmpty():
        spread = todo.repartition(4 * spark.sparkContext.defaultParallelism) if levels else todo
        levels.append(durable(spread.mapInArrow(listed, f"{ENTRY}, folder boolean"), "listing"))
        todo = levels[-1].filter("folder").select("path")
    return functools.reduce(DataFrame.unionAll, levels).filter("NOT folder").drop("folder")


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = {"path": pa.string(), "size": pa.int64(), "mode": pa.int32(), "mod_time": pa.string(), "folder": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """path, content: Spark's reader of whole files, which executors run."""
    base = open_root(root)
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base.as_uri())
    plain = F.regexp_replace("path", "^file:/*", "/")
    return d.select(F.substring(plain, len(str(base)) + 2, 1 << 20).alias("path"), F.col("length").alias("size"), "content")


def read(spark: SparkSession, root: str, skip_unreadable: bool = False, partitions: int | None = None, listed: DataFrame | None = None) -> DataFrame:
    """path, size, mode, mod_time, content of every listed file.

    Tasks open the files that the listing (``listed``, or a new one) names below the root, so
    links stay out and names that Spark's reader hides come in; the root must be a path that
    executors can open.
    """
    base = open_root(root)
    listed = entries(spark, root, skip_unreadable) if listed is None else listed
    n = partitions or max(1, min(listed.count(), spark.sparkContext.defaultParallelism * 4))
    where = str(base)

    def load(batches):
        import pyarrow as pa

        for batch in batches:
            start, held, data = 0, 0, []
            for i, path in enumerate(batch.column(0).to_pylist()):
                full = os.path.realpath(os.path.join(where, path))
                if not full.startswith(where + os.sep):
                    raise CairnError(Kind.INVALID, "open", path)
                try:
                    with open(full, "rb") as f:
                        data.append(f.read())
                except OSError as e:
                    raise CairnError(kind_of_os(e), "open", e) from e
                held += len(data[-1])
                if held >= 4 << 20 or i + 1 == batch.num_rows:
                    row = batch.slice(start, len(data))
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array(data, pa.binary())], names=[*row.schema.names, "content"])
                    start, held, data = i + 1, 0, []

    return listed.repartition(n, "path").mapInArrow(load, f"{ENTRY}, content binary")
