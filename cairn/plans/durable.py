"""Cutting lineage in storage that every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests,
    a laptop) a temporary folder of this process is made and named there.
    """
    global _own_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{_own_root}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    What follows starts from files, so a lost executor costs only its running tasks,
    rows keep one identity however often they are read, and plans stay short. The
    folder is the cluster's to purge; ``discard`` removes a table that no plan needs.
    """
    path = f"{shared_root(df.sparkSession)}/cairn-tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._cairn_path = path
    return back


def write_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file into the shared folder, by whatever file system it is on; its path."""
    jvm, path = spark._jvm, f"{shared_root(spark)}/cairn-files/{name}"
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(data), 0, len(data))
    finally:
        out.close()
    return path


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``durable``."""
    for df in tables:
        path = getattr(df, "_cairn_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Columns of ``df`` under new names, found by place.

    ``pick(df, _id="doc_id")`` works beside columns that differ only in case, hold dots,
    or have names that the caller uses itself; an exact match goes before another case.
    """
    from pyspark.sql import functions as F

    by_place = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = []
    for new, old in names.items():
        same = [i for i, c in enumerate(df.columns) if c == old]
        same = same or [i for i, c in enumerate(df.columns) if c.lower() == old.lower()]
        if not same:
            raise ValueError(f"no column {old!r} among {df.columns}")
        out.append(F.col(f"c{same[0]}").alias(new))
    return by_place.select(*out)
