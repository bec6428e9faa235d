"""Registered queries that run the repository, the file source and an object store as users do.

The documents are files of a tree, ``lang/source/doc_id.txt``, that tasks write into the shared
folder; a null text is an empty file, and a null language or source the folder ``none``. What a
run gives is written before its folders go. The shared folder must be a path of a file system;
``tree_files`` and ``store_objects`` list their files on the driver.
"""

from __future__ import annotations

import shutil
import uuid
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.errors import CairnError, Kind
from cairn.functions import scalars as S
from cairn.operators.chunking import SMALL
from cairn.plans.durable import durable, shared_root
from cairn.repository import Config, Repository
from cairn.sources import files
from cairn.sources.stores import LocalStore, PrefixStore

CONFIG = Config(chunker_min_size=SMALL.min_size, chunker_avg_size=SMALL.avg_size, chunker_max_size=SMALL.max_size, chunker_normalization=SMALL.normalization, pack_target_size=65_536)


class Folder:
    """A folder of one run in the shared one; it goes when the run is over."""

    def __init__(self, spark: SparkSession):
        at = urlparse(shared_root(spark))
        if at.scheme not in ("", "file"):
            raise CairnError(Kind.UNSUPPORTED, "run", f"files in {at.scheme}")
        self.path = Path(at.path) / "cairn-runs" / uuid.uuid4().hex

    def __enter__(self) -> Path:
        self.path.mkdir(parents=True)
        return self.path

    def __exit__(self, *_) -> None:
        shutil.rmtree(self.path, ignore_errors=True)


def _named(spark: SparkSession, d: str) -> DataFrame:
    """path, content of the documents' files."""
    folder = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("none"))
    path = F.concat(folder("lang"), F.lit("/"), folder("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def _each(df: DataFrame, do, schema: str) -> DataFrame:
    """``do`` of each row's values, in tasks; it gives a row."""

    def run(batches):
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = [dict(zip(names, do(*r.values()), strict=True)) for r in batch.slice(i, 64).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    return df.mapInArrow(run, schema)


def _fill(spark: SparkSession, d: str, root: Path) -> str:
    """Write the tree. A task that runs again writes the same files."""
    base = str(root)

    def put(path, content):
        to = Path(base, path)
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_bytes(content)
        return (len(content),)

    root.mkdir()
    _each(_named(spark, d), put, "size long").agg(F.sum("size")).collect()
    return base


def tree_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file of the tree as it is read: its path, size and address, and its place in the walk."""
    with Folder(spark) as folder:
        base = _fill(spark, d, folder / "src")
        placed = [(row[0], i) for i, row in enumerate(files.walk(Path(base)))]
        at = spark.createDataFrame(placed, "path string, place long")
        read = files.read(spark, base).select("path", "size", S.content_id(F.col("content")).alias("content_id"))
        return durable(read.join(at, "path"), "tree")


def backup_restore(spark: SparkSession, d: str) -> DataFrame:
    """Files that came back from a repository: backed up, verified blob by blob, restored and read again."""
    with Folder(spark) as folder:
        base = _fill(spark, d, folder / "src")
        first = Repository.create(spark, LocalStore(folder / "repo", fsync=False), CONFIG)
        first.backup(base)
        first.close()
        repo = Repository.open(spark, LocalStore(folder / "repo", fsync=False))
        whole = repo.verify(full=True).ok
        repo.restore("latest", str(folder / "out"))
        repo.close()
        back = files.read(spark, str(folder / "out"))
        return durable(back.select("path", "size", S.content_id(F.col("content")).alias("content_id"), F.lit(whole).alias("verified")), "restored")


def backup_stats(spark: SparkSession, d: str) -> DataFrame:
    """What two runs over the tree report: the first stores all that is distinct, the second nothing."""
    with Folder(spark) as folder:
        base = _fill(spark, d, folder / "src")
        repo = Repository.create(spark, LocalStore(folder / "repo", fsync=False), CONFIG)
        names = ["files_total", "bytes_total", "blobs_new", "blobs_deduped", "bytes_new", "bytes_deduped"]
        told = [repo.backup(base)["stats"] for _ in range(2)]
        repo.close()
    rows = [(run, *[stats[n] for n in names]) for run, stats in enumerate(told, 1)]
    return spark.createDataFrame(rows, "run long, " + ", ".join(f"{n} long" for n in names))


def garbage_collected(spark: SparkSession, d: str) -> DataFrame:
    """A repository whose only manifest is deleted: what is then verified, collected and left."""
    with Folder(spark) as folder:
        base = _fill(spark, d, folder / "src")
        repo = Repository.create(spark, LocalStore(folder / "repo", fsync=False), CONFIG)
        snapshot = repo.backup(base)
        held = repo.packs().agg(F.sum("size")).first()[0] or 0
        tried = repo.collect_garbage()
        repo.store.delete(f"snapshots/{snapshot['id']}")
        orphans = len(repo.verify().orphan_packs)
        gone = repo.collect_garbage()
        row = (tried["packs"], gone["packs"] == orphans == snapshot["stats"]["packs_written"], gone["bytes"] == held, repo.packs().count(), repo.index_table().count())
        repo.close()
    return spark.createDataFrame([row], "packs_freed_before long, all_packs_freed boolean, all_bytes_freed boolean, packs_left long, blobs_left long")


def store_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects put by tasks below a prefix, created again in vain, a third deleted, listed and read."""
    with Folder(spark) as folder:
        root = str(folder / "store")

        def store():
            return PrefixStore(LocalStore(root, fsync=False), "some/prefix")

        def put(path, content):
            store().put(path, content)
            return path, store().create(path, b"other")

        def get(path, *_):
            data = store().get(path)
            return path, store().stat(path).size, data, store().get_range(path, 10, 16)

        made = _each(_named(spark, d), put, "path string, again boolean")
        done = durable(made, "put")
        gone = done.filter(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long") % 3 == 0).select("path")
        _each(gone, lambda path: (store().delete(path) is None,), "done boolean").agg(F.count(F.lit(1))).collect()
        listed = spark.createDataFrame([(o.key, o.size) for o in store().list("")], "path string, listed long")
        # Tasks get as many parts as a listing of one thread would not.
        listed = listed.repartition(4 * spark.sparkContext.defaultParallelism, "path")
        read = _each(listed.select("path"), get, "path string, size long, content binary, part binary")
        read = read.join(listed, "path").join(done, "path")
        return durable(read.select("path", "size", "listed", S.content_id(F.col("content")).alias("content_id"), F.hex("part").alias("part"), F.col("again").alias("created_again")), "objects")


NAMES = ["tree_files", "backup_restore", "backup_stats", "garbage_collected", "store_objects"]


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}


def oracle_sql() -> dict[str, str]:
    from cairn.plans.oracles import cdc, stats

    tree = """t AS (SELECT coalesce(nullif(lang, ''), 'none') AS a, coalesce(nullif(source, ''), 'none') AS b, doc_id || '.txt' AS n, encode(coalesce(text, '')) AS c, doc_id FROM documents),
      f AS (SELECT a || '/' || b || '/' || n AS path, c, octet_length(c)::BIGINT AS size, sha256(c) AS content_id, a, b, n, doc_id FROM t)"""
    return {
        "tree_files": f"WITH {tree} SELECT path, size, content_id, row_number() OVER (ORDER BY a, b, n) - 1 AS place FROM f",
        "backup_restore": f"WITH {tree} SELECT path, size, content_id, true AS verified FROM f",
        "backup_stats": f"""WITH RECURSIVE {tree}, {cdc("q", "f")}, s AS ({stats("q")}), z AS (SELECT count(*) AS files_total, sum(size)::BIGINT AS bytes_total FROM f)
          SELECT 1 AS run, files_total, bytes_total, blobs_new, blobs_deduped, bytes_new, bytes_deduped FROM z, s
          UNION ALL SELECT 2, files_total, bytes_total, 0, chunks, 0, bytes_total FROM z, s""",
        "garbage_collected": "SELECT 0 AS packs_freed_before, true AS all_packs_freed, true AS all_bytes_freed, 0 AS packs_left, 0 AS blobs_left",
        "store_objects": f"WITH {tree} SELECT path, size, size AS listed, content_id, substr(hex(c), 21, 32) AS part, false AS created_again FROM f WHERE doc_id % 3 <> 0",
    }
