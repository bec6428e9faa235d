"""Every registered core query against SQL on the smallest tables."""

import json

import pytest

from cairn.plans import catalogue, runs
from tests.conftest import same_rows

QUERIES = catalogue.queries() | runs.queries()
ORACLES = catalogue.oracle_sql() | runs.oracle_sql()


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, data, duck):
    same_rows(QUERIES[name](spark, data), duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    row = e.entry(spark).first()
    assert row.chunks == row.blobs_new + row.blobs_deduped > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_imports_the_corpus_operators():
    from pathlib import Path

    import cairn

    root = Path(cairn.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "cairn.llm" not in f.read_text() and "corpus_pipeline" not in f.read_text(), f


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_operators(tmp_path, pipeline):
    """The rest imports and registers its queries when the corpus folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    import cairn

    root = Path(cairn.__file__).parents[1]
    shutil.copytree(root / "cairn", tmp_path / "cairn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if pipeline and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    ask = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    names, sql = json.loads(out.stdout.splitlines()[-1])
    assert names == sorted(QUERIES) and sql == sorted(ORACLES)


def test_restore_and_verify_read_packs(spark, data, monkeypatch):
    """Pack bytes that are damaged, or put right, show in what restore_files and verify_full give."""
    from pyspark.sql import functions as F

    fetch, broken = catalogue.restore.fetch, catalogue.verify.broken_blobs
    bad = lambda packs: packs.withColumn("content", F.translate(F.col("content").cast("string"), "e", "f").cast("binary"))
    monkeypatch.setattr(catalogue.restore, "fetch", lambda refs, ix, packs: fetch(refs, ix, bad(packs)))
    monkeypatch.setattr(catalogue.verify, "broken_blobs", lambda ix, packs, *a: broken(ix, bad(packs), *a))
    assert catalogue.restore_files(spark, data).filter("not ok").count() > 0
    langs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id path", "lang")
    assert catalogue.verify_full(spark, data).join(langs, "path").filter("lang <> 'fr'").count() > 0


def test_runs_leave_no_folders(spark, data):
    from pathlib import Path
    from urllib.parse import urlparse

    from cairn.plans.durable import shared_root

    runs.tree_files(spark, data)
    assert not list(Path(urlparse(shared_root(spark)).path, "cairn-runs").iterdir())


def test_runs_over_odd_rows(spark, tmp_path):
    """Null and empty texts are empty files, without language or source they lie in ``none``; no rows make no files."""
    rows = [(0, None, None, None), (1, "", "en", ""), (2, "é" * 5000, "", "s"), (3, "é" * 5000, "fr", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for n, part in enumerate((docs, docs.limit(0))):
        part.write.parquet(str(tmp_path / str(n) / "documents.parquet"))
        back = {r.path: r.size for r in runs.backup_restore(spark, str(tmp_path / str(n))).filter("verified").collect()}
        assert back == ({} if n else {"none/none/0.txt": 0, "en/none/1.txt": 0, "none/s/2.txt": 10_000, "fr/s/3.txt": 10_000})
        made = {r.path: r for r in runs.store_objects(spark, str(tmp_path / str(n))).collect()}
        assert set(made) == (set() if n else {"en/none/1.txt", "none/s/2.txt"})
