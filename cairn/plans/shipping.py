"""Sending this package to the executors with the job that needs it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession, *files: Path) -> None:
    """Give every executor the package and ``files``, once for each application.

    Spark's own file server carries the archive, so nothing need be installed or shared.
    """
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="cairn-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "cairn-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
        for f in files:
            z.write(f, f.name)
    sc.addPyFile(str(archive))
