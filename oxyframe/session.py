"""Making the package importable on the executors, and keeping state in shared storage."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the Python workers, once an application.

    Not needed where PYTHONPATH names its parent folder or it is installed there.
    """
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    listed = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _shipped or str(root.parent) in listed or not root.is_dir():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="oxyframe-"), "oxyframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a local one only where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "oxyframe-checkpoints")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_folders: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A new folder's name in the shared one; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/oxyframe-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_sweep)
    _folders.append((spark, path))
    return path


def _sweep() -> None:
    for spark, path in _folders:
        with contextlib.suppress(Exception):  # the session may have ended
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
