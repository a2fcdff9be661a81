"""Written tables in the folder that the cluster shares, and the package on its workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
_lock = threading.Lock()


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A folder of this machine is made and set only where that is absent and the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="sievio-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = "file://" + own
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:
        root = ("file://" if root.startswith("/") else "file:") + root
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: evaluated once, so that ids made up for it stay, and without lineage."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Gives this package to the session's workers, once for an application, as a file that Spark distributes."""
    context = spark.sparkContext
    with _lock:
        if context.applicationId not in _shipped:
            folder = tempfile.mkdtemp(prefix="sievio-package-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            path = os.path.join(folder, f"{_PACKAGE.name}.zip")
            with zipfile.ZipFile(path, "w") as z:
                for file in sorted(_PACKAGE.rglob("*.py")):
                    z.write(file, file.relative_to(_PACKAGE.parent))
            context.addPyFile(path)
            _shipped.add(context.applicationId)
    return spark
