"""Session helpers: a shared scratch folder and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_SHIPPED: set[str] = set()


def is_one_process(master: str) -> bool:
    """``local`` and ``local[...]``; ``local-cluster`` starts executors of its own."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only where none is set."""
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        _CHECKPOINT_KEY
    )
    if not configured:
        if not is_one_process(spark.sparkContext.master):
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        # Driver and executors are one process (tests, bench): a folder of its own will do.
        configured = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_CHECKPOINT_KEY, configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for a table this run writes and reads back."""
    return f"{shared_folder(spark).rstrip('/')}/railguard-{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from those files.

    Cuts the lineage, survives lost executors and keeps later scans columnar and pruned.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Clusters usually pass ``--py-files``; doing it here keeps queries usable from any
    working folder.
    """
    context = spark.sparkContext
    name = f"railguard-{context.applicationId}.zip"
    if name in _SHIPPED:
        return
    target = Path(tempfile.mkdtemp(prefix="spark-")) / name
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(name)
