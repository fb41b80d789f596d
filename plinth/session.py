"""Session helpers shared by every part of the library."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = named or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, one for each call."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; its lineage ends there, so lost executors cost no recomputation."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df``, marked for broadcast only if its rows, counted here, are few; meant for written tables of a few numbers a row."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def prepare(spark: SparkSession) -> None:
    """What every query needs: our modules on the executors, and Arrow batches small enough for long texts."""
    # in place of the defaults only; sizes of the user's own stay
    for key, default, ours in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "4194304")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", ours)
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, as ``--py-files`` would; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    folder = tempfile.mkdtemp(prefix="spark-")
    path = os.path.join(folder, f"{top.name}_modules.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
