"""Sessions: a local one for tests and benchmarks, and the package for remote executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED = "spark.tributary.shipped"


def local(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that all results are defined under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per session, so that its functions can be unpickled there."""
    context = spark.sparkContext
    if spark.conf.get(_SHIPPED, None) == context.applicationId:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR")), "tributary.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "tributary")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(os.path.abspath(path))
    spark.conf.set(_SHIPPED, context.applicationId)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, of its own, in the folder that the driver and all executors share."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        top = context.getCheckpointDir()
    return f"{top.rstrip('/')}/tributary/{name}-{uuid.uuid4().hex}"
