"""Tables written to the shared folder of the cluster, to cut lineage and to reuse results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or the checkpoint folder of the context.

    Where none is set, a local session gets one of its own; on a cluster that is an error, since
    executors could not see it.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs a reread of the table, not a recomputation of the plan above it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tributary/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tributary_path = path
    return out


def keyed_by(df: DataFrame) -> str:
    """A name for a column of row keys that no column of ``df`` has."""
    return "_".join(["row", *df.columns])


def dropped(df: DataFrame | None) -> None:
    """Remove the files of a table made by :func:`written` that nothing reads any more."""
    path = getattr(df, "_tributary_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def swept(spark: SparkSession) -> None:
    """Let the shuffle files go of steps that are written and that nothing refers to any more.

    Spark removes them once the driver has collected its garbage, which may take it half an hour.
    """
    spark._jvm.System.gc()
