"""Written tables that cut lineage, in the folder that executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_CLEANED: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, removed when the driver ends; where that is unset, a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="skein-"))
    path = f"{base.rstrip('/')}/skein-{spark.sparkContext.applicationId}"
    if path not in _CLEANED:
        _CLEANED.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone by then; the folder is scratch space
        pass


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
