"""Stored tables: versions of a table that is upserted, appended tables, sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from skein.operators.state import upsert


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class VersionedTable:
    """A keyed table as a folder of versions.

    A write makes a new version and then names it in a pointer file, so readers
    see a whole version, and a write that fails leaves the old one. There must
    be one writer at a time. The version before the current one is kept for
    readers that have begun.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def _versions(self) -> list[str]:
        fs, p = _fs(self.spark, f"{self.path}/_current")
        if not fs.exists(p):
            return []
        return [r.value for r in self.spark.read.text(f"{self.path}/_current").orderBy("value").collect()]

    def current(self) -> str | None:
        found = self._versions()
        return found[-1].split(" ", 1)[1] if found else None

    def read(self) -> DataFrame:
        v = self.current()
        return self.spark.createDataFrame([], self.schema) if v is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/{v}")

    def write(self, rows: DataFrame) -> None:
        """Replace the table."""
        found = self._versions()
        number = int(found[-1].split(" ", 1)[0]) + 1 if found else 0
        name = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
        rows.select(*self.schema.names).write.parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(f"{number:08d} {name}",)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/_current")
        for old in found[:-1]:
            fs, p = _fs(self.spark, f"{self.path}/{old.split(' ', 1)[1]}")
            fs.delete(p, True)

    def upsert(self, rows: DataFrame, order: list | None = None, keep: list[str] | None = None) -> None:
        self.write(upsert(self.read(), rows, self.keys, order, keep))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def post(blocks: DataFrame, send: Callable[[list[dict]], str], dry_run: bool = False) -> list[str]:
    """Send a digest's blocks, a message a chunk, in order; a dry run sends nothing.

    A digest is bounded by its limit of events, so its blocks fit the driver.
    """
    if dry_run:
        return []
    out, rows = [], blocks.orderBy("pos").toLocalIterator()
    chunk, held = None, []
    for r in rows:
        if chunk is not None and r.chunk != chunk:
            out.append(send(held))
            held = []
        chunk = r.chunk
        held.append({"type": r.kind, "text": r.text})
    return out + [send(held)] if held else out


def lookup(keys: DataFrame, cache: DataFrame, key: str, schema: str) -> DataFrame:
    """Cached JSON values by key, parsed; null for what is missing or doesn't parse."""
    found = cache.dropDuplicates([key]).select(key, F.from_json("value", schema).alias("value"))
    return keys.join(found, key, "left")
