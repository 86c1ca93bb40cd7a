"""Writers: versioned tables, the event log, reports and artifacts."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class VersionedTable:
    """A table as numbered Parquet folders; a reader sees the newest one that is complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        found = [s.getPath() for s in fs.listStatus(p)]
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(x.getName()[1:]) for x in found if x.getName().startswith("v") and fs.exists(new(x, "_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}")

    def write(self, df: DataFrame) -> int:
        """The next version; what it is made from stays readable meanwhile."""
        n = max(self.versions(), default=-1) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{n}")
        return n

    def upsert(self, new: DataFrame, key: str | list[str]) -> int:
        if not self.versions():
            return self.write(new)
        old = self.read()
        return self.write(old.join(new, key, "left_anti").unionByName(new.select(*old.columns)))

    def clear(self, confirm: bool = False) -> int:
        if not confirm:
            raise ValueError("not confirmed")
        return self.write(self.read().limit(0))


def append_event(spark: SparkSession, path: str, event: str, metadata: dict) -> None:
    row = spark.createDataFrame([(event, json.dumps(metadata, sort_keys=True))], "event string, metadata string")
    row.select(F.current_timestamp().alias("timestamp"), "event", "metadata").write.mode("append").parquet(path)


def newest_entries(entries: DataFrame, key: str, seq: str) -> DataFrame:
    """Of entries with one key the last."""
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("_n = 1").drop("_n")


def write_report(report: dict, path: str) -> None:
    """Keys sorted, whole or not at all."""
    with open(f"{path}.tmp", "w") as out:
        json.dump(report, out, sort_keys=True, indent=1)
    os.replace(f"{path}.tmp", path)


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """stem, kind, text: a folder for each kind."""
    artifacts.write.mode("overwrite").partitionBy("kind").parquet(path)


def contents_and_aliases(picked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hash, source) of each content's first source, and the other sources as (alias, source)."""
    w = Window.partitionBy("hash").orderBy("source")
    ranked = picked.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first("source").over(w))
    return ranked.where("_n = 1").select("hash", "source"), ranked.where("_n > 1").select(F.col("source").alias("alias"), F.col("_first").alias("source"))
