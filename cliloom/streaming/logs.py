"""Log reports as streams; on bounded input they give what the batch reports give."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def read_log(spark: SparkSession, path: str, schema, files_each: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def minute_bursts(log: DataFrame, t: str = "ts", late: str = "25 minutes") -> DataFrame:
    """minute, ip, hits: tumbling minutes, kept open for late rows; in append mode the last ones stay open, so a finite log takes update mode."""
    return log.withWatermark(t, late).groupBy(F.window(t, "1 minute").alias("w"), "ip").agg(F.count("*").alias("hits")).select(F.col("w.start").alias("minute"), "ip", "hits")


def sessions(log: DataFrame, t: str = "ts", gap: str = "10 minutes", late: str = "25 minutes") -> DataFrame:
    return log.withWatermark(t, late).groupBy(F.session_window(t, gap).alias("w"), "ip").agg(F.count("*").alias("hits")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ip", "hits")


def without_overlap(log: DataFrame, key: str, t: str = "ts", late: str = "25 minutes") -> DataFrame:
    """Rows that the hot tier and the archive both hold, once."""
    return log.withWatermark(t, late).dropDuplicatesWithinWatermark([key])


def running_bursts(log: DataFrame, threshold: int, t: str = "ts") -> DataFrame:
    """ip, hits, at: whenever an address passes another multiple of the threshold; keeps one number for each address."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for batch in batches:
            for at in sorted(batch[t]):
                n += 1
                if n % threshold == 0:
                    out.append((key[0], n, at))
        state.update((n,))
        yield pd.DataFrame(out, columns=["ip", "hits", "at"])

    return log.groupBy("ip").applyInPandasWithState(step, "ip string, hits long, at timestamp", "n long", "append", GroupStateTimeout.NoTimeout)


def append_events(events: DataFrame, path: str, checkpoint: str):
    """The event log as an append-only table; runs over what is there and ends."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batches(events: DataFrame, path: str, keys: list[str], checkpoint: str, order: str | None = None):
    """Adds each micro-batch's rows, the last of each key by `order`, in a folder of their own; `upserted` reads the table.

    A batch that runs again replaces its own folder. Rows alike in `order` are told apart by their other columns.
    Without `order` a key has one row in a batch, as in an aggregate, whose changed rows come in update mode.
    """

    def put(batch: DataFrame, n: int) -> None:
        if order is not None:
            rest = [c for c in batch.columns if c not in keys and c != order]
            batch = batch.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_last")).select(*keys, "_last.*")
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return events.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The newest row of each key."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    rest = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_new")).select(*keys, "_new.*").select(*schema.names)
