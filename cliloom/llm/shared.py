"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset and Spark runs on this machine alone (as in tests), a new
    temporary folder; on a cluster that is an error, as executors share no local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.__dict__.get("_cliloom_folder")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that driver and executors share")
        folder = spark.sparkContext._cliloom_folder = "file://" + tempfile.mkdtemp(prefix="cliloom-")
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_cliloom_tables", []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes what this application has written there, once its results are safe; how many tables that were."""
    paths = spark.sparkContext.__dict__.pop("_cliloom_tables", [])
    for path in paths:
        delete(spark, path)
    return len(paths)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(table: DataFrame) -> None:
    """Deletes a table of `written` that nothing reads any more."""
    tables = table.sparkSession.sparkContext.__dict__.get("_cliloom_tables", [])
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        own = [t for t in tables if t.rsplit("/", 1)[1] == path.rsplit("/", 1)[1]]
        for t in own:
            delete(table.sparkSession, t)
            tables.remove(t)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written as Parquet into the shared folder and read from there: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_columns(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """The rows with columns named c0, c1 and so on, whatever their names were, and the new names of those wanted."""
    names = df.columns
    return df.toDF(*(f"c{i}" for i in range(len(names)))), [f"c{names.index(w)}" for w in wanted]


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many more underscores before it as keep it apart from those taken."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        out.append(name)
    return out
