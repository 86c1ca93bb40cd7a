"""Readers: page files, lists, dumps, exports, logs and run summaries."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import strings as S

#: The byte sizes that part the buckets of files.
SIZE_BUCKETS = ((0, 1024), (1024, 2048), (2048, 4096), (4096, 8192), (8192, 16384), (16384, 1 << 62))


def gz_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source, path, length, sha: gzip files below folders, or files that must be gzip; content is read for the digest only."""
    for p in paths:
        if "." in p.rsplit("/", 1)[-1] and not p.endswith(".gz"):
            raise ValueError(f"no gzip file: {p}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(paths)
    return files.select(S.source_of_path("path").alias("source"), "path", "length", F.sha2("content", 256).alias("sha"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, bucket (low < length <= high; length 0 has none) without reading content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    bucket = F.lit(None).cast("string")
    for low, high in SIZE_BUCKETS:
        bucket = F.when((F.col("length") > low) & (F.col("length") <= high), F.lit(f"{low}-{high}")).otherwise(bucket)
    return files.withColumn("bucket", bucket)


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """source, text: whole gzip files as text; the codec is found by the name."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.gz")
    return df.select(S.source_of_path(F.input_file_name()).alias("source"), F.col("value").alias("text"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file but blank ones and comments, in-line ones too."""
    return spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("value")).where("value <> ''")


def expand_lists(spark: SparkSession, arguments: list[str]) -> list[str]:
    """Arguments with @file replaced by the lines of that list; lists name paths, so they are short."""
    return [x for a in arguments for x in ([r["value"] for r in listed(spark, a[1:]).collect()] if a.startswith("@") else [a])]


def dump_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    r"""Tab-separated, with quotes; \N is null."""
    return spark.read.schema(schema).option("sep", "\t").option("nullValue", "\\N").option("quote", '"').csv(path)


def dump_contents(spark: SparkSession, path: str) -> DataFrame:
    """Lines of three fields, only the first two tabs part them."""
    parts = F.split("value", "\t", 3)
    return spark.read.text(path).select(parts[0].alias("hash"), parts[1].alias("meta"), S.unescape_copy(parts[2]).alias("text"))


def export(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; a broken one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def log_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; broken ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def run_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """summary.json of all runs, the newest folder first; unreadable ones have nulls and are dropped."""
    df = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "summary.json").json(path)
    names = [f.name for f in df.schema if not isinstance(f.dataType, T.NullType)]
    return df.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/summary\.json$", 1)).dropna("all", subset=names).orderBy(F.desc("run"))


def roff_section(pages: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """key, text: the lines between a section's header and the next one."""
    from pyspark.sql import Window

    lines = pages.select(key, F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i")
    own = F.coalesce(S.is_header("line", name), F.lit(False))
    any_header = S.is_header("line")
    marked = lines.withColumn("_own", own).withColumn("_h", F.sum((any_header | own).cast("int")).over(w))
    first = marked.where("_own").groupBy(F.col(key).alias("_k")).agg(F.min("_h").alias("_s"))
    body = marked.join(first, (F.col(key) == F.col("_k")) & (F.col("_h") == F.col("_s"))).where("not _own")
    return body.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))


def basenames(pages: DataFrame) -> DataFrame:
    return pages.select(F.regexp_replace(S.basename("source"), r"\.gz$", "").alias("name")).distinct()


def rendered(pages: DataFrame, render: Callable[[str], str]) -> DataFrame:
    """source, text, error: pages (source, text) by a renderer, which may raise; an empty result is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, text in zip(batch["source"], batch["text"], strict=True):
                try:
                    out = render(text)
                    rows.append((source, out, None) if out.strip() else (source, None, "render_failed: empty"))
                except Exception as e:  # noqa: BLE001  an outcome, not the end of the job
                    rows.append((source, None, f"render_failed: {e}"))
            yield pd.DataFrame(rows, columns=["source", "text", "error"])

    return pages.select("source", "text").mapInPandas(run, "source string, text string, error string")


def program_renderer(*command: str, seconds: int = 60) -> Callable[[str], str]:
    """A renderer that pipes a page through a program."""

    def render(text: str) -> str:
        return subprocess.run(command, input=text, capture_output=True, text=True, timeout=seconds, check=True).stdout

    return render
