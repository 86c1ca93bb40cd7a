"""Extraction of options by a pluggable extractor: prepare, call, check, assemble."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S
from ..sources.folders import written
from . import options as P
from . import texts as T


class Provider(Protocol):
    """Answers one prompt: the reply and the tokens it used."""

    def call(self, prompt: str) -> tuple[str, int]: ...


class BatchProvider(Protocol):
    """Answers many prompts at its own pace."""

    def submit(self, prompts: dict[str, str]) -> str: ...

    def poll(self, batch: str) -> str: ...

    def collect(self, batch: str) -> dict[str, str]: ...

    def cancel(self, batch: str) -> None: ...


class RetryableError(Exception):
    """Worth another try."""


PROVIDERS: dict[str, Callable[[str], Provider]] = {}


def provider(name: str) -> Callable:
    def put(f: Callable[[str], Provider]) -> Callable[[str], Provider]:
        PROVIDERS[name] = f
        return f

    return put


def make_provider(model: str) -> Provider:
    """`name/model`, or a name alone."""
    name, _, rest = model.partition("/")
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name!r}")
    return PROVIDERS[name](rest)


@dataclass
class FlagReader:
    """A provider without a model behind it: lines that begin with a flag are options."""

    model: str = ""
    calls: list[str] = field(default_factory=list)

    def call(self, prompt: str) -> tuple[str, int]:
        self.calls.append(prompt)
        found = []
        for line in prompt.split("\n"):
            number, bar, text = line.partition("| ")
            words = text.replace(",", " ").split()
            if bar and number.strip().isdigit() and words and words[0].startswith("-"):
                flags = [w for w in words if w.startswith("-")]
                n = int(number)
                found.append({"short": [f for f in flags if not f.startswith("--")], "long": [f for f in flags if f.startswith("--")], "has_argument": "=" in text, "lines": [n, n]})
        return json.dumps({"options": found, "dashless_opts": False}), len(prompt) // 4


@provider("reader")
def _reader(model: str) -> Provider:
    return FlagReader(model)


def call_with_retry(p: Provider, prompt: str, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> tuple[str, int]:
    """Up to three tries, 1, 2 and 4 seconds apart."""
    for n in range(tries):
        try:
            return p.call(prompt)
        except RetryableError:
            if n + 1 == tries:
                raise
            wait(2.0**n)
    raise AssertionError


_REPLY = "source string, part int, parts int, reply string, tokens long, error string"


def ask(chunks: DataFrame, model: str) -> DataFrame:
    """chunks: source, part, parts, text.  A row for each with the reply or an error; a chunk that fails fails alone.

    Pages of more than `MOST_CHUNKS` parts aren't asked about.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = make_provider(model)
        for batch in batches:
            rows = []
            for source, part, parts, text in batch[["source", "part", "parts", "text"]].itertuples(index=False):
                if parts > T.MOST_CHUNKS:
                    rows.append((source, part, parts, None, 0, None))
                    continue
                try:
                    reply, tokens = call_with_retry(p, text)
                    rows.append((source, part, parts, reply, tokens, None))
                except Exception as e:  # noqa: BLE001  an outcome, not the end of the job
                    rows.append((source, part, parts, None, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source", "part", "parts", "reply", "tokens", "error"])

    return chunks.mapInPandas(run, _REPLY)


_SCHEMA = "struct<options:array<struct<short:array<string>,long:array<string>,has_argument:boolean,positional:string,lines:array<int>>>,dashless_opts:boolean,subcommands:array<string>>"


def _subcommands() -> Column:
    parts = F.sort_array(F.collect_list(F.struct("part", F.coalesce("_j.subcommands", F.array().cast("array<string>")).alias("s"))))
    return F.flatten(F.transform(parts, lambda x: x["s"]))


def assemble(replies: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, options).  pages: source, text.

    A page succeeds if it has no more than `MOST_CHUNKS` chunks, all were answered with JSON of the right form (fences and bad escapes are mended)
    and the spans are sane.  Chunks and tokens are kept on failed pages too.  `subcommands` are those of all chunks, in
    their order and without the page's name in front; `nested` says whether the synopsis names a command to run.
    """
    parsed = replies.withColumn("_j", F.from_json(S.repaired_json("reply"), _SCHEMA))
    bad = F.col("error").isNotNull() | F.col("_j.options").isNull()
    state = parsed.groupBy("source").agg(F.bool_or(bad).alias("_bad"), F.count("*").alias("_n"), F.max("parts").alias("_parts"), F.sum("tokens").alias("tokens"), F.coalesce(F.bool_or("_j.dashless_opts"), F.lit(False)).alias("dashless"), F.min("error").alias("error"), _subcommands().alias("subcommands"))
    each = parsed.where(~bad).select("source", "part", F.posexplode("_j.options").alias("i", "o"))
    each = each.select("source", (F.col("part") * 1_000_000 + F.col("i")).alias("idx"), F.col("o.short").alias("short"), F.col("o.long").alias("long"), F.coalesce("o.has_argument", F.lit(False)).alias("has_arg"), F.col("o.positional").alias("positional"), F.get("o.lines", F.lit(0)).alias("line_start"), F.get("o.lines", F.lit(1)).alias("line_end"))
    each = each.where(~P.malformed(each))
    lines = pages.select("source", F.split("text", "\n", -1).alias("_lines"))
    each = P.chunk_dedup(each, "source", "idx", F.col("line_end") - F.col("line_start"))
    each = each.join(lines, "source").withColumn("text", T.line_slice(F.col("_lines"), F.col("line_start"), F.col("line_end"))).drop("_lines").withColumn("prefix", F.lit(None).cast("string")).withColumn("nested", F.lit(False))
    sane = P.span_sanity(each, "source")
    heads = T.sections(pages, "source", "text").where(F.split_part("text", F.lit("\n"), F.lit(1)).rlike(r"^#+\s+SYNOPSIS\s*$"))
    nested = heads.groupBy("source").agg(F.bool_or(F.exists(F.split("text", "\n"), S.names_nested_command)).alias("nested"))
    out = state.join(sane, "source", "left").join(nested, "source", "left")
    reason = F.when(F.col("_parts") > T.MOST_CHUNKS, "too_many_chunks").when(F.col("_n") < F.col("_parts"), "missing_chunk").when(F.col("_bad"), "bad_reply").when(F.coalesce("failed", F.lit(False)), "line_span_coverage")
    outcomes = out.select("source", F.when(reason.isNull(), "success").otherwise("failed").alias("outcome"), reason.alias("reason"), "tokens", "dashless", "error", F.col("_parts").alias("chunks"), S.normal_subcommands("subcommands", S.page_name("source")).alias("subcommands"), F.coalesce("nested", F.lit(False)).alias("nested"))
    good = outcomes.where("outcome = 'success'").select("source")
    return outcomes, P.postprocess(each.join(good, "source", "left_semi"), "source", "idx")


def extract(pages: DataFrame, model: str, chunk: int = T.CHUNK) -> tuple[DataFrame, DataFrame]:
    """pages: source, text.  Skipped pages are outcomes too."""
    verdict = T.size_verdict(F.col("text"))
    work = pages.withColumn("text", S.plain_entities("text")).withColumn("_v", verdict)
    ready = T.filtered(work.where("_v is null"), "source", "text").select("source", "text")
    replies = written(ask(T.chunks(ready, "source", "text", chunk), model), "replies")  # a model is asked once
    outcomes, options = assemble(replies, ready)
    skipped = work.where("_v is not null").select("source", F.lit("skipped").alias("outcome"), F.col("_v").alias("reason"))
    return outcomes.unionByName(skipped, allowMissingColumns=True), options
