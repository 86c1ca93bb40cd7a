"""Extractions that can be interrupted and taken up again.

Pages are dealt to parts by a hash of their source; a part's outcomes and options are one
commit (`sources.snapshots`), so what is finished stays whatever happens, and a run on the
same folder goes on with the parts that are missing.  A run's Spark jobs carry its tag; the
registry knows the tags of this driver, and cancelling one interrupts its jobs.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots
from . import extract as X
from . import texts as T


class Interrupted(RuntimeError):
    """The run was cancelled; its finished parts are in place."""


@dataclass
class Run:
    tag: str
    path: str
    parts: int
    began: float = field(default_factory=time.time)
    done: int = 0
    cancelled: bool = False


class Registry:
    """The runs of this driver that aren't over, by tag."""

    def __init__(self):
        self._runs: dict[str, Run] = {}
        self._lock = threading.Lock()

    def begin(self, run: Run) -> None:
        with self._lock:
            if run.tag in self._runs:
                raise ValueError(f"{run.tag} is running")
            self._runs[run.tag] = run

    def end(self, tag: str) -> None:
        with self._lock:
            self._runs.pop(tag, None)

    def running(self) -> list[Run]:
        with self._lock:
            return sorted(self._runs.values(), key=lambda r: r.began)

    def cancel(self, spark: SparkSession, tag: str | None = None, wait: float = 60) -> list[str]:
        """Interrupts a run, or all of them, and waits until they have ended; the tags.

        A run may be between two jobs, so it is interrupted again until it is over.
        """
        with self._lock:
            chosen = [r for r in self._runs.values() if tag in (None, r.tag)]
            for r in chosen:
                r.cancelled = True
        until = time.time() + wait
        while (at_work := [r for r in chosen if r in self.running()]) and time.time() < until:
            for r in at_work:
                spark.sparkContext.cancelJobsWithTag(r.tag)
            time.sleep(0.2)
        return [r.tag for r in chosen]


REGISTRY = Registry()


def _names(k: int) -> tuple[str, str]:
    return f"outcomes-{k:05d}", f"options-{k:05d}"


def missing_parts(spark: SparkSession, path: str, parts: int) -> list[int]:
    store = Snapshots(spark, path)
    held = store.newest().folders if store.versions() else {}
    return [k for k in range(parts) if _names(k)[0] not in held]


def run_extraction(pages: DataFrame, model: str, path: str, tag: str, parts: int = 32, chunk: int = T.CHUNK, registry: Registry = REGISTRY, most: int | None = None) -> int:
    """Extracts the parts of pages (source, text) that `path` hasn't yet, `most` of them for now; how many.  `parts` and the pages are those of the first run."""
    spark = pages.sparkSession
    store, run = Snapshots(spark, path), Run(tag, path, parts)
    registry.begin(run)
    spark.sparkContext.addJobTag(tag)
    try:
        for k in missing_parts(spark, path, parts)[:most]:
            if run.cancelled:
                raise Interrupted(tag)
            outcomes, options = X.extract(pages.where(F.pmod(F.xxhash64("source"), F.lit(parts)) == k), model, chunk)
            store.commit(dict(zip(_names(k), (outcomes, options), strict=True)), store.newest() if store.versions() else None)
            run.done += 1
        return run.done
    except Exception as e:
        if run.cancelled and not isinstance(e, Interrupted):
            raise Interrupted(tag) from e
        raise
    finally:
        spark.sparkContext.removeJobTag(tag)
        registry.end(tag)


def extracted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(outcomes, options) of all finished parts."""
    now = Snapshots(spark, path).newest()
    of = lambda kind: reduce(DataFrame.unionByName, (now.read(n) for n in sorted(now.folders) if n.startswith(kind)))
    return of("outcomes-"), of("options-")
