"""Look-back and session reports with state that expires, and late rows as rows.

Sessions are kept by address: a row opens one, or joins the one whose `gap` it is in, or two
that it lies between.  A timer closes a session when no row can join it any more; then its row
is given out and its state goes.  A row that comes when the sessions of its time may be closed
is given out by itself, as `late`, and changes nothing.

Spark drops what is older than its watermark before a stateful operator sees it, so the
watermark is set back by `slack` further, and rows are told late by the operator: only what is
later than `late` and `slack` together is lost (and counted in the query's progress).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

OUT = "kind string, ip string, start timestamp, end timestamp, hits long"
_STATE = "start long, end long, hits long"
MINUTE = 60_000
#: What the state needs: a store that keeps several columns of state and timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def joined(sessions: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Sessions (start, end, hits) with those that are less than `gap` apart made one, by start."""
    out: list[tuple[int, int, int]] = []
    for start, end, hits in sorted(sessions):
        if out and start - out[-1][1] < gap:
            a, b, n = out[-1]
            out[-1] = a, max(b, end), n + hits
        else:
            out.append((start, end, hits))
    return out


class Sessions(StatefulProcessor):
    def __init__(self, gap: int, late: int, slack: int):
        self.gap, self.late, self.slack = gap, late, slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _STATE)

    def _frame(self, kind: str, ip: str, rows: list[tuple[int, int, int]]) -> pd.DataFrame:
        at = lambda i: pd.to_datetime([r[i] for r in rows], unit="ms", utc=True)
        return pd.DataFrame({"kind": kind, "ip": ip, "start": at(0), "end": at(1), "hits": [r[2] for r in rows]})

    def _reached(self, timers: TimerValues) -> int:
        """Rows before this are late; 0 as long as no watermark is known."""
        mark = timers.getCurrentWatermarkInMs()
        return mark + self.slack if mark > 0 else 0

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        reached, late, fresh = self._reached(timerValues), [], []
        for batch in rows:
            for ms in batch["ms"].tolist():
                (late if ms < reached else fresh).append((ms, ms, 1))
        if fresh:
            held = joined([*(tuple(s) for s in self.open.get()), *fresh], self.gap) if self.open.exists() else joined(fresh, self.gap)
            self.open.put(held)
            for _, end, _ in held:
                self.handle.registerTimer(end + self.gap - self.slack)
        if late:
            yield self._frame("late", key[0], sorted(late))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = self._reached(timerValues)
        held = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        over = [s for s in held if s[1] + self.gap <= reached]
        if over:
            left = [s for s in held if s[1] + self.gap > reached]
            self.open.put(left) if left else self.open.clear()
            yield self._frame("session", key[0], over)


def sessions(log: DataFrame, t: str = "ts", gap: int = 10 * MINUTE, late: int = 25 * MINUTE, slack: int = 30 * 24 * 60 * MINUTE) -> DataFrame:
    """kind (session or late), ip, start, end, hits, in append mode; gap, late and slack in milliseconds."""
    rows = log.select(F.col(t).alias("at"), "ip", F.unix_millis(t).alias("ms")).withWatermark("at", f"{late + slack} milliseconds")
    return rows.groupBy("ip").transformWithStateInPandas(Sessions(gap, late, slack), OUT, "Append", "eventTime")


def look_back(log: DataFrame, t: str = "ts", window: str = "25 minutes", slide: str = "5 minutes", late: str = "25 minutes") -> DataFrame:
    """until, ip, hits: of each address in the window that ends every `slide`; update mode, as in `logs.minute_bursts`."""
    w = F.window(t, window, slide)
    return log.withWatermark(t, late).groupBy(w.alias("w"), "ip").agg(F.count("*").alias("hits")).select(F.col("w.end").alias("until"), "ip", "hits")


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set(*STORE)
    return spark
