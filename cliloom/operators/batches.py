"""Requests to a batch service, in stages that can be taken up again after a crash.

`prepare` plans requests (item, chunk, body) into batches, `submit` hands batches over,
`collect` takes in what is answered, `retry` plans anew what failed, `cancel` gives up the
rest.  Each stage is a job of its own that reads one snapshot of the state and commits the
next (`sources.snapshots`), so one that ends early has changed nothing and is run again:
batches have names, under which a service takes them once, and replies are taken in by
request, `item:chunk`.

States of a request: planned, submitted, done, or failed with an error.  What is done stays
done: an error of a whole batch fails only those of its requests that have no reply in what
the service gives out, and a later reply to a request that is final is left aside.

Bodies and replies are written once, to tables of their own that later snapshots name again;
what a stage writes anew is the state of requests, without texts.  Bodies and replies travel
as JSON lines in folders, packed by gzip, written and read by Spark; a folder of bodies is
deleted when its batch has ended.  The driver holds a name and a state for each batch, never
a request.
"""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots

_STATES = "custom_id string, item string, chunk int, batch string, tries int, state string, error string"
_BODIES, _REPLIES = "custom_id string, body string", "custom_id string, reply string"
_BATCHES = "batch string, remote string, state string"
_LINE = "struct<custom_id:string,response:struct<status_code:int,body:string>,error:struct<message:string>>"


class BatchService(Protocol):
    """Folders hold JSON lines: custom_id and body of each request; custom_id and response or error of each reply."""

    def submit(self, name: str, folder: str) -> str:
        """The service's name for a batch; the same for the same name, however often it is handed over."""
        ...

    def poll(self, remote: str) -> str:
        """running, done or failed"""
        ...

    def results(self, remote: str) -> str | None:
        """Where the replies are; a failed batch may have some."""
        ...

    def cancel(self, remote: str) -> None: ...


class BatchJob:
    def __init__(self, spark: SparkSession, path: str, service: BatchService, size: int = 10_000):
        self.spark, self.path, self.service, self.size = spark, path.rstrip("/"), service, size
        self._store = Snapshots(spark, f"{self.path}/state")
        if not self._store.versions():
            self._store.commit({"states": spark.createDataFrame([], _STATES), "batches": spark.createDataFrame([], _BATCHES)})

    def requests(self) -> DataFrame:
        """custom_id, item, chunk, body, batch, tries, state, reply, error"""
        now = self._store.newest()
        rows = now.read("states").join(self._texts(now, "bodies", _BODIES), "custom_id", "left").join(self._texts(now, "replies", _REPLIES), "custom_id", "left")
        return rows.select("custom_id", "item", "chunk", "body", "batch", "tries", "state", "reply", "error")

    def _texts(self, now, kind: str, schema: str) -> DataFrame:
        """All texts of a kind: each request has one body and, when it is done, one reply."""
        tables = sorted(name for name in now.folders if name.startswith(f"{kind}-"))
        return self.spark.read.schema(schema).parquet(*(f"{now.path}/{now.folders[name]}" for name in tables)) if tables else self.spark.createDataFrame([], schema)

    def batches(self) -> DataFrame:
        return self._store.newest().read("batches")

    def _planned(self, fresh: DataFrame) -> DataFrame:
        """Requests dealt to batches of about `size`, under names that follow from the state alone."""
        parts = -(-fresh.count() // self.size) or 1
        name = F.format_string(f"v{self._store.newest().version:06d}-%06d", F.pmod(F.xxhash64("custom_id"), F.lit(parts)))
        return fresh.withColumn("batch", name).withColumn("tries", F.col("tries") + 1).withColumn("state", F.lit("planned")).withColumn("error", F.lit(None).cast("string"))

    def _commit_plan(self, now, kept: DataFrame, planned: DataFrame, texts: dict[str, DataFrame]) -> None:
        names = planned.select("batch").distinct().select("batch", F.lit(None).cast("string").alias("remote"), F.lit("planned").alias("state"))
        columns = [f.split()[0] for f in _STATES.split(", ")]
        self._store.commit({"states": kept.select(columns).unionByName(planned.select(columns)), "batches": now.read("batches").unionByName(names), **texts}, now)

    def prepare(self, wanted: DataFrame) -> int:
        """Plans requests (item, chunk, body) that aren't there yet; how many."""
        now = self._store.newest()
        old = now.read("states")
        fresh = wanted.select(F.concat_ws(":", F.col("item").cast("string"), F.col("chunk").cast("string")).alias("custom_id"), F.col("item").cast("string").alias("item"), F.col("chunk").cast("int").alias("chunk"), "body", F.lit(0).alias("tries"))
        if not old.isEmpty():  # bodies are shuffled only where that is needed
            fresh = fresh.join(old.select("custom_id"), "custom_id", "left_anti")
        given, n = fresh.select("custom_id").agg(F.count("*"), F.count_distinct("custom_id")).first()
        if n < given:
            fresh = fresh.dropDuplicates(["custom_id"])
        if n:
            self._commit_plan(now, old, self._planned(fresh.drop("body")), {f"bodies-{now.version:012d}": fresh.select("custom_id", "body")})
        return n

    def retry(self, tries: int = 3) -> int:
        """Plans failed requests anew that have been tried less than so often; how many."""
        now = self._store.newest()
        old = now.read("states")
        again = (F.col("state") == "failed") & (F.col("tries") < tries)
        n = old.where(again).count()
        if n:
            self._commit_plan(now, old.where(~again), self._planned(old.where(again)), {})
        return n

    def _change(self, now, states: dict[str, tuple[str | None, str]], requests: DataFrame, texts: dict[str, DataFrame] | None = None) -> None:
        """Commits new states of batches, by name, with those of requests."""
        changes = self.spark.createDataFrame([(k, *v) for k, v in states.items()], "batch string, _remote string, _state string")
        batches = now.read("batches").join(changes, "batch", "left").select("batch", F.coalesce("_remote", "remote").alias("remote"), F.coalesce("_state", "state").alias("state"))
        self._store.commit({"states": requests, "batches": batches, **(texts or {})}, now)

    def submit(self) -> int:
        """Hands planned batches over; how many."""
        now = self._store.newest()
        planned = now.read("batches").where("state = 'planned'").select("batch")
        names = [r["batch"] for r in planned.collect()]  # one for each `size` requests
        if not names:
            return 0
        rows = now.read("states")
        out = f"{self.path}/outbox/{now.version:012d}"
        lines = rows.where("state = 'planned'").select("custom_id", "batch").join(self._texts(now, "bodies", _BODIES), "custom_id").select("batch", F.to_json(F.struct("custom_id", "body")).alias("value"))
        lines.repartition("batch").write.mode("overwrite").partitionBy("batch").option("compression", "gzip").text(out)
        states = {name: (self.service.submit(name, f"{out}/batch={name}"), "submitted") for name in names}
        self._change(now, states, rows.withColumn("state", F.when(F.col("state") == "planned", "submitted").otherwise(F.col("state"))))
        return len(names)

    def collect(self) -> dict[str, int]:
        """Takes in what has ended; how many batches are running, done and failed now."""
        now = self._store.newest()
        open_ = [(r["batch"], r["remote"]) for r in now.read("batches").where("state = 'submitted'").collect()]
        ended = {name: (remote, state) for name, remote in open_ if (state := self.service.poll(remote)) != "running"}
        counts = {"running": len(open_) - len(ended)} | {s: sum(x[1] == s for x in ended.values()) for s in ("done", "failed")}
        if ended:
            folders = [f for _, (remote, _) in sorted(ended.items()) if (f := self.service.results(remote))]
            self._take_in(now, ended, folders)
        return counts

    def _take_in(self, now, ended: dict[str, tuple[str, str]], folders: list[str]) -> None:
        """Commits replies of requests that wait for them, and what became of the requests."""
        lines = self.spark.read.text(folders) if folders else self.spark.createDataFrame([], "value string")
        j = lines.select(F.from_json("value", _LINE).alias("j")).where("j.custom_id is not null")
        good = F.when(F.col("j.response.status_code") == 200, F.col("j.response.body"))
        bad = F.coalesce("j.error.message", F.concat(F.lit("status "), F.col("j.response.status_code").cast("string")), F.lit("empty reply"))
        names = self.spark.createDataFrame([(k, v[1]) for k, v in ended.items()], "batch string, _ended string")
        requests = now.read("states")
        mine = requests.where("state = 'submitted'").join(F.broadcast(names.select("batch")), "batch", "left_semi").select("custom_id")
        # Of several replies to one request a good one counts, of equals the least.
        replies = j.select(F.col("j.custom_id").alias("custom_id"), good.alias("reply")).where("reply is not null").join(mine, "custom_id", "left_semi").groupBy("custom_id").agg(F.min("reply").alias("reply"))
        told = j.groupBy(F.col("j.custom_id").alias("custom_id")).agg(F.bool_or(good.isNotNull()).alias("_good"), F.min(F.when(good.isNull(), bad)).alias("_error"))
        out = requests.join(F.broadcast(names), "batch", "left").join(told, "custom_id", "left")
        mine = (F.col("state") == "submitted") & F.col("_ended").isNotNull()
        done = F.coalesce("_good", F.lit(False))
        error = F.coalesce("_error", F.when(F.col("_ended") == "failed", "batch failed").otherwise("missing"))
        out = out.select("custom_id", "item", "chunk", "batch", "tries", F.when(mine, F.when(done, "done").otherwise("failed")).otherwise(F.col("state")).alias("state"), F.when(mine, F.when(~done, error)).otherwise(F.col("error")).alias("error"))
        self._change(now, ended, out, {f"replies-{now.version:012d}": replies})
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for n in ended:  # the service has done with its bodies
            for found in fs.globStatus(path(f"{self.path}/outbox/*/batch={n}")) or []:
                fs.delete(found.getPath(), True)

    def cancel(self) -> int:
        """Gives up what isn't final; batches that have ended are taken in first, and stay.  How many requests were given up."""
        self.collect()
        now = self._store.newest()
        open_ = [(r["batch"], r["remote"], r["state"]) for r in now.read("batches").where("state in ('planned', 'submitted')").collect()]
        for _, remote, state in open_:
            if state == "submitted":
                self.service.cancel(remote)
        rows = now.read("states")
        given_up = F.col("state").isin("planned", "submitted")
        n = rows.where(given_up).count()
        if open_:
            self._change(now, {name: (remote, "cancelled") for name, remote, _ in open_}, rows.withColumn("error", F.when(given_up, "cancelled").otherwise(F.col("error"))).withColumn("state", F.when(given_up, "failed").otherwise(F.col("state"))))
        return n

    def outcomes(self) -> DataFrame:
        """item, outcome (success, failed or open), chunks, done, error: an item with a failed chunk fails."""
        state = F.when(F.count_if(F.col("state") == "failed") > 0, "failed").when(F.count_if(F.col("state") != "done") > 0, "open").otherwise("success")
        return self._store.newest().read("states").groupBy("item").agg(state.alias("outcome"), F.count("*").alias("chunks"), F.count_if(F.col("state") == "done").alias("done"), F.min("error").alias("error"))


class FolderService:
    """A service whose answers appear in a folder, one below it for each batch, when `serve` has run; it reads and writes by Spark.

    `answer` makes the reply's columns (status, body, message, present) from custom_id and body.
    """

    def __init__(self, spark: SparkSession, path: str, answer, failing=lambda name: False):
        self.spark, self.path, self.answer, self.failing = spark, path.rstrip("/"), answer, failing
        self.handed: dict[str, str] = {}
        self.served: set[str] = set()
        self.cancelled: set[str] = set()

    def submit(self, name: str, folder: str) -> str:
        self.handed.setdefault(name, folder)
        return f"remote-{name}"

    def poll(self, remote: str) -> str:
        name = remote.removeprefix("remote-")
        return "running" if name not in self.served else "failed" if self.failing(name) else "done"

    def results(self, remote: str) -> str | None:
        return f"{self.path}/batch={remote.removeprefix('remote-')}"

    def cancel(self, remote: str) -> None:
        self.cancelled.add(remote)

    def serve(self, names: list[str] | None = None) -> None:
        todo = [n for n in (names or sorted(self.handed)) if n not in self.served and f"remote-{n}" not in self.cancelled]
        if not todo:
            return
        lines = reduce(DataFrame.unionByName, (self.spark.read.text(self.handed[n]).withColumn("batch", F.lit(n)) for n in todo))
        rows = lines.select("batch", F.from_json("value", "custom_id string, body string").alias("q")).select("batch", "q.*")
        a = self.answer(F.col("custom_id"), F.col("body"))
        line = F.to_json(F.struct("custom_id", F.struct(a["status"].alias("status_code"), a["body"].alias("body")).alias("response"), F.when(a["message"].isNotNull(), F.struct(a["message"].alias("message"))).alias("error")))
        rows.where(a["present"]).select("batch", line.alias("value")).write.mode("append").partitionBy("batch").option("compression", "gzip").text(self.path)
        for n in todo:  # a batch without any reply has an empty folder
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={n}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(p)
        self.served.update(todo)
