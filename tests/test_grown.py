"""What shows on larger tables only: rounding, and plans that have to stay small."""

import hashlib
import json
import pickle
import random

import pyarrow as pa
from pyspark.sql import functions as F

from cliloom.functions import strings as S
from cliloom.operators import batches as B
from cliloom.operators import catalog as C
from cliloom.operators import evals as V
from cliloom.operators import options as P
from cliloom.sources import pagefiles as G


def test_short_tokens_rounds_as_printf(spark):
    # Halves of a tenth: the double of some is below, of some above, of every fifth at the half itself.
    numbers = [50_000 * (2 * k + 1) for k in range(10, 6000)] + [137 * k for k in (1_350_000, 1_650_000, 2_000_001)] + [500 * k for k in range(2, 2000)] + [1_000_000, 999_999, 999_500, 1000, 999, 7, 0, 10**15 + 50_000, 2**53 - 1]
    got = {r["n"]: r["t"] for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", S.short_tokens("n").alias("t")).collect()}
    want = {n: "%.1fM" % (n / 1_000_000) if n >= 1_000_000 else "%.0fK" % (n / 1000) if n >= 1000 else str(n) for n in numbers}
    assert got == want
    assert got[137 * 1_350_000] == "184.9M" and got[137 * 1_650_000] == "226.1M"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_superset_merge_broadcasts_nothing(spark, monkeypatch):
    # The file's size says little of a table of repeated texts: what is planned by it may not fit the driver.
    plans, write = [], P.written
    monkeypatch.setattr(P, "written", lambda df, label: plans.append(planned(df)) or write(df, label))
    flags = F.slice(F.array(*map(F.lit, ["-a", "-b", "--all", "--zone"])), 1, (F.col("id") % 4 + 1).cast("int"))
    rows = spark.range(400).select((F.col("id") / 4).cast("int").alias("page"), (F.col("id") % 4).cast("int").alias("idx"), flags.alias("short"), F.array().cast("array<string>").alias("long"), F.lit("as -b or --zone").alias("text"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"))
    out = P.superset_dedup(rows, "page", "idx")
    plans.append(planned(out))
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]
    assert {(r["idx"], r["n"]) for r in out.groupBy("idx").agg(F.count("*").alias("n")).collect()} == {(3, 100)}


def test_find_pages_broadcasts_no_catalog(spark, tmp_path):
    # 3000 pages of one repeated name: a small file, and many rows once it is read.
    n = F.col("id").cast("string")
    p = spark.range(3000).select(F.concat(F.lit("d/1/1/page-"), n, F.lit(".1.gz")).alias("source"), F.concat(F.lit("page-"), n).alias("name"), F.lit("1").alias("section"))
    p.write.parquet(f"{tmp_path}/pages")
    p = spark.read.parquet(f"{tmp_path}/pages")
    names = spark.createDataFrame([(1, "d/1/1/page-7.1.gz"), (2, "same"), (3, "same.1"), (4, "none")], "query_id int, name string")
    found = C.find_pages(names, p, p.select(F.lit("same").alias("src"), F.col("source").alias("dst"), F.lit(1).alias("score")))
    joins = [x for x in planned(found).splitlines() if "BroadcastHashJoin" in x and ("source#" in x or "_src#" in x and "LeftAnti" not in x)]
    assert not joins
    assert {r["query_id"]: r["n"] for r in found.groupBy("query_id").agg(F.count("source").alias("n")).collect()} == {1: 1, 2: 3000, 3: 3000, 4: 0}


def test_anchored_lookup_is_anchored(spark):
    rng = random.Random(4)
    commands = spark.createDataFrame([(q, rng.randint(0, 3), rng.choice("abcdx")) for q in range(40) for _ in range(rng.randint(1, 5))] + [(None, 0, "a")], "query_id int, pos int, name string")
    places = spark.createDataFrame([(m, f"d{k}", f"{v}", f"d{k}/{v}/1/{m}.1.gz") for m in "abcd" for k in range(3) for v in range(3) if rng.random() < 0.5], "name string, distro string, release string, source string")
    order = C.preference(places.select("distro", "release").distinct(), "d1")
    found = commands.distinct().join(places, "name")
    columns = ["query_id", "pos", "name", "distro", "release", "source"]
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()))
    got = C.anchored_lookup(commands, places, order)
    assert rows(got) and rows(got) == rows(C.anchored(found, order))


def test_suggestions_shuffle_no_pairs(spark):
    rng = random.Random(5)
    pairs = [(rng.choice("abcdef"), f"p{rng.randint(0, 30)}") for _ in range(90)] + [("a", None), (None, "p1")]
    sources = [(f"p{k}",) for k in range(0, 40, 2)] * 2 + [(None,)]
    out = C.suggestions(spark.createDataFrame(sources, "source string"), spark.createDataFrame(pairs, "src string, dst string"))
    want = {(a, b) for (a,) in sources for n, x in pairs for m, b in pairs if a and x == a and n and n == m and b and b != a}
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted(want)
    above = planned(out).split("SortMergeJoin")[0]
    assert "Exchange" not in above and "Aggregate" not in above


def test_metrics_parse_a_page_once(spark):
    # What loops over tags and characters names used to be worked out again for each of them.
    html = spark.createDataFrame([("<p>a</p>",)], "h string")
    plan = planned(html.select(V.html_metrics(F.col("h")).alias("m")))
    assert plan.count("regexp_extract_all(") == 1 and plan.count("(script|style)") == 1
    plan = planned(html.select(V.markdown_metrics(F.col("h")).alias("m")))
    assert plan.count(V.OPTION_LIKE) == 1


def test_comparison_makes_each_run_once(spark):
    rng = random.Random(6)
    rows = lambda n: [(rng.choice(["p1", "p2", "p3", f"only{n}"]), rng.choice(["a", "b", "c", "flag", "other"]), float(rng.randint(0, 2))) for _ in range(25)] + [(None, "a", 1.0)]
    runs = [rows(1), rows(2)]
    frame = lambda r: spark.createDataFrame([(p, m, None if m == "flag" else v, v > 0 if m == "flag" else None) for p, m, v in r], "path string, metric string, value double, truth boolean")
    checks = {"a": 0.0, "b": 0.6, "flag": 0.0}
    made = frame(runs[0]), frame(runs[1])
    out = V.compared(*made, spark.createDataFrame([(m, t, None) for m, t in checks.items()], "metric string, tolerance double, direction string"))
    assert planned(out).count("Scan ExistingRDD[path") == 2
    paths = [{p for p, _, _ in r if p} for r in runs]
    want = [(p, None, None, "removed") for p in paths[0] - paths[1]] + [(p, None, None, "added") for p in paths[1] - paths[0]] + [(None, None, None, "removed"), (None, None, None, "added")]
    for p in paths[0] & paths[1]:
        for m in checks:
            sides = [[float(v > 0) if m == "flag" else v for q, n, v in r if (q, n) == (p, m)] for r in runs]
            if sides[0] or sides[1]:
                want += [(p, m, x, y, "flipped" if m == "flag" else "changed") for x in sides[0] or [0.0] for y in sides[1] or [0.0] if x != y and (m == "flag" or abs(y - x) / max(x, 1) > checks[m])]
    got = [(r["path"], r["metric"], r["before"], r["after"], r["reason"]) if r["metric"] else (r["path"], None, None, r["reason"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_page_files_leave_lists_to_tasks(spark, tmp_path):
    rows = [{"source": f"d/e/1/p{k:03d}", "text": f"text {k}", "aliases": [f"a{k}", "shared"]} for k in range(500)]
    writer = G.PageWriter(str(tmp_path))
    batch = lambda part: iter([pa.RecordBatch.from_pylist(part, pa.schema([("source", pa.string()), ("text", pa.string()), ("aliases", pa.list_(pa.string()))]))])
    messages = [writer.write(batch(rows[k::3])) for k in range(3)] + [writer.write(batch([{"source": "d/e/1/p000.gz", "text": None, "aliases": ["a0"]}]))]
    assert all(len(pickle.dumps(m)) < 1000 for m in messages)
    writer.commit(messages)
    # The name is that of the whole lists, as it was when the driver held them.
    files = sorted((r["source"] + ".gz", hashlib.sha256(G.packed(r["text"])).hexdigest()) for r in rows)
    aliases = sorted({(a, r["source"] + ".gz") for r in rows for a in r["aliases"]})
    assert [p.name for p in tmp_path.iterdir()] == ["set-" + hashlib.sha256(json.dumps([files, aliases]).encode()).hexdigest()]
    assert sum(p.is_file() for p in tmp_path.rglob("*")) == 501 and len([p for p in next(tmp_path.iterdir()).iterdir() if p.is_dir()]) == 3
    pages = G.read_pages(spark, str(tmp_path))
    assert "FileScan" not in planned(pages) and G.read_pages(spark, str(tmp_path / "none")).count() == 0
    assert {(r["source"], r["text"], r["length"]) for r in pages.collect()} == {(r["source"], r["text"], len(r["text"])) for r in rows}
    assert G.read_aliases(spark, str(tmp_path)).count() == 1000


def test_batch_job_writes_texts_once(spark, tmp_path):
    lose = [True]
    answer = lambda i, body: {"status": F.lit(200), "body": F.upper(body), "message": F.lit(None).cast("string"), "present": ~body.contains("lost") if lose[0] else F.lit(True)}
    service = B.FolderService(spark, str(tmp_path / "inbox"), answer)
    job = B.BatchJob(spark, str(tmp_path / "job"), service, size=3)
    rows = [("a", k, f"body {k}") for k in range(4)] + [("b", k, f"lost {k}") for k in range(3)]
    assert job.prepare(spark.createDataFrame(rows + rows[:2], "item string, chunk int, body string")) == 7
    for again in (True, False):
        job.submit()
        service.serve()
        job.collect()
        lose[0] = False
        assert job.retry() == (3 if again else 0)
    assert not list(tmp_path.glob("job/outbox/*/batch=*")) and list(tmp_path.glob("inbox/batch=*/*.gz"))
    written = lambda kind: sorted(r["text"] for folder in tmp_path.glob(f"job/state/data/{kind}-*/*") for r in spark.read.parquet(str(folder)).toDF("custom_id", "text").collect())
    assert written("bodies") == sorted(x for _, _, x in rows) and written("replies") == sorted(x.upper() for _, _, x in rows)
    assert all(set(spark.read.parquet(str(f)).columns).isdisjoint({"body", "reply"}) for f in tmp_path.glob("job/state/data/states/*"))
    assert {(r["item"], r["chunk"], r["body"], r["reply"], r["state"]) for r in job.requests().collect()} == {(*r, r[2].upper(), "done") for r in rows}
    assert job.prepare(spark.createDataFrame([*rows, ("c", 0, "new")], "item string, chunk int, body string")) == 1 and job.requests().count() == 8
