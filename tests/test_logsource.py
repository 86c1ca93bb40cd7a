"""The log source: pieces of files, filters that reach the reader, rejected lines, and the same as a stream."""

import gzip
import json
from datetime import UTC, datetime

import pytest

from cliloom.sources import logsource as L

SCHEMA = "at timestamp, ip string, status int, more string, ok boolean, x double, n long"


@pytest.fixture
def log(spark, tmp_path):
    rows = [{"at": f"2024-01-0{1 + k // 40}T00:{k % 40:02d}:00", "ip": f"1.2.3.{k % 5}", "status": 200 + k % 3, "more": {"k": k}, "ok": k % 2 == 0, "x": k / 2, "n": k} for k in range(120)]
    lines = [json.dumps(r) for r in rows]
    lines[3] = "not json"
    lines[50] = json.dumps({"ip": "no time"})
    lines[51] = json.dumps({"at": "yesterday"})
    lines[52] = "[1]"
    lines[53] = json.dumps(rows[53] | {"ip": None, "status": "high", "x": True, "n": 1 << 70})
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(lines[:70]))
    (tmp_path / "log" / "b.jsonl.gz").write_bytes(gzip.compress(("\n".join(lines[70:]) + "\n\n").encode()))
    (tmp_path / "log" / "_SUCCESS").write_text("x")
    L.register(spark)
    return str(tmp_path / "log")


def read(spark, log, **options):
    return spark.read.format("cliloom_log").schema(SCHEMA).options(time="at", **options).load(log)


@pytest.mark.parametrize("piece", ["40", "1000", str(L.PIECE)])
def test_every_line_once(spark, log, piece):
    rows = {r["n"]: r for r in read(spark, log, piece=piece).collect()}
    assert set(rows) == (set(range(120)) - {3, 50, 51, 52, 53}) | {None}
    assert (rows[7]["ip"], rows[7]["status"], json.loads(rows[7]["more"]), rows[7]["ok"], rows[7]["x"]) == ("1.2.3.2", 201, {"k": 7}, False, 3.5)
    assert (rows[None]["ip"], rows[None]["status"], rows[None]["x"]) == (None, None, None)
    bad = spark.read.format("cliloom_log").options(time="at", rejects="true", piece=piece).load(log).collect()
    assert sorted(r["line"] for r in bad) == sorted(["not json", '{"ip": "no time"}', '{"at": "yesterday"}', "[1]"])
    assert {r["file"].rsplit("/", 1)[1] for r in bad} == {"a.jsonl"} and all(r["place"] > 0 for r in bad)


def test_filters_reach_the_reader(spark, log, capsys):
    late = read(spark, log).where("at >= timestamp '2024-01-02 00:10:00' and at < timestamp '2024-01-03 00:05:00' and ip is not null and status = 201")
    assert {r["n"] for r in late.collect()} == {k for k in range(50, 85) if k % 3 == 1 and k not in (50, 51, 52, 53)}
    late.explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(x for x in plan.split("\n") if "PushedFilters" in x)
    assert "GreaterThanOrEqual(at" in pushed and "LessThan(at" in pushed
    reader = L.LogReader(late.schema, {"path": log, "time": "at"})
    kept = list(reader.pushFilters([L.GreaterThan(("at",), datetime(2024, 1, 3, tzinfo=UTC)), L.IsNotNull(("ip",)), L.EqualTo(("status",), 200)]))
    assert len(kept) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 39


def test_a_stream_takes_later_files(spark, log, tmp_path):
    def run():
        stream = spark.readStream.format("cliloom_log").schema(SCHEMA).option("time", "at").load(log)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 116
    (tmp_path / "log" / "c.jsonl").write_text('{"at": "2024-02-01", "n": 5}\n')
    assert run() == 117 and run() == 117


def test_what_isnt_a_log(spark, log):
    with pytest.raises(Exception, match="can't be"):
        spark.read.format("cliloom_log").schema("at timestamp, x array<int>").load(log).collect()
    with pytest.raises(Exception, match="schema"):
        spark.read.format("cliloom_log").load(log).collect()
