"""Order statistics by selection against sorted lists, with ranges of a few values so that many rounds are taken."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cliloom.operators import analytics as O
from cliloom.operators import selection as Q


def values(seed):
    rng = random.Random(seed)
    rows = [("even", float(i)) for i in range(500)] + [("one", 4.0)] * 30 + [("two", x) for x in (1.0, 2.0)] + [(None, rng.random()) for _ in range(40)] + [("none", None)] * 3
    rows += [("skew", float(int(rng.expovariate(0.01)))) for _ in range(400)] + [("skew", None), ("lone", 7.5)]
    rng.shuffle(rows)
    return rows


def groups(rows):
    out = {}
    for k, v in rows:
        out.setdefault(k, []).append(v)
    return {k: sorted(x for x in v if x is not None) for k, v in out.items()}


@pytest.mark.parametrize("most", [Q.MOST, 7, 1])
def test_ranks(spark, most):
    rows = values(1)
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    ranks = {"first": F.lit(1), "half": Q.at_index(0.5), "high": Q.at_index(0.99), "last": F.col("_n"), "beyond": F.col("_n") + 1}
    got = {r["k"]: tuple(r)[1:] for r in Q.order_statistics(df, "v", ["k"], ranks, most).collect()}
    at = lambda v, q: v[min(len(v) - 1, int(q * len(v)))]
    assert got == {k: (v[0], at(v, 0.5), at(v, 0.99), v[-1], None) if v else (None,) * 5 for k, v in groups(rows).items()}


@pytest.mark.parametrize("most", [Q.MOST, 3])
def test_whole_tables_and_empty_ones(spark, most):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "n long")
    assert tuple(Q.order_statistics(df, "n", [], Q.middle("m"), most).first()) == (50, 50)
    assert tuple(Q.order_statistics(df.limit(0), "n", [], Q.middle("m"), most).first()) == (None, None)
    assert Q.order_statistics(df.limit(0).withColumn("k", F.lit(1)), "n", ["k"], Q.middle("m"), most).count() == 0


@pytest.mark.parametrize("most", [Q.MOST, 2])
def test_quantiles_between_neighbours(spark, most, monkeypatch):
    monkeypatch.setattr(Q.order_statistics, "__defaults__", (most,))
    rng = random.Random(3)
    rows = [(n, rng.randint(0, 50)) for n in (1, 2, 3, 9, 10, 40) for _ in range(n)]
    df = spark.createDataFrame(rows, "g int, v int")
    got = {r["g"]: r["p90"] for r in O.exclusive_quantiles(df, "v", ["g"], 0.9).collect()}
    for n, v in groups(rows).items():
        want = statistics.quantiles(v, n=10)[8] if n > 1 else v[0]
        assert got[n] == pytest.approx(want)
    report = {r["bucket"]: (r["n"], r["median_v"]) for r in O.bucket_report(df, "g", ["v"], ["v"]).collect()}
    assert report == {n: (n, statistics.median(v)) for n, v in groups(rows).items()}
    spans = spark.createDataFrame([(5, True, 1.0), (6, True, 3.0), (7, False, 9.0), (25, False, 2.0)], "t long, ok boolean, v double")
    got = [tuple(r) for r in O.time_buckets(spans, "t", "ok", "v", 10).orderBy("bucket").collect()]
    assert got == [(0, 3, 2, 1, 0.3, 3.0, 3.0, 3.0, 3.0), (1, 0, 0, 0, 0.0, None, None, None, None), (2, 1, 0, 1, 0.1, None, None, None, None)]
