import random

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import quantiles
from marginalia.llm.quantiles import Summary, ask


def error(values, got, q):
    v = np.sort(values)
    k = max(1, int(np.ceil(q * len(v) - 1e-9)))
    return max(0, np.searchsorted(v, got, "left") + 1 - k, k - np.searchsorted(v, got, "right"))


def test_bound_holds_in_any_merge_order():
    rng = random.Random(0)
    for trial in range(8):
        parts = [np.array([rng.choice([rng.random(), 0.5, rng.paretovariate(1)]) for _ in range(rng.randint(0, 900))]) for _ in range(12)]
        summaries = []
        for p in parts:
            s = Summary(32)
            s.add(p)
            summaries.append(s)
        rng.shuffle(summaries)
        while len(summaries) > 1:
            a, b = summaries.pop(), summaries.pop(rng.randrange(len(summaries)))
            a.merge(*b.row())
            summaries.insert(0, a)
        _, n, bound, _, buffers = summaries[0].row()
        every = np.concatenate(parts)
        assert n == len(every) and sum(len(b["values"]) * 2 ** b["level"] for b in buffers) == n
        for q, v in zip(quantiles.QUANTILES, ask(n, buffers)):
            assert error(every, v, q) <= bound
        assert bound < 0.2 * n


def test_small_groups_are_exact():
    s = Summary(8)
    s.add(np.array([3.0, 1.0, 2.0, 2.0]))
    _, n, bound, _, buffers = s.row()
    assert bound == 0 and ask(n, buffers, (0.5, 0.99)) == [2.0, 3.0] and ask(0, []) == [None] * 4


SCHEMA = "measurement_id long, paper_id string, latency_seconds double, n int, k int"


def run(spark, rows, hot=0.01):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    once = quantiles.once(df, "measurement_id", "paper_id", ["paper_id", "latency_seconds"], hot)
    parts = quantiles.combine(quantiles.summaries(once, ["paper_id"], "latency_seconds", k=64), ["paper_id"])
    return {r.paper_id: r for r in quantiles.percentiles(parts, ["paper_id"]).collect()}


def test_dirty_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", 1.0), (1, "a", 1.0), (2, "a", 3.0), (3, "a", None), (4, "a", nan), (5, "a", inf), (6, "a", -1.0), (7, None, 2.0), (None, "a", 9.0), (None, "a", 9.0), (8, "b", None)]
    got = run(spark, rows)
    assert set(got) == {"a", None, "b"}
    assert (got["a"].n, got["a"].p50, got["a"].p99) == (4, 3.0, 9.0)
    assert got[None].p50 == 2.0 and got["b"].n == 0 and got["b"].p50 is None
    assert run(spark, []) == {}


def test_hot_group_against_exact(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 else f"p{i % 40}", round(rng.paretovariate(1.2), 3)) for i in range(6000)]
    got = run(spark, rows + rows[:500], 0.2)
    for p, r in got.items():
        v = np.array([x[2] for x in rows if x[1] == p])
        assert r.n == len(v)
        for q, x in zip(quantiles.QUANTILES, (r.p50, r.p90, r.p95, r.p99)):
            assert error(v, x, q) <= r.rank_error <= 0.1 * len(v)


def test_days_combine(spark):
    rng = random.Random(5)
    rows = [(i, f"d{i % 5}", rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, day string, v double")
    days = quantiles.combine(quantiles.summaries(df, ["day"], "v", k=64), ["day"], deal=2)
    every = quantiles.combine(days.withColumn("day", F.lit("all")), ["day"])
    r = quantiles.percentiles(every, ["day"]).first()
    assert r.n == 3000 and error(np.array([x[2] for x in rows]), r.p50, 0.5) <= r.rank_error
