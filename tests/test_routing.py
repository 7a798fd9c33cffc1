import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import cost, routing, stats


def question_rows(spark):
    signal = "struct<top_score:double,top_margin:double,normalized_entropy:double>"
    return spark.createDataFrame(
        [("Which growth figures stand in the Figure?", 12, (0.5, 0.1, 0.9), (0.7, 0.2, 0.8))],
        f"question string, candidate_images int, c {signal}, s {signal}",
    )


def test_features(spark):
    df = question_rows(spark)
    early = routing.early_features(F.col("question"), F.col("candidate_images"), F.col("c"))
    r = df.select(*[c.alias(k) for k, c in early.items()]).first()
    assert tuple(early) == routing.EARLY
    assert (r.candidate_log, r.question_tokens, r.mentions_table, r.mentions_visual) == (math.log1p(12), 7.0, 1.0, 1.0)
    inv = routing.invariant_features(F.col("question"), F.col("c"))
    r = df.select(*[c.alias(k) for k, c in inv.items()]).first()
    assert (r.mentions_table, r.mentions_visual) == (0.0, 1.0)
    assert r.question_token_diversity == 1.0
    both = routing.inference_features(F.col("question"), F.col("candidate_images"), F.col("c"), F.col("s"))
    assert len(both) == 13
    assert abs(df.select(both["top_difference"].alias("x")).first().x - 0.2) < 1e-12
    flat = routing.Policy(tuple(both), (0.0,) * 13, (1.0,) * 13, (0.0,) * 13, 0.0, 0.5, causal=False)
    assert df.select(flat.probability(both).alias("p")).first().p == 0.5
    assert df.select(flat.saving(F.lit(0.2)).alias("x")).first().x == 0.0
    with pytest.raises(ValueError):
        routing.INVARIANT_POLICY.probability(early)


def test_threshold_sweep_equals_rescoring(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0.1, 0.2, 0.4, 0.4, 0.9]), rng.random(), rng.random()) for _ in range(60)]
    df = spark.createDataFrame(rows, "p double, c double, s double")
    got = {r.threshold: (r.route_rate, r.mrr) for r in routing.threshold_sweep(df, {"mrr": ("c", "s")}).collect()}
    for t in [*{x[0] for x in rows}, math.inf]:
        on = [x[0] >= t for x in rows]
        want = sum(x[2] if o else x[1] for x, o in zip(rows, on)) / 60
        assert abs(got[t][1] - want) < 1e-9 and abs(got[t][0] - sum(on) / 60) < 1e-12
    assert len(got) == len({x[0] for x in rows}) + 1


def test_infeasible_threshold_gives_no_row(spark):
    df = spark.createDataFrame([(0.9, 0.0, 1.0)], "p double, c double, s double")
    sweep = routing.threshold_sweep(df.withColumns({"c2": F.col("c"), "s2": F.col("s")}), {"mrr": ("c", "s"), "recall_at_1": ("c2", "s2")})
    assert routing.best_threshold(sweep, 0.5, 0.9, 0.9).count() == 0
    assert routing.best_threshold(sweep, 1.0, 0.9, 0.9).first().threshold == 0.9


def test_auc(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 1), rng.randint(0, 1)) for _ in range(80)]
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    got = routing.auc(spark.createDataFrame(rows, "p double, y int"), "p", "y").first()
    assert abs(got.auc - want) < 1e-9
    assert routing.auc(spark.createDataFrame([(0.1, 1)], "p double, y int"), "p", "y").first().auc is None


def test_router_fits_the_penalised_optimum(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2)) * [1.0, 5.0] + [0.0, 3.0]
    y = (x[:, 0] + 0.2 * x[:, 1] + rng.normal(size=120) > 0.5).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    p = routing.fit_router(df, ["a", "b"], c=0.5, positive_weight=2.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.where(y > 0, 2.0, 1.0)
    beta = np.zeros(3)
    full = np.c_[z, np.ones(120)]
    for _ in range(50):  # Newton on sum of weighted losses + |coef|^2 / (2 c)
        q = 1 / (1 + np.exp(-full @ beta))
        g = full.T @ (w * (q - y)) + np.r_[beta[:2] / 0.5, 0]
        h = (full * (w * q * (1 - q))[:, None]).T @ full + np.diag([2.0, 2.0, 0.0])
        beta -= np.linalg.solve(h, g)
    assert np.allclose([*p.coefficients, p.intercept], beta, atol=1e-4)


def test_sufficiency_and_oracle(spark):
    df = spark.createDataFrame([(True, 0.8, 0.5), (True, 0.799, 0.5), (False, 1.0, 1.0), (True, None, 1.0)], "e boolean, t double, l double")
    assert [r[0] for r in df.select(routing.sufficient(F.col("e"), F.col("t"), F.col("l"))).collect()] == [True, False, False, False]
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "c boolean, s boolean")
    r = routing.oracle_summary(rows, "c", "s", 1.0, 4.0, 0.15, 0.5).first()
    assert (r.cheap_sufficient, r.strong_regression, r.strong_needed, r.both_fail) == (1, 1, 1, 1)
    assert r.cheap_sufficient_rate == 0.5 and r.oracle_normalized_cost == 0.625 and not r.gate_passed


def test_mcnemar(spark):
    rows = [(0, 0), (1, 4), (9, 116), (700, 800)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long").select(stats.mcnemar(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [1.0, 0.375] and abs(got[2] - 7.78e-25) < 1e-26
    want = min(1.0, 2 * sum(math.comb(1500, i) for i in range(701)) / 2**1500)
    assert abs(got[3] - want) < 1e-9


def test_nearest_rank(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([1.0, 2.0, 2.5, rng.random()])) for k in "ab" for _ in range(rng.randint(1, 90))] + [("a", None), (None, 1.0), ("c", 7.0)]
    got = {r.k: r for r in stats.nearest_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.5, 0.95]).collect()}
    for k in "abc":
        v = sorted(x for q, x in rows if q == k and x is not None)
        assert got[k].n == len(v)
        assert (got[k].p50, got[k].p95) == (v[round((len(v) - 1) * 0.5)], v[round((len(v) - 1) * 0.95)])
    assert set(got) == set("abc")


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "i int, v double")
    r = stats.bootstrap(df, "i", "v").first()
    assert r["mean"] == 0.5 and 0.42 < r.low < 0.5 < r.high < 0.58


def test_rescue_cost(spark):
    calls = spark.createDataFrame([("a", 1, [0], 3), ("a", 2, [0, 1], 3)], "paper string, query_id int, indices array<long>, n int")
    pages = spark.createDataFrame([("a", i) for i in range(3)], "paper string, page long")
    lat = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "paper string, page long, seconds double")
    got = {r.strategy: r for r in cost.rescue_cost(calls, pages, lat, {"top": 0, "wide": 1}, 0.3, 0.0).collect()}
    assert (got["top"].unique_pages, got["top"].uncached_calls, got["top"].cached_seconds, got["top"].uncached_seconds) == (2, 3, 3.0, 4.0)
    assert got["wide"].unique_pages == 3 and not got["wide"].gate_passed and got["top"].gate_passed


def test_configured_grid(spark, data, monkeypatch):
    from marginalia.plans import more_queries

    asked = []

    def grid(train, calibration, names, cs, weights, gate):
        asked.append((cs, weights, gate))
        return [{"c": 1.0, "positive_weight": 1.0, "feasible": False}]

    monkeypatch.setattr(more_queries.routing, "router_grid", grid)
    more_queries.router_grid(spark, data)
    assert asked == [([0.1, 0.25, 1.0], [1.0, 2.0, 4.0], (0.85, 0.95, 0.95))]


def test_infeasible_gates_are_an_error(spark):
    import pytest

    from marginalia.operators import routing

    rows = spark.createDataFrame([(0.1 * i, 0.5, 1.0 if i > 5 else 0.0, 0.0, 1.0) for i in range(10)], "p double, mrr_c double, mrr_s double, recall_at_1_c double, recall_at_1_s double")
    sweep = routing.threshold_sweep(rows, {m: (f"{m}_c", f"{m}_s") for m in ("mrr", "recall_at_1")})
    assert routing.select_threshold(sweep, 0.45).route_rate <= 0.45
    with pytest.raises(ValueError):
        routing.select_threshold(sweep, 0.1, min_r1_retention=0.9)


def test_buckets_close_above(spark):
    from marginalia.operators import stats
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(v,) for v in (None, -3, 24, 25, 49, 50, 74, 75, 10**9)], "v long")
    got = [r[0] for r in df.select(stats.bucket(F.col("v"), (24, 49, 74), ("a", "b", "c", "d"))).collect()]
    assert got == ["unknown", "a", "a", "b", "b", "c", "c", "d", "d"]


def test_eligible_questions(spark):
    from marginalia.operators import splits

    figure = "struct<content_type:string,caption:string>"
    papers = spark.createDataFrame(
        [
            ("p1", [("q0", "a"), ("q1", "b"), ("q2", "gone"), ("q3", None), ("q4", "c")], {"a": ("table", "x"), "b": ("scheme", "y"), "c": ("figure", None)}),
            ("p2", [("q0", "a")], {"a": ("table", "x")}),
            ("p3", None, None),
        ],
        f"paper_id string, qa array<struct<question:string,reference:string>>, all_figures map<string,{figure}>",
    )
    members = spark.createDataFrame([("p1", "a"), ("p1", "a"), ("p1", "b"), ("p2", "a"), ("p1", "gone")], "paper_id string, reference string")
    got = splits.eligible_by_paper(papers, members, spark.createDataFrame([("p2",)], "paper_id string")).collect()
    assert [(r.paper_id, r.qa_index, r.question, r.reference, r.content_type) for r in got] == [("p1", 0, "q0", "a", "table")]
