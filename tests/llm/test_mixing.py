import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import encoding, mixing

pytestmark = pytest.mark.skipif(not encoding.available(), reason="no tokenizer files here")
DOCS = "doc_id long, text string, source string, tokens int, target_weight double"
WEIGHTS = "source string, target_weight double, max_repeats int"


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 5):
            at = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(at) == list(range(n))
    a, b = (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (1, 2))
    assert (a != b).any()


def test_counts_respect_room():
    c = mixing.draw_counts(np.array([0.5, 0.3, 0.2]), np.array([10, 1000, 1000]), 500, 8, 1)
    assert c.sum() == 500 and c[:, 0].sum() == 10 and (c.sum(1) >= 62).all()
    assert mixing.draw_counts(np.array([1.0]), np.array([3]), 10, 2, 1).sum() == 3
    assert mixing.slots_that_fit(np.array([0.5, 0.5]), np.array([100, 400]), 0.0) == 200


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    docs, i = [], 0
    for source, n in (("big", 150), ("mid", 60), ("tiny", 12), ("free", 30), (None, 5)):
        for _ in range(n):
            i += 1
            docs.append((i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(20, 90))), source, 0, 0.0))
    docs += [(1000 + k, docs[0][1], s, 0, 0.0) for k, s in enumerate(["big", "mid", "tiny"])]
    docs += [(2000, None, "big", 0, 0.0), (2001, "", "mid", 0, 0.0)]
    weights = [("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 8), ("absent", 0.1, 3), ("bad", None, 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(weights, WEIGHTS)


def test_shares_and_repeats(spark, corpus):
    docs, weights = corpus
    m = mixing.Mix(docs, weights, block=16, shards=4)
    got = {r.source: r for r in m.shares().collect()}
    assert set(got) == {"big", "mid", "tiny", "free", "absent", "bad"}
    for s, w in (("big", 5 / 9), ("mid", 3 / 9), ("tiny", 1 / 9)):
        assert abs(got[s].effective_weight - w) < 1e-12 and abs(got[s].share - w) < 0.06
    assert got["free"].share == got["absent"].share == got["bad"].share == 0.0
    pieces = m.pieces().cache()
    uses = pieces.groupBy("source", "doc_id", "first").count().groupBy("source").agg(F.max("count").alias("n"))
    assert all(r.n <= {"big": 1, "mid": 2, "tiny": 8}[r.source] for r in uses.collect())
    assert pieces.where("doc_id >= 1000").count() == 0  # copies of a text are one text
    n = {r.doc_id: r.tokens for r in m.sized.collect()}
    spans = {}
    for r in pieces.collect():
        assert 0 <= r.first < r.last <= n[r.doc_id]
        spans.setdefault((r.source, r.block), {})[(r.doc_id, r.first)] = r.last - r.first
    assert max(sum(v.values()) for v in spans.values()) == 16
    assert m.pieces().count() == mixing.Mix(docs, weights, block=16, shards=4).pieces().count()


def test_streams_have_no_gaps(corpus):
    docs, weights = corpus
    for rows in (50_000, 20):  # one bucket, many buckets
        m = mixing.Mix(docs, weights, block=16, shards=2, order_rows=rows)
        at = {}
        for r in sorted(m.stream.collect(), key=lambda r: (r.source, r.start)):
            assert r.start == at.get(r.source, 0)
            at[r.source] = r.start + r.tokens


def test_empty(spark):
    docs, weights = spark.createDataFrame([], DOCS), spark.createDataFrame([], WEIGHTS)
    m = mixing.Mix(docs, weights)
    assert m.pieces().count() == 0 and m.shares().count() == 0
    one = spark.createDataFrame([("a", 1.0, 1)], WEIGHTS)
    assert [r.share for r in mixing.Mix(docs, one).shares().collect()] == [0.0]
