import random

from marginalia.llm import group_split


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), []).append(n)
    return {n: min(v) for v in groups.values() for n in v}


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100)]
    stars = [(1000, 1000 + i) for i in range(1, 80)]
    mixed = [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(90)]
    edges = chain + stars + mixed + chain[:5] + [(7, 7)]
    want = union_find(edges, {x for e in edges for x in e})
    got = {r.node: r.component for r in group_split.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[n] == c for n, c in want.items() if n != c)
    assert group_split.components(spark.createDataFrame([], "u long, v long")).count() == 0


SCHEMA = "result_id long, paper_id string, question_id string, method string, row string, node int, group_id int"


def test_groups(spark):
    data = [
        (5, "P1.pdf", "Q1"), (9, " p1v2 ", "q2"), (3, "p7", "q2 "), (11, None, "q1"), (20, "unknown", "n/a"), (21, "N/A", None),
        (22, "", ""), (30, "p9", None), (31, "P9v1.pdf", "unknown"), (40, None, "only"), (40, None, "only"),
    ]
    df = spark.createDataFrame([(*d, "m", "x", 0, 0) for d in data], SCHEMA)
    got = sorted((r.result_id, r.group_id) for r in group_split.groups(df).collect())
    want = {3: 3, 5: 3, 9: 3, 11: 3, 20: 20, 21: 21, 22: 22, 30: 30, 31: 30, 40: 40}
    assert got == sorted((d[0], want[d[0]]) for d in data)
    assert group_split.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(2)
    rows = []
    for g in range(600):
        for _ in range(400 if g == 0 else rng.randint(1, 9)):
            rows.append((g, rng.choice(["a", "b", "c"]) if g % 50 else rng.choice(["rare", None])))
    df = spark.createDataFrame(rows, "group_id long, method string")
    for size in (50_000, 100):
        s = group_split.stratified_splits(df, bucket_groups=size)
        assert s.count() == s.select("group_id").distinct().count() == 600
        for r in group_split.split_shares(df.join(s, "group_id")).collect():
            assert abs(r.share - group_split.SPLITS[r.split]) < (0.03 if r.label in {"a", "b", "c"} else 0.35), r


def test_one_giant_group_and_empty(spark):
    df = spark.createDataFrame([(1, "a")] * 50 + [(2, "a")], "group_id long, method string")
    got = {r.group_id: r.split for r in group_split.stratified_splits(df).collect()}
    assert got[1] == "train" and got[2] != "train"
    assert group_split.stratified_splits(df.limit(0)).count() == 0
