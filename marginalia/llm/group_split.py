"""Splits that keep rows connected by paper or question together.

Components are found over the graph of ids (papers and questions, joined by rows) with
alternating large-star and small-star steps, each two aggregations and two joins on the
distinct edges; lineage is cut in the shared checkpoint folder after every round. Components
are then placed by grouped iterative stratification: their label vectors are aggregated, and
the component holding the rarest outstanding label goes to the split that needs that label
most.

Placing in parallel. Greedy placement is sequential, so the components are spread over
buckets of bounded size by a hash of their id and every bucket is placed by itself against
its own share of what is needed. The few components that are large against a bucket are
placed first, over all data, and what they take is subtracted from what the buckets need; each
holds more than 1/`large_groups` of all rows, so there are fewer than that many, whatever
the size of the data. No component is split, dropped or collected with the rest.

Defined results
  * ids are compared without case and outer blanks, papers without file ending and version;
  * null, empty and placeholder ids connect nothing; a row without ids is its own group;
  * group_id is the smallest result_id of the group; repeated result ids share a group only
    through their ids, and each row comes out once;
  * an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import paper_key, real_id
from ..session import cut_lineage

SPLITS = {"train": 0.70, "validation": 0.15, "test": 0.15}


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the graph edges(u, v) of longs; component is the least node.

    Rounds double what a node sees, so their number grows with the logarithm of the longest
    path; RuntimeError after `rounds`, which no graph below 2**rounds nodes reaches.
    """
    e = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    e = cut_lineage(e)
    before = None
    for _ in range(rounds):
        # large star: every neighbour above u is tied to the least of u and its neighbours
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: the lower neighbours of v, and v itself, are tied to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.col("m").alias("u"), F.col("u").alias("v"))
            .unionAll(low.select(F.col("m").alias("u"), "v"))
            .where("u <> v")
            .distinct()
        )
        e = cut_lineage(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("v").alias("node"), F.col("u").alias("component"))
        before = now
    raise RuntimeError("the graph's paths are too long for the number of rounds")


def groups(
    df: DataFrame, row: str = "result_id", paper: str = "paper_id", question: str = "question_id", keep: list[str] | None = None
) -> DataFrame:
    """df's columns (or those to keep) with group_id, the smallest row id of all rows connected to a row.

    A question of one paper ties nothing, so the graph whose components are sought has only the
    papers that questions share: each is tied to the least paper of the question.
    """
    columns = keep or df.columns
    named = df.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(columns)], F.col(row).alias("row"), paper_key(paper).alias("pk"), real_id(question).alias("qk"))
    out = [f"in_{i}" for i in range(len(columns))]
    keyed = cut_lineage(  # ids are folded once, whatever reads them below
        named.select(
            *out,
            "row",
            F.when(F.col("pk").isNotNull(), F.xxhash64(F.lit("paper"), "pk")).alias("p"),
            F.when(F.col("qk").isNotNull(), F.xxhash64(F.lit("question"), "qk")).alias("q"),
        )
    )
    pairs = cut_lineage(keyed.where("p is not null and q is not null").select("p", "q").distinct())
    of_question = cut_lineage(pairs.groupBy("q").agg(F.min("p").alias("m"), F.count("*").alias("papers")))
    ties = pairs.join(of_question.where("papers > 1"), "q").where("p <> m").select(F.col("m").alias("u"), F.col("p").alias("v"))
    of_paper = components(ties)
    asked = keyed.where("p is null and q is not null").join(of_question.select("q", "m"), "q", "left")
    rows = keyed.where("p is not null").select(*out, "row", F.col("p").alias("node")).unionByName(asked.select(*out, "row", F.coalesce("m", "q").alias("node")))
    least = rows.groupBy("node").agg(F.min("row").alias("least"))
    of_group = cut_lineage(least.join(of_paper, "node", "left").withColumn("component", F.coalesce("component", "node")))
    lowest = of_group.groupBy("component").agg(F.min("least").alias("group_id"))
    joined = rows.join(of_group.join(lowest, "component").select("node", "group_id"), "node").select(*out, "group_id")
    alone = keyed.where("p is null and q is null").select(*out, F.col("row").alias("group_id"))
    return joined.unionByName(alone).select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(columns) if c != "group_id"], "group_id")


def place(groups_: list[tuple[object, dict[str, float]]], needed: dict[str, dict[str, float]]) -> dict[object, str]:
    """Split of each (group, label vector), given what each split still needs of each label.

    The label with the least outstanding content is served first, its largest group first, by
    the split that needs the group's labels most: what it needs of each, as a share of all
    there is of it, weighted by what the group holds, so that a rare label weighs most (ties:
    needs most rows, then the split's order). needed is changed in place.
    """
    waiting: dict[str, list] = {}
    left: dict[str, float] = {}
    for g, vector in groups_:
        size = sum(vector.values())
        for label, n in vector.items():
            if n > 0:
                waiting.setdefault(label, []).append((-size, str(g), g))
                left[label] = left.get(label, 0) + n
    for queue in waiting.values():
        queue.sort(reverse=True)  # taken from the end: largest first
    vectors = dict(groups_)
    order = {s: -i for i, s in enumerate(needed)}
    total = {x: sum(max(0.0, needed[s].get(x, 0.0)) for s in needed) or 1.0 for x in left}
    placed: dict[object, str] = {}
    while left:
        label = min(left, key=lambda x: (left[x], x))
        queue = waiting[label]
        while queue and queue[-1][2] in placed:
            queue.pop()
        if not queue:
            del left[label]
            continue
        g = queue.pop()[2]
        vector = vectors[g]
        best = max(
            needed,
            key=lambda s: (
                sum(n * needed[s].get(x, 0.0) / total[x] for x, n in vector.items() if n > 0),
                sum(needed[s].values()),
                order[s],
            ),
        )
        placed[g] = best
        for x, n in vector.items():
            needed[best][x] = needed[best].get(x, 0.0) - n
            if x in left:
                left[x] -= n
    for g, _ in groups_:  # groups without labels
        placed.setdefault(g, next(iter(needed)))
    return placed


def stratified_splits(
    labelled: DataFrame,
    group: str = "group_id",
    label: str = "method",
    shares: dict[str, float] | None = None,
    bucket_groups: int = 50_000,
    large_groups: int = 2_000,
) -> DataFrame:
    """(group, split) of rows labelled(group, label); null labels count as one label of their own.

    bucket_groups: mean number of groups in a bucket; large_groups: a group of more than
    1/large_groups of all rows is placed on the driver, before the buckets.
    """
    shares = shares or SPLITS
    vectors = cut_lineage(
        labelled.select(F.col(group).alias("g"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"))
        .groupBy("g", "label")
        .agg(F.count("*").alias("n"))
        .groupBy("g")
        .agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("vector"), F.sum("n").alias("n"))
    )
    n_groups, n_rows = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(1, math.ceil(n_groups / bucket_groups))
    bound = n_rows / large_groups
    big = vectors.where(F.col("n") > bound)  # fewer than large_groups
    small = vectors.where(F.col("n") <= bound)
    totals = {r["label"]: r["n"] for r in vectors.select(F.explode("vector").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n")).collect()}
    needed = {s: {x: n * share for x, n in totals.items()} for s, share in shares.items()}
    first = place([(r["g"], r["vector"]) for r in big.select("g", "vector").toLocalIterator()], needed)
    rest = {x: sum(needed[s].get(x, 0.0) for s in needed) for x in totals}
    part = {s: {x: needed[s].get(x, 0.0) / rest[x] if rest[x] > 0 else shares[s] for x in totals} for s in needed}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors_ = [(g, dict(v)) for g, v in zip(pdf["g"], pdf["vector"])]
        own: dict[str, float] = {}
        for _, v in vectors_:
            for x, n in v.items():
                own[x] = own.get(x, 0) + n
        placed = place(vectors_, {s: {x: n * part[s][x] for x, n in own.items()} for s in part})
        return pd.DataFrame({"g": pdf["g"], "split": [placed[g] for g, _ in vectors_]})

    kind = dict(vectors.dtypes)["g"]
    spread_ = (
        small.select("g", "vector", F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"))
        .groupBy("bucket")
        .applyInPandas(run, f"g {kind}, split string")
    )
    spark = labelled.sparkSession
    ahead = spark.createDataFrame([(g, s) for g, s in first.items()], f"g {kind}, split string")
    return spread_.unionByName(ahead).withColumnRenamed("g", group)


def split_shares(assigned: DataFrame, label: str = "method") -> DataFrame:
    """(label, split, rows, share): the reached share of each split in each label."""
    counts = assigned.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"), "split").agg(F.count("*").alias("rows"))
    totals = counts.groupBy("label").agg(F.sum("rows").alias("of"))
    return counts.join(totals, "label").select("label", "split", "rows", (F.col("rows") / F.col("of")).alias("share"))
