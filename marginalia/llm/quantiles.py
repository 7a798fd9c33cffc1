"""Percentiles per group with a proven rank error, combinable over partitions, runs or days.

Deterministic buffer collapsing. A summary holds sorted buffers of k values at levels
0, 1, 2, ...; a value in a buffer of level l stands for 2**l values. Values fill level 0;
whenever two buffers of one level exist they are merged and every other value is kept, the
first or the second of each two in turn, which makes one buffer of the next level. Merging
two summaries puts their buffers side by side and collapses in the same way, so summaries of
partitions combine to that of the whole in a tree, in any order.

The error. A collapse of two buffers of weight w moves the rank of any value by at most w.
The summary adds up the weights of its collapses, so `rank_error` bounds the distance between
the rank of a reported value and the asked rank, as a number of values: it is proven for the
data at hand, not expected. With n values it stays below n * log2(n / k) / (2 k) + 2**level;
groups of at most k values are exact.

Defined results
  * null, not-a-number, infinite and negative values are left out;
  * rows delivered again (same measurement id) count once; a null id never equals another;
  * null groups form the group null; a group without a valid value has null percentiles;
  * the q-percentile of n values is the value of rank max(1, ceil(q * n));
  * ties are plain values; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def buffer_size(epsilon: float, values: float = 1e9) -> int:
    """Least power of two that keeps the rank error of a group of up to `values` values below epsilon of them."""
    k = 2
    while values > k and math.log2(values / k) / (2 * k) + 1 / k > epsilon:
        k *= 2
    return k


#: Rank errors of at most 1.1 % of the group, for groups of up to a billion values.
K = buffer_size(0.011)
QUANTILES = (0.5, 0.9, 0.95, 0.99)
SUMMARY = "k int, n long, rank_error double, turn int, buffers array<struct<level:int,values:array<double>>>"


class Summary:
    """Buffers of one group. partial: level-0 values not yet filling a buffer."""

    def __init__(self, k: int = K):
        self.k, self.n, self.rank_error, self.turn = k, 0, 0.0, 0
        self.full: dict[int, list[np.ndarray]] = {}
        self.partial = np.empty(0)

    def add(self, values: np.ndarray) -> None:
        """Take unsorted values in."""
        self.n += len(values)
        self._fill(np.asarray(values, dtype=float))

    def _fill(self, values: np.ndarray) -> None:
        pool = np.concatenate([self.partial, values]) if len(self.partial) else values
        whole = len(pool) // self.k * self.k
        for block in np.sort(pool[:whole].reshape(-1, self.k), axis=1):
            self._push(0, block)
        self.partial = pool[whole:].copy()

    def _push(self, level: int, block: np.ndarray) -> None:
        while self.full.get(level):
            other = self.full.pop(level)[0]
            both = np.sort(np.concatenate([other, block]), kind="stable")
            block = both[self.turn :: 2]
            self.turn ^= 1
            self.rank_error += float(2**level)
            level += 1
        self.full[level] = [block]

    def merge(self, k: int, n: int, rank_error: float, turn: int, buffers) -> None:
        """Take another summary in."""
        if k != self.k:
            raise ValueError("summaries of different buffer sizes do not combine")
        self.n += n
        self.rank_error += rank_error
        for b in buffers:
            values = np.asarray(b["values"], dtype=float)
            if b["level"] == 0 and len(values) < k:
                self._fill(values)
            else:
                self._push(int(b["level"]), values)

    def row(self) -> tuple:
        buffers = [{"level": l, "values": b.tolist()} for l in sorted(self.full) for b in self.full[l]]
        if len(self.partial):
            buffers.append({"level": 0, "values": np.sort(self.partial).tolist()})
        return self.k, self.n, self.rank_error, self.turn, buffers


def ask(n: int, buffers, quantiles=QUANTILES) -> list[float | None]:
    """Values of the asked percentiles."""
    if not n:
        return [None] * len(quantiles)
    values = np.concatenate([np.asarray(b["values"], dtype=float) for b in buffers])
    weights = np.concatenate([np.full(len(b["values"]), 2.0 ** b["level"]) for b in buffers])
    order = np.argsort(values, kind="stable")
    reached = np.cumsum(weights[order])
    at = [min(int(np.searchsorted(reached, max(1.0, np.ceil(q * n - 1e-9)))), len(order) - 1) for q in quantiles]
    return [float(values[order[i]]) for i in at]


def valid(value: Column) -> Column:
    """A value that counts."""
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < F.lit(float("inf")))


def _summary_frame(groups: dict, columns: list[str]) -> pd.DataFrame:
    rows = [(*key, *s.row()) for key, s in groups.items()]
    return pd.DataFrame(rows, columns=[*columns, "k", "n", "rank_error", "turn", "buffers"])


def _positions(batch: pd.DataFrame, keys: list[str]):
    """(first row, rows) of each group of a batch, nulls being a value like others."""
    codes = np.zeros(len(batch), dtype=np.int64)
    for c in keys:
        own, uniques = pd.factorize(batch[c], use_na_sentinel=False)
        codes = codes * max(1, len(uniques)) + own
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(order)]):
        yield order[a], order[a:b]


def summaries(df: DataFrame, keys: list[str], value: str, k: int = K, held: int = 20_000) -> DataFrame:
    """One summary for each group of keys in every task's part of df; combine() merges them.

    Rows are summarised where they are, without a shuffle, in tasks that hold at most `held`
    groups at a time (what exceeds it is given out early).
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", " + SUMMARY

    def run(batches):
        groups: dict = {}
        for batch in batches:
            values = batch["_value"].to_numpy(dtype=float)
            columns = [batch[c] for c in keys]
            for first, rows in _positions(batch, keys):
                key = tuple(None if pd.isna(c.iat[first]) else c.iat[first] for c in columns)
                own = values[rows]
                groups.setdefault(key, Summary(k)).add(own[~np.isnan(own)])
            if len(groups) > held:
                yield _summary_frame(groups, keys)
                groups = {}
        if groups:
            yield _summary_frame(groups, keys)

    counted = F.when(valid(F.col(value).cast("double")), F.col(value).cast("double"))
    return df.select(*keys, counted.alias("_value")).mapInPandas(run, schema)


def combine(parts: DataFrame, keys: list[str], deal: int = 0) -> DataFrame:
    """Summaries of the same group merged into one.

    deal > 0 merges in two levels: first what comes from every deal-th partition, then the
    results, for inputs whose groups lie in very many partitions.
    """
    kinds = dict(parts.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", " + SUMMARY

    def run(batches):
        groups: dict = {}
        for batch in batches:
            columns = [batch[c] for c in keys]
            for i, r in enumerate(zip(batch["k"], batch["n"], batch["rank_error"], batch["turn"], batch["buffers"])):
                key = tuple(None if pd.isna(c.iat[i]) else c.iat[i] for c in columns)
                if groups and key not in groups:  # rows come sorted by group
                    yield _summary_frame(groups, keys)
                    groups = {}
                groups.setdefault(key, Summary(int(r[0]))).merge(*r)
        if groups:
            yield _summary_frame(groups, keys)

    def level(df: DataFrame, by: list[str]) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions(*by, F.desc("n"), "rank_error").select(*df.columns).mapInPandas(run, schema)

    if deal:
        parts = level(parts.withColumn("_deal", F.pmod(F.spark_partition_id(), F.lit(deal))), [*keys, "_deal"])
    return level(parts, keys)


def percentiles(parts: DataFrame, keys: list[str], quantiles=QUANTILES) -> DataFrame:
    """keys, n, p50, p90, ..., rank_error and rank_error_share of summaries."""
    names = [f"p{round(q * 100)}" for q in quantiles]

    @F.pandas_udf(", ".join(f"{c} double" for c in names))
    def read(n: pd.Series, buffers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ask(a, b, quantiles) for a, b in zip(n, buffers)], columns=names, dtype=float)

    return parts.withColumn("p", read("n", "buffers")).select(
        *keys,
        "n",
        *[F.col(f"p.{c}").alias(c) for c in names],
        "rank_error",
        (F.col("rank_error") / F.greatest(F.col("n"), F.lit(1))).alias("rank_error_share"),
    )


def once(df: DataFrame, identity: str, group: str, keep: list[str], hot_share: float = 0.01) -> DataFrame:
    """Columns `keep` of df's distinct deliveries, partitioned by group, hot groups spread.

    A delivery is known by its group and identity; rows without identity all stay. Groups with
    more than hot_share of all rows, of which there are at most 1 / hot_share, are spread over
    all partitions by identity; every other group lies in one partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = df.count()
    hot = (
        df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_share * total).select(F.col(group).alias("_hot"))
    )
    columns = list(dict.fromkeys([group, identity, *keep]))
    spread = (
        df.select(*columns)
        .join(F.broadcast(hot), F.col(group).eqNullSafe(F.col("_hot")), "left")
        .withColumn("_known", F.when(F.col(identity).isNull(), F.monotonically_increasing_id()))
        .withColumn("_part", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(identity, "_known"), F.lit(n))).otherwise(0))
        .drop("_hot")
    )
    return spread.repartition(group, "_part").dropDuplicates([group, "_part", identity, "_known"]).select(*keep)
