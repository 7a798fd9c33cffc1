"""Percentiles, paired tests and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running_before


def nearest_rank(df: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """keys, n and, for each fraction f, the value at place round((n - 1) f) from 0, half to even.

    Rows are ranked over range partitions; no group is gathered in one task. Null values and
    null keys are left out; without values there is no row.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    per = rows.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    ranked = running_before(per, [F.col(k) for k in keys] + [F.col("v")], F.col("c"))
    groups = ranked.groupBy(*keys).agg(F.min("before").alias("start"), F.sum("c").alias("n"))
    placed = ranked.join(groups, keys) if keys else ranked.crossJoin(F.broadcast(groups))  # one row
    at = F.col("before") - F.col("start")
    outs = []
    for f in fractions:
        want = F.bround((F.col("n") - 1) * F.lit(f)).cast("long")
        outs.append(F.max(F.when((at <= want) & (want < at + F.col("c")), F.col("v"))).alias(f"p{round(f * 100)}"))
    return placed.groupBy(*keys, "n").agg(*outs)


def bucket(value: Column, bounds: tuple, names: tuple[str, ...]) -> Column:
    """The name of the first bucket whose upper bound a value does not exceed, the last name beyond all; unknown for null."""
    out = F.when(value.isNull(), "unknown")
    for b, name in zip(bounds, names):
        out = out.when(value <= b, name)
    return out.otherwise(names[len(bounds)])


def mcnemar(worse: Column, better: Column) -> Column:
    """Exact two-sided p of discordant counts; 1 without any. Summed in logarithms."""
    d = worse + better
    start = F.struct((-d * F.log(F.lit(2.0))).alias("l"), F.lit(0.0).alias("s"))
    fold = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.least(worse, better)),
        start,
        lambda a, i: F.when(i == 0, F.struct(a["l"].alias("l"), F.exp(a["l"]).alias("s"))).otherwise(
            F.struct(
                (a["l"] + F.log((d - i + 1) / F.greatest(i, F.lit(1)))).alias("l"),
                (a["s"] + F.exp(a["l"] + F.log((d - i + 1) / F.greatest(i, F.lit(1))))).alias("s"),
            )
        ),
        lambda a: F.least(F.lit(1.0), 2.0 * a["s"]),
    )
    return F.when(d > 0, fold).otherwise(F.lit(1.0))


# Cumulative Poisson(1) probabilities, from which a row's weight in a replicate is read.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) named by text parts: the first 32 bits of their md5."""
    digest = F.md5(F.concat_ws("-", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def bootstrap(df: DataFrame, row_id: str, value: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Mean of value and its 95 % interval over Poisson bootstrap replicates, in one row.

    Every row draws its own Poisson(1) weight in every replicate from a hash of its id, so a
    replicate needs no join with resampled places: one pass, summed up before the shuffle.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(row_id).isNotNull())
    u = uniform(F.lit(str(seed)), F.col("replicate").cast("string"), F.col(row_id).cast("string"))
    weight = sum((F.when(u >= x, 1).otherwise(0) for x in POISSON), F.lit(0))
    per = (
        rows.select(row_id, F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
        .withColumn("w", weight)
        .groupBy("replicate")
        .agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
        .where(F.col("m").isNotNull())
    )
    interval = per.agg(
        F.round(F.percentile("m", F.lit(0.025)), 9).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 9).alias("high")
    )
    return rows.agg(F.round(F.avg(value), 9).alias("mean"), F.count("*").alias("rows")).crossJoin(F.broadcast(interval))  # one row each


def paired(df: DataFrame, a: str, b: str) -> dict[str, Column]:
    """Aggregates: rows where b is better, worse, equal."""
    return {
        "better": F.count_if(F.col(b) > F.col(a)),
        "worse": F.count_if(F.col(b) < F.col(a)),
        "ties": F.count_if(F.col(b) == F.col(a)),
    }


def worst_median_best(df: DataFrame, score: str, row_id: str) -> DataFrame:
    """Rows at places 0, n // 2 and n - 1 of the order by score, then id."""
    rows = df.where(F.col(score).isNotNull())
    ranked = running_before(rows, [F.col(score), F.col(row_id)])
    n = rows.count()
    which = F.when(F.col("before") == 0, "worst").when(F.col("before") == n // 2, "median").when(F.col("before") == n - 1, "best")
    places = sorted({0, n // 2, max(0, n - 1)})
    return ranked.where(F.col("before").isin(*places)).select(which.alias("which"), row_id, score)
