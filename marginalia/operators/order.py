"""Global ranks and running sums without a single-task window.

Rows are range-partitioned by the order, summed up per partition, and only the partitions'
totals (one row each) meet in one place. The order must be total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def running_sums(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its value over all rows that come before a row."""
    keys, amounts = [f"_o{i}" for i in range(len(order))], [f"_a{i}" for i in range(len(values))]
    placed = df.withColumns(dict(zip(keys, order))).withColumns(dict(zip(amounts, values.values())))
    placed = cut_lineage(placed.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*[F.sum(a).alias(a) for a in amounts])  # one row for each partition
    bases = totals.select("_part", *[F.coalesce(F.sum(a).over(upto), F.lit(0)).alias(f"_b{a}") for a in amounts])
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(bases), "_part")
        .withColumns({n: F.col(f"_b{a}") + F.coalesce(F.sum(a).over(inside), F.lit(0)) for n, a in zip(values, amounts)})
        .drop("_part", *keys, *amounts, *[f"_b{a}" for a in amounts])
    )


def running_before(df: DataFrame, order: list[Column], value: Column | int = 1, name: str = "before") -> DataFrame:
    """df with the sum of value, or the number of rows, before a row in the order."""
    return running_sums(df, order, {name: F.lit(value) if isinstance(value, int) else value})


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= n)


def last_written(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in order; an aggregation, not a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(
        *keys, *[F.col("_r")[c].alias(c) for c in rest]
    )
