"""Incremental parsing of a page work list, an extension: batches of new work as a stream.

Work that arrives again within the watermark is dropped by its cache key; each micro-batch
parses only what the results table lacks and appends to it, so a restart repeats nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cost import pending
from ..sources.files import append_results
from ..sources.parsers import parse_documents


def new_work(stream: DataFrame, key: str, arrived: str, delay: str = "1 hour") -> DataFrame:
    """A work stream without repeats of a key within the watermark."""
    return stream.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([key])


def _known(spark: SparkSession, results: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.parquet(results)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)  # nothing written yet


def ingest(stream: DataFrame, results: str, checkpoint: str, parser: str = "text", once: bool = True):
    """Start parsing stream(document_id, content, arrived) into the Parquet folder results."""

    def batch(df: DataFrame, _id: int) -> None:
        todo = pending(df, _known(df.sparkSession, results, df).select("document_id"), ["document_id"])
        append_results(parse_documents(todo, "document_id", "content", parser), results)

    writer = (
        new_work(stream, "document_id", "arrived")
        .select("document_id", "content")
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def latency_windows(stream: DataFrame, at: str, value: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, n, mean) of a measurement stream over tumbling windows; later rows are dropped."""
    return (
        stream.withWatermark(at, delay)
        .groupBy(F.window(at, width).alias("w"))
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
        .select(F.col("w.start").alias("start"), "n", "mean")
    )
