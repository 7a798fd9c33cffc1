"""Readers of annotation XML, JSON, JSON lines and archives, and the sinks beside them."""

from __future__ import annotations

import json
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import last_written, running_before

BOX = "STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>"
VOC = f"filename STRING, object ARRAY<STRUCT<name: STRING, bndbox: {BOX}>>"


# How pages are named, by archive number or by page and table.
ARCHIVED = r"(?i)^(PMC\d+)_\d+$"
NUMBERED = r"(?i)[_-](?:page|table)[_-]?\d+"
PAGE = r"(?i)(?:[_-]page[_-]?|^PMC\d+_)(\d+)$"


def file_stem(path: Column) -> Column:
    """File name without folders and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def document_id(name: Column) -> Column:
    """Document of a page file: its archive number if it has one, else what precedes page or table."""
    stem = file_stem(name)
    official = F.regexp_extract(stem, ARCHIVED, 1)
    return F.when(official != "", official).otherwise(F.element_at(F.split(stem, NUMBERED, 2), 1))


def page_index(name: Column) -> Column:
    """Page number in a page file's name, null if there is none."""
    found = F.regexp_extract(file_stem(name), PAGE, 1)
    return F.when(found != "", found.cast("int"))


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a split file, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def voc_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, document_id, page_index, objects) of annotation files, one page each."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_xml("value", VOC).alias("x"))
    name = F.coalesce("x.filename", F.concat(file_stem(F.col("path")), F.lit(".jpg")))
    return raw.select(
        "path",
        name.alias("filename"),
        document_id(name).alias("document_id"),
        page_index(name).alias("page_index"),
        F.coalesce("x.object", F.array().cast(f"ARRAY<STRUCT<name: STRING, bndbox: {BOX}>>")).alias("objects"),
    )


def table_boxes(objects: Column) -> Column:
    """Boxes of the objects named table, as arrays."""
    tables = F.filter(objects, lambda o: (F.lower(o["name"]) == "table") & o["bndbox"].isNotNull())
    return F.transform(tables, lambda o: F.array(*[F.coalesce(o["bndbox"][k], F.lit(0.0)) for k in ("xmin", "ymin", "xmax", "ymax")]))


def page_subset(pages: DataFrame, seed: int, limit: int, excluded: DataFrame | None = None, one_per_document: bool = True) -> DataFrame:
    """The first `limit` pages in a seeded hash order, documents of excluded(document_id) left out.

    one_per_document keeps the first page of each document in that order.
    """
    p = pages if excluded is None else pages.join(excluded.select("document_id").distinct(), "document_id", "left_anti")
    p = p.withColumn("_o", F.sha2(F.concat_ws(":", F.lit(str(seed)), "filename"), 256))
    if one_per_document:
        rest = [c for c in p.columns if c != "document_id"]
        p = p.groupBy("document_id").agg(F.min_by(F.struct(*rest), "_o").alias("r")).select("document_id", "r.*")
    return running_before(p, [F.col("_o"), F.col("filename")]).where(F.col("before") < limit).drop("_o", "before")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file with a stated schema; no inference pass."""
    return spark.read.schema(schema).json(path, multiLine=True)


def prediction_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their file and place; broken lines are kept apart in _corrupt, blank ones dropped.

    (path, place) orders the lines of a file as written: the place is where the block of the file
    starts and the line's place within it.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), place.alias("place"), "value").where(F.trim("value") != "")
    read = F.from_json("value", f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    return lines.select("path", "place", read.alias("x")).select("path", "place", "x.*")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def latest_predictions(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last written prediction of each key."""
    return last_written(lines, keys, order)


def latest_runs(runs: DataFrame) -> DataFrame:
    """(offset, path) of the latest run of each offset from 0, by run id as text."""
    return runs.where(F.col("offset") >= 0).groupBy("offset").agg(F.max_by("path", "run_id").alias("path"))


def _opened(path: str):
    """A file of any file system that Arrow knows, for reading at any place."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(inner)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """(path) of archives, one task each where there are cores for it; their bytes are not read here."""
    found = spark.read.format("binaryFile").load(path).select("path")
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


def archive_json(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(path, key, value) of a JSON object kept as a member of tar.gz archives, values as JSON text.

    One task streams one archive up to the member; a missing member gives nothing.
    """

    def run(batches):
        for batch in batches:
            for p in batch["path"]:
                with _opened(p) as f, tarfile.open(fileobj=f, mode="r|gz") as bundle:
                    for entry in bundle:
                        if entry.name == member:
                            data = json.load(bundle.extractfile(entry))
                            yield pd.DataFrame({"path": p, "key": list(data), "value": [json.dumps(v, ensure_ascii=False) for v in data.values()]})
                            break

    return _archives(spark, path).mapInPandas(run, "path string, key string, value string")


def split_of_archive(spark: SparkSession, path: str, split: str, members: dict[str, str]) -> DataFrame:
    """archive_json of the member that holds a split; ValueError for a split that is not among them."""
    if split not in members:
        raise ValueError(f"no split {split!r} among {sorted(members)}")
    return archive_json(spark, path, members[split])


def zip_members(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, name, bytes) of the members of zip archives; bytes are null unless asked for, and then only the directory is read."""

    def run(batches):
        for batch in batches:
            for p in batch["path"]:
                with _opened(p) as f, zipfile.ZipFile(f) as z:
                    for name in z.namelist():
                        yield pd.DataFrame({"path": [p], "name": [name], "bytes": [z.read(name) if content else None]})

    return _archives(spark, path).mapInPandas(run, "path string, name string, bytes binary")


def write_json_lines(df: DataFrame, path: str) -> None:
    """Replace a folder of JSON lines; the committer makes it appear whole."""
    df.write.mode("overwrite").json(path)


def write_ids(df: DataFrame, column: str, path: str) -> None:
    """Replace a text manifest of ids."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def append_results(df: DataFrame, path: str) -> None:
    """Append finished work to a checkpoint table."""
    df.write.mode("append").parquet(path)


def by_status(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(successes, failures): failures are rows with an error, kept beside the others."""
    return df.where(F.col(error).isNull()), df.where(F.col(error).isNotNull())
