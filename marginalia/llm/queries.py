"""Queries of the training-data operators over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import sql
from ..session import cut_lineage, spread, table
from . import encoding, group_split, lookalike, mixing, overlap, quantiles, subjects


def _forms(spark: SparkSession, d: str) -> DataFrame:
    texts = lookalike.question_and_block_texts(table(spark, d, "evidence_audit"), table(spark, d, "canonical_documents"))
    return lookalike.canonical_forms(texts, ["kind", "key"], "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of questions or of blocks that look the same and differ in characters."""
    return lookalike.alike_pairs(_forms(spark, d))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every question and block with its form."""
    return _forms(spark, d).select("kind", "key", "form")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Questions and blocks whose form occurs in several spellings, with the number of their links."""
    return lookalike.alike_classes(_forms(spark, d)).select("kind", "key", "class", "texts", "rows", "links")


def _figure_pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, d, "figure_results"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Train and held-out figure records with nearly the same question and caption."""
    return _figure_pairs(spark, d).select("id_a", "id_b").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per held-out split and source, next to the published claims."""
    pairs = _figure_pairs(spark, d)
    return overlap.split_report(table(spark, d, "figure_results"), pairs, table(spark, d, "external_summary"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """Held-out records with the number of their copies in train and the most they share with one."""
    return overlap.record_overlaps(_figure_pairs(spark, d))


def _grouped(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return group_split.groups(table(spark, d, "retrieval_results"), keep=["result_id", *keep])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every retrieval result with the smallest id of its group."""
    return _grouped(spark, d)


def _split(spark: SparkSession, d: str) -> DataFrame:
    rows = cut_lineage(_grouped(spark, d, "method"))
    return rows.join(group_split.stratified_splits(rows), "group_id")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every retrieval result with its group and split."""
    return _split(spark, d).select("result_id", "group_id", "split")


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Reached share of each split, per method."""
    return group_split.split_shares(_split(spark, d))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the latency of each paper, with their proven rank error."""
    rows = quantiles.once(table(spark, d, "page_measurements"), "measurement_id", "paper_id", ["paper_id", "latency_seconds"])
    parts = quantiles.combine(quantiles.summaries(rows, ["paper_id"], "latency_seconds"), ["paper_id"])
    return quantiles.percentiles(parts, ["paper_id"])


def p5_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each run, and of all runs (run_id null) combined from the runs' summaries."""
    rows = quantiles.once(table(spark, d, "page_measurements"), "measurement_id", "paper_id", ["run_id", "latency_seconds"])
    runs = cut_lineage(quantiles.combine(quantiles.summaries(rows.where("run_id is not null"), ["run_id"], "latency_seconds"), ["run_id"], deal=16))
    every = quantiles.combine(runs.withColumn("run_id", F.lit(None).cast("string")), ["run_id"])
    return quantiles.percentiles(runs.unionByName(every), ["run_id"])


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", encoding.token_ids("text").alias("ids"))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return mixing.Mix(docs, table(spark, d, "source_weights"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of documents that make up each block of the mixed output."""
    return _mix(spark, d).pieces()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return _mix(spark, d).shares()


def _subjects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    docs = table(spark, d, "documents").select("doc_id", "text", "paper_id")
    names = [r[0] for r in table(spark, d, "subjects").select("subject").where("subject is not null").distinct().orderBy("subject").collect()]
    return docs, subjects.document_subjects(docs, table(spark, d, "subject_labels"), names), names


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document with each subject it deals with."""
    return _subjects(spark, d)[1].select("doc_id", "subject")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of each subject in the corpus."""
    docs, found, names = _subjects(spark, d)
    return subjects.subject_shares(docs, found, names)


QUERIES = {
    "p1_found": p1_found,
    "p1_forms": p1_forms,
    "p1_classes": p1_classes,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p3_records": p3_records,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p4_shares": p4_shares,
    "p5_percentiles": p5_percentiles,
    "p5_by_run": p5_by_run,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
}
# connected papers by closure over the questions they share: for the small tables of the SQL check
_NODES_SQL = f"""
    WITH RECURSIVE k AS (SELECT result_id, {sql.paper_key('paper_id')} AS p, {sql.real_id('question_id')} AS q FROM retrieval_results),
    pq AS (SELECT DISTINCT p, q FROM k WHERE p IS NOT NULL AND q IS NOT NULL),
    tie AS (SELECT DISTINCT a.p AS a, b.p AS b FROM (SELECT q, min(p) AS p FROM pq GROUP BY q) a JOIN pq b USING (q) WHERE a.p <> b.p),
    both_ AS (SELECT a, b FROM tie UNION SELECT b, a FROM tie),
    reach AS (SELECT DISTINCT p AS a, p AS b FROM k WHERE p IS NOT NULL UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON both_.a = reach.b),
    comp AS (SELECT a AS p, min(b) AS c FROM reach GROUP BY a),
    home AS (SELECT q, min(p) AS p FROM pq GROUP BY q),
    n AS (SELECT result_id, CASE WHEN coalesce(k.p, home.p) IS NOT NULL THEN 'paper ' || comp.c WHEN k.q IS NOT NULL THEN 'question ' || k.q ELSE 'row ' || result_id END AS node
      FROM k LEFT JOIN home ON home.q = k.q LEFT JOIN comp ON comp.p = coalesce(k.p, home.p))
"""
SQL: dict[str, str] = {"p4_found": _NODES_SQL + "SELECT result_id, min(result_id) OVER (PARTITION BY node) AS group_id FROM n"}
