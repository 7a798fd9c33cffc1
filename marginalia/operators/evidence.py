"""Paragraphs of papers, mapping of evidence to them, and of paragraphs to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import evidence_form, tokens
from .order import top_per

#: Fixed value: the marker that stands for a figure or table among evidence strings.
FLOAT_MARKER = "FLOAT SELECTED"


def paper_paragraphs(papers: DataFrame) -> DataFrame:
    """(paper_id, idx, section, paragraph): the abstract, then the sections' paragraphs, blanks dropped.

    papers(paper_id, title, abstract, full_text ARRAY<STRUCT<section_name, paragraphs>>).
    """
    texts = F.flatten(
        F.transform(
            F.coalesce("full_text", F.array().cast("array<struct<section_name:string,paragraphs:array<string>>>")),
            lambda s: F.transform(
                F.coalesce(s["paragraphs"], F.array().cast("array<string>")),
                lambda p: F.struct(s["section_name"].alias("section"), p.alias("paragraph")),
            ),
        )
    )
    first = F.array(F.struct(F.lit("Abstract").alias("section"), F.coalesce("abstract", F.lit("")).alias("paragraph")))
    kept = F.filter(F.concat(first, texts), lambda x: F.coalesce(evidence_form(x["paragraph"]) != "", F.lit(False)))
    return papers.select("paper_id", "title", F.posexplode(kept).alias("idx", "x")).select(
        "paper_id", "title", "idx", F.col("x.section").alias("section"), F.col("x.paragraph").alias("paragraph")
    )


def in_context(title: Column, section: Column, paragraph: Column) -> Column:
    """A paragraph with its paper's title and its section."""
    return F.concat(
        F.lit("Title: "), F.trim(F.coalesce(title, F.lit(""))), F.lit("\nSection: "), F.coalesce(section, F.lit("")), F.lit("\n"), paragraph
    )


def answerable(questions: DataFrame) -> DataFrame:
    """Questions with at least one annotation that is not marked unanswerable."""
    return questions.where(F.exists("answers", lambda a: ~F.coalesce(a["answer"]["unanswerable"], F.lit(False))))


def evidence_of(questions: DataFrame) -> DataFrame:
    """(paper_id, question_id, pos, item) of the evidence of answerable annotations."""
    items = F.flatten(
        F.transform(
            F.filter("answers", lambda a: ~F.coalesce(a["answer"]["unanswerable"], F.lit(False))),
            lambda a: F.coalesce(a["answer"]["evidence"], F.array().cast("array<string>")),
        )
    )
    return questions.select("paper_id", "question_id", F.posexplode(items).alias("pos", "item"))


def map_evidence(evidence: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(paper_id, question_id, form, item, occurrences) of each distinct evidence string.

    evidence(paper_id, question_id, pos, item), paragraphs(paper_id, paragraph). Strings are
    compared by evidence_form; of equal ones the last spelling stays. Markers and blanks are
    left out.
    """
    counts = (
        paragraphs.select("paper_id", evidence_form("paragraph").alias("form"))
        .where("form <> ''")
        .groupBy("paper_id", "form")
        .agg(F.count("*").alias("n"))
    )
    marker = F.lit(FLOAT_MARKER.casefold())
    distinct = (
        evidence.select("paper_id", "question_id", "pos", "item", evidence_form("item").alias("form"))
        .where((F.col("form") != "") & (F.col("form") != marker))
        .groupBy("paper_id", "question_id", "form")
        .agg(F.max_by("item", "pos").alias("item"))
    )
    return distinct.join(counts, ["paper_id", "form"], "left").select(
        "paper_id", "question_id", "form", "item", F.coalesce("n", F.lit(0)).cast("long").alias("occurrences")
    )


def relevant_positions(evidence: DataFrame, paragraphs: DataFrame, place: list[str]) -> DataFrame:
    """(paper_id, question_id, relevant): the places, sorted, of the paragraphs that equal an evidence string.

    evidence(paper_id, question_id, item), paragraphs(paper_id, paragraph, *place). Compared by
    evidence_form; markers and blanks are left out; every occurrence counts; a question whose
    evidence is nowhere has no row.
    """
    marker = F.lit(FLOAT_MARKER.casefold())
    asked = evidence.select("paper_id", "question_id", evidence_form("item").alias("form")).where((F.col("form") != "") & (F.col("form") != marker)).distinct()
    held = paragraphs.select("paper_id", F.struct(*place).alias("place"), evidence_form("paragraph").alias("form")).where("form <> ''")
    return asked.join(held, ["paper_id", "form"]).groupBy("paper_id", "question_id").agg(F.array_sort(F.collect_list("place")).alias("relevant"))


def audit(questions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """One row for each answerable question: evidence type and unique, tied and unmapped counts."""
    asked = answerable(questions)
    evidence = evidence_of(asked)
    floats = evidence.groupBy("paper_id", "question_id").agg(
        F.bool_or(evidence_form("item") == F.lit(FLOAT_MARKER.casefold())).alias("has_float")
    )
    n = F.col("occurrences")
    mapped = map_evidence(evidence, paragraphs).groupBy("paper_id", "question_id").agg(
        F.count("*").alias("textual"), F.count_if(n == 1).alias("unique_n"), F.count_if(n > 1).alias("tied"), F.count_if(n == 0).alias("unmapped")
    )
    keys = ["paper_id", "question_id"]
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("textual", "unique_n", "tied", "unmapped")]
    has = F.coalesce("has_float", F.lit(False))
    return (
        asked.select(*keys).join(mapped, keys, "left").join(floats, keys, "left")
        .select(*keys, has.alias("has_float"), *zero)
        .select(
            *keys,
            F.when(F.col("has_float") & (F.col("textual") > 0), "mixed").when(F.col("has_float"), "figure_or_table").otherwise("paragraph").alias("evidence_type"),
            F.col("textual").alias("textual_evidence_count"),
            (F.col("unique_n") + F.col("tied")).alias("mapped_textual_evidence_count"),
            F.col("unique_n").alias("unique_mapping_count"),
            F.col("tied").alias("tied_mapping_count"),
            F.col("unmapped").alias("unmapped_count"),
        )
    )


def map_to_pages(
    paragraphs: DataFrame, pages: DataFrame, min_coverage: float = 0.8, min_margin: float = 0.1
) -> DataFrame:
    """(document, paragraph_id, status, page, coverage, margin) of every paragraph with text.

    paragraphs(document, paragraph_id, form), pages(document, page, form), forms being
    normalised text. One page that contains the paragraph: exact; several: ambiguous; else the
    page with the best token coverage if it is high and clear enough: approximate; else
    ambiguous or unmapped. Paragraphs of documents without pages are unmapped.
    """
    p = paragraphs.where(F.col("form") != "").select("document", "paragraph_id", "form", tokens("form").alias("t"))
    g = pages.select("document", "page", F.coalesce("form", F.lit("")).alias("page_form"))

    def counts(df: DataFrame, *keys: str) -> DataFrame:
        return df.select("document", *keys, F.explode("t").alias("token")).groupBy("document", *keys, "token").agg(F.count("*").alias("n"))

    # multisets of tokens meet on their tokens, so that a paragraph and a page are compared by what they share
    asked = counts(p, "paragraph_id")
    held = counts(g.select("document", "page", tokens("page_form").alias("t")), "page").withColumnRenamed("n", "m")
    shared = (
        asked.join(held, ["document", "token"])
        .groupBy("document", "paragraph_id", "page")
        .agg(F.sum(F.least("n", "m")).alias("shared"))
    )
    pairs = (
        p.select("document", "paragraph_id", "form", F.size("t").alias("total"))
        .join(g, "document", "left")
        .select("document", "paragraph_id", "page", "total", F.coalesce(F.contains("page_form", "form"), F.lit(False)).alias("inside"))
        .join(shared, ["document", "paragraph_id", "page"], "left")
        .withColumn("coverage", F.when(F.col("total") > 0, F.coalesce("shared", F.lit(0)) / F.col("total")).otherwise(0.0))
    )
    keys = ["document", "paragraph_id"]
    order = Window.partitionBy(*keys).orderBy(F.round("coverage", 9).desc(), F.col("page"))
    best = pairs.withColumn("r", F.row_number().over(order)).groupBy(*keys).agg(
        F.count_if("inside").alias("n"),
        F.min(F.when(F.col("inside"), F.col("page"))).alias("exact_page"),
        F.max(F.when(F.col("r") == 1, F.col("page"))).alias("best_page"),
        F.coalesce(F.max(F.when(F.col("r") == 1, F.col("coverage"))), F.lit(0.0)).alias("best"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col("coverage"))), F.lit(0.0)).alias("second"),
    )
    margin = F.round(F.col("best") - F.col("second"), 9)
    near = (F.round("best", 9) >= min_coverage) & (margin >= min_margin)
    status = (
        F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").when(near, "approximate").when(F.round("best", 9) >= min_coverage, "ambiguous").otherwise("unmapped")
    )
    return best.select(
        *keys,
        status.alias("status"),
        F.when(F.col("n") == 1, F.col("exact_page")).when((F.col("n") == 0) & near, F.col("best_page")).cast("long").alias("page"),
        F.when(F.col("n") > 0, 1.0).otherwise(F.round("best", 9)).alias("coverage"),
        F.when(F.col("n") == 1, 1.0).when(F.col("n") > 1, 0.0).otherwise(margin).alias("margin"),
    )


def pages_of_ranking(ranking: DataFrame, mapping: DataFrame, query: list[str], limit: int) -> DataFrame:
    """(query, page, rank): pages in the order in which a ranking of paragraphs first meets them.

    ranking(query, paragraph_id, rank), mapping(query's corpus columns, paragraph_id, page).
    """
    shared = [c for c in mapping.columns if c in ranking.columns]
    met = (
        ranking.join(mapping.where(F.col("page").isNotNull()), shared)
        .groupBy(*query, "page")
        .agg(F.min("rank").alias("first"))
    )
    return top_per(met, query, [F.col("first"), F.col("page")], limit).drop("first")
