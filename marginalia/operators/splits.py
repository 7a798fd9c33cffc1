"""Deterministic splits, whole-group allocation, balanced samples and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import paper_id_form
from .order import running_before, top_per


def hash_split(df: DataFrame, group: str, train: float, seed: int = 7) -> DataFrame:
    """(group, split): groups in the order of the SHA-256 of "seed:group", the first share being train.

    The cut is the rounded share, half to even, with at least one group on each side.
    """
    groups = df.where(F.col(group).isNotNull()).select(group).distinct()
    ranked = running_before(groups, [F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")), 256), F.col(group)])
    n = groups.count()
    cut = max(1, min(n - 1, round(n * train)))
    return ranked.select(group, F.when(F.col("before") < cut, "train").otherwise("calibration").alias("split"))


def whole_groups(df: DataFrame, group: str, minimum: int, size: str | None = None) -> DataFrame:
    """(group, size, selected): groups in their order are taken whole until the minimum is reached."""
    sizes = df.groupBy(group).agg((F.sum(size) if size else F.count("*")).cast("long").alias("size"))
    placed = running_before(sizes, [F.col(group)], F.col("size"))
    return placed.select(group, "size", (F.col("before") < minimum).alias("selected"))


def balanced_sample(df: DataFrame, kind: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each kind."""
    return top_per(df, [kind], [F.col(c) for c in order], n, "place")


def window_of(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows at places offset .. offset + limit - 1 of the order."""
    return running_before(df, [F.col(c) for c in order]).where(
        (F.col("before") >= offset) & (F.col("before") < offset + limit)
    )


def manifest(
    rows: DataFrame, excluded_papers: DataFrame, excluded_types: list[str], members: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(corpus, queries) of figure questions.

    rows(query_id, paper_id, figure, caption, question, type). Rows of excluded papers
    (paper), of excluded types or whose figure is not among members(figure) are left out. The
    first row of a figure, by query_id, describes it; corpus_index is its place by name.
    """
    kept = rows.where(F.col("figure").isNotNull() & F.col("query_id").isNotNull()).withColumn("paper", paper_id_form("paper_id"))
    kept = kept.join(excluded_papers.select("paper").distinct(), "paper", "left_anti")
    if excluded_types:
        kept = kept.where(~F.coalesce(F.col("type").isin(*excluded_types), F.lit(False)))
    if members is not None:
        kept = kept.join(members.select("figure").distinct(), "figure", "left_semi")
    first = kept.groupBy("figure").agg(F.min_by(F.struct("caption", "paper"), "query_id").alias("d"))
    corpus = running_before(first, [F.col("figure")]).select(
        F.col("before").cast("long").alias("corpus_index"), "figure", F.col("d.caption").alias("caption"), F.col("d.paper").alias("paper")
    )
    queries = kept.join(corpus.select("figure", "corpus_index"), "figure").select(
        "query_id", "question", "figure", "paper", "type", F.col("corpus_index").alias("relevant_index")
    )
    return corpus, queries


def multi_manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corpus, queries) where a question refers to several figures.

    rows(paper_id, questions, question_ids, references, figures): parallel arrays and the map
    of a paper's figures to captions. A question that refers to no figure of its paper fails
    the job, as an unanswerable manifest must.
    """
    named = rows.select("paper_id", F.explode("figures").alias("figure", "caption"))
    corpus = running_before(named, [F.col("paper_id"), F.col("figure")]).select(
        F.col("before").cast("long").alias("corpus_index"), "paper_id", "figure", "caption"
    )
    asked = rows.select(
        "paper_id", F.explode(F.arrays_zip("questions", "question_ids", "references")).alias("q")
    ).select("paper_id", F.col("q.question_ids").alias("query_id"), F.col("q.questions").alias("question"), F.col("q.references").alias("figures"))
    found = (
        asked.select("paper_id", "query_id", F.explode("figures").alias("figure"))
        .join(corpus, ["paper_id", "figure"])
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_set("corpus_index")).alias("relevant"))
    )
    checked = F.when(F.coalesce(F.size("relevant"), F.lit(0)) > 0, F.col("relevant")).otherwise(
        F.raise_error(F.concat(F.lit("no relevant figure for "), F.col("query_id"))).cast("array<bigint>")
    )
    return corpus, asked.join(found, "query_id", "left").select("query_id", "paper_id", "question", checked.alias("relevant_indices"))


def eligible_by_paper(papers: DataFrame, members: DataFrame, excluded: DataFrame, types: tuple[str, ...] = ("table", "figure")) -> DataFrame:
    """(paper_id, qa_index, question, reference, content_type) of the questions that a paper may contribute.

    papers(paper_id, qa ARRAY<STRUCT<question, reference>>, all_figures MAP<STRING, STRUCT<content_type,
    ...>>), members(paper_id, reference): figures that are stored, excluded(paper_id). A question
    stays if its figure is one of the paper's, of one of the types, and stored.
    """
    asked = papers.join(excluded.select("paper_id").distinct(), "paper_id", "left_anti").select("paper_id", "all_figures", F.posexplode("qa").alias("qa_index", "qa"))
    kind = F.try_element_at("all_figures", F.col("qa.reference"))["content_type"]
    rows = asked.where(F.col("qa.reference").isNotNull()).select("paper_id", "qa_index", "qa.question", "qa.reference", kind.alias("content_type"))
    return rows.where(F.col("content_type").isin(*types)).join(members.select("paper_id", "reference").distinct(), ["paper_id", "reference"], "left_semi")


def shared_groups(df: DataFrame, group: Column, split: str = "split") -> DataFrame:
    """(split_a, split_b, shared): groups that two splits have in common, for pairs that share any."""
    g = df.select(group.alias("g"), F.col(split).alias("s")).where("g is not null and s is not null").distinct()
    per = g.groupBy("g").agg(F.sort_array(F.collect_set("s")).alias("in"))  # at most one entry for each split
    pair = F.explode(
        F.filter(
            F.flatten(F.transform("in", lambda a: F.transform("in", lambda b: F.struct(a.alias("a"), b.alias("b"))))),
            lambda p: p["a"] < p["b"],
        )
    )
    return per.select(pair.alias("p")).groupBy(F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")).agg(F.count("*").alias("shared"))
