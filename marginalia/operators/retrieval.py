"""Lexical, dense, late-interaction and fused rankings, candidate pools and ranking metrics.

Rankings are long tables (corpus, query, document, score, rank) in a total order: score to
nine places, descending, then document, ascending. Null texts and vectors rank nowhere.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from .order import top_per


def ranked(scores: DataFrame, query: list[str], document: str = "doc_id", n: int | None = None) -> DataFrame:
    """scores with rank from 1 within each query."""
    order = [F.round("score", 9).desc(), F.col(document).asc()]
    if n is not None:
        return top_per(scores, query, order, n)
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(*order)).cast("long"))


def bm25(
    documents: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, keep_zero: bool = False
) -> DataFrame:
    """(corpus_id, query_id, doc_id, score) by BM25 within each corpus.

    documents(corpus_id, doc_id, text), queries(corpus_id, query_id, text). A query is a set of
    terms. Term frequencies are counted once for all queries. keep_zero adds the corpus's other
    documents at score 0, without which they are left out.
    """
    d = documents.select("corpus_id", "doc_id", tokens("text").alias("t")).where(F.col("t").isNotNull())
    lengths = d.select("corpus_id", "doc_id", F.size("t").alias("dl"))
    corpora = lengths.groupBy("corpus_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = queries.select("corpus_id", "query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    wanted = asked.select("corpus_id", "term").distinct()
    tf = (
        d.select("corpus_id", "doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
        .join(wanted, ["corpus_id", "term"], "left_semi")
        .groupBy("corpus_id", "term", "doc_id", "dl")
        .agg(F.count("*").alias("tf"))
    )
    df = tf.groupBy("corpus_id", "term").agg(F.count("*").alias("df"))
    norm = F.when(
        F.col("avgdl") > 0, F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    ).otherwise(F.col("tf"))
    idf = F.log(1 + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    weights = (
        tf.join(df, ["corpus_id", "term"])
        .join(corpora, "corpus_id")
        .select("corpus_id", "term", "doc_id", (idf * F.col("tf") * (k1 + 1) / norm).alias("w"))
    )
    scores = asked.join(weights, ["corpus_id", "term"]).groupBy("corpus_id", "query_id", "doc_id").agg(F.sum("w").alias("score"))
    if not keep_zero:
        return scores
    every = queries.select("corpus_id", "query_id").distinct().join(lengths.select("corpus_id", "doc_id"), "corpus_id")
    return every.join(scores, ["corpus_id", "query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length, in doubles."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def dense(vectors: DataFrame, queries: DataFrame, start: int = 1, length: int | None = None) -> DataFrame:
    """(query_id, doc_id, score) of all pairs: for tables whose every score is wanted."""

    def part(c: Column) -> Column:
        return F.slice(c, start, length) if length else c

    v = vectors.where(F.col("embedding").isNotNull()).select("vec_id", part(F.col("embedding")).alias("v"))
    q = queries.where(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("query_id"), part(F.col("embedding")).alias("q"))
    return v.join(q, F.col("query_id") != F.col("vec_id")).select(
        "query_id", F.col("vec_id").alias("doc_id"), dot(F.col("q"), F.col("v")).alias("score")
    )


def _blocks(vectors: DataFrame, queries: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to a grid of cells, each holding about `rows` vectors of a side."""
    nv, nq = (max(1, math.ceil(x.count() / rows)) for x in (vectors, queries))
    v = vectors.select(
        "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(nv)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("j")
    )
    q = queries.select(  # own names, as both sides may stem from one table
        F.col("vec_id").alias("query_id"),
        F.col("embedding").alias("asked"),
        F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("qi"),
        F.pmod(F.xxhash64("vec_id"), F.lit(nq)).cast("int").alias("qj"),
    )
    return v, q


def search(vectors: DataFrame, queries: DataFrame, n: int | None, start: int = 1, length: int | None = None, patch: int | None = None, rows: int = 8192) -> DataFrame:
    """(query_id, doc_id, score, rank): the n best vectors for each query, itself left out, exact.

    Blocks of vectors meet blocks of queries in one matrix product each and only each block's
    n best go on, so no pair of a query and a vector leaves a task. With n None the whole
    rankings come out, from smaller blocks. start and length take a part of the vectors. patch: width of patches for late interaction, each query patch taking
    its best document patch. Rows without a vector are left out.
    """
    v, q = (x.where(F.col("embedding").isNotNull()).select("vec_id", "embedding") for x in (vectors, queries))
    v, q = _blocks(v, q, rows if n is not None else min(rows, 1024))
    stop = None if length is None else start - 1 + length

    def matrix(vectors: pd.Series) -> np.ndarray:
        return np.array([np.asarray(e, dtype=np.float64)[start - 1 : stop] for e in vectors])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, whole = {"query_id": [], "doc_id": [], "score": []}, []
        if len(left) and len(right):
            ids, asked = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
            a, b = matrix(left["embedding"]), matrix(right["asked"])
            for at in range(0, len(b), 256):
                part = b[at : at + 256]
                if patch:
                    k = a.shape[1] // patch
                    docs = a[:, : k * patch].reshape(len(a), k, patch)
                    scores = sum(
                        np.max([part[:, x * patch : (x + 1) * patch] @ docs[:, y].T for y in range(k)], axis=0) for x in range(k)
                    )
                else:
                    scores = part @ a.T
                scores = np.round(scores, 9)
                if n is None:
                    of, at_doc = np.nonzero(asked[at : at + 256, None] != ids[None, :])
                    whole.append(pd.DataFrame({"query_id": asked[at : at + 256][of], "doc_id": ids[at_doc], "score": scores[of, at_doc]}))
                    continue
                for row, one in zip(scores, asked[at : at + 256]):
                    row = np.where(ids == one, -np.inf, row)
                    m = min(n, int((row > -np.inf).sum()))
                    if m < 1:
                        continue
                    cut = np.partition(row, -m)[-m]
                    near = np.flatnonzero(row >= cut)
                    best = near[np.lexsort((ids[near], -row[near]))][:m]
                    out["query_id"] += [one] * m
                    out["doc_id"] += ids[best].tolist()
                    out["score"] += row[best].tolist()
        return (pd.concat(whole) if whole else pd.DataFrame(out)).astype({"query_id": "int64", "doc_id": "int64", "score": "float64"})

    found = v.groupBy("i", "j").cogroup(q.groupBy("qi", "qj")).applyInPandas(run, "query_id long, doc_id long, score double")
    return ranked(found, ["query_id"], n=n)


def search_signals(vectors: DataFrame, queries: DataFrame, start: int = 1, length: int | None = None, rows: int = 8192) -> DataFrame:
    """What signals() gives of all scores of each query, itself left out, without listing a score.

    A block of vectors gives, for each query of its block, the number of scores, the two highest
    and the sums of e and of e (score - highest), e being exp(score - highest); blocks are merged
    by their highest score, one row a block and query.
    """
    v, q = (x.where(F.col("embedding").isNotNull()).select("vec_id", "embedding") for x in (vectors, queries))
    v, q = _blocks(v, q, rows)
    stop = None if length is None else start - 1 + length
    names = ("query_id", "n", "m", "second", "z", "w")

    def matrix(x: pd.Series) -> np.ndarray:
        return np.array([np.asarray(e, dtype=np.float64)[start - 1 : stop] for e in x])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, asked = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
            a, b = matrix(left["embedding"]), matrix(right["asked"])
            for at in range(0, len(b), 256):
                scores = np.where(asked[at : at + 256, None] == ids[None, :], -np.inf, b[at : at + 256] @ a.T)
                n = (scores > -np.inf).sum(axis=1)
                top = -np.sort(-np.partition(scores, -min(2, scores.shape[1]), axis=1)[:, -2:], axis=1)
                second = top[:, 1] if top.shape[1] > 1 else np.full(len(top), -np.inf)
                with np.errstate(invalid="ignore"):
                    apart = np.where(scores > -np.inf, scores - top[:, :1], 0.0)
                e = np.where(scores > -np.inf, np.exp(apart), 0.0)
                out.append(pd.DataFrame(dict(zip(names, (asked[at : at + 256], n, top[:, 0], second, e.sum(axis=1), (e * apart).sum(axis=1))))))
        found = pd.concat(out) if out else pd.DataFrame({c: [] for c in names})
        found = found[found["n"] > 0].astype({"query_id": "int64", "n": "int64"})
        return found.astype({c: "float64" for c in names[2:]})

    parts = v.groupBy("i", "j").cogroup(q.groupBy("qi", "qj")).applyInPandas(run, "query_id long, n long, m double, second double, z double, w double")
    top = F.sort_array(F.flatten(F.collect_list(F.array("m", "second"))), False)  # two numbers for each block
    of = F.collect_list(F.struct("m", "z", "w"))
    merged = parts.groupBy("query_id").agg(F.sum("n").alias("candidates"), F.max("m").alias("top_score"), top[1].alias("second"), of.alias("blocks"))

    def over_blocks(value) -> Column:
        return F.aggregate("blocks", F.lit(0.0), lambda s, b: s + F.exp(b["m"] - F.col("top_score")) * value(b))

    z, w = over_blocks(lambda b: b["z"]), over_blocks(lambda b: b["w"] + b["z"] * (b["m"] - F.col("top_score")))
    n = F.col("candidates")
    entropy = F.log(F.col("z")) - F.col("w") / F.col("z") - n * F.lit(1e-12)  # of ln(p + 1e-12), to first order
    return merged.select("query_id", "candidates", "top_score", "second", z.alias("z"), w.alias("w")).select(
        "query_id",
        "candidates",
        "top_score",
        F.when(n > 1, F.col("top_score") - F.col("second")).otherwise(0.0).alias("top_margin"),
        F.when(n > 1, entropy / F.log(n)).otherwise(0.0).alias("normalized_entropy"),
    )


def with_tail(ranking: DataFrame, candidates: DataFrame, query: list[str]) -> DataFrame:
    """ranking(query, doc_id, rank) with the candidates it misses behind it, in the order of their ids."""
    listed = ranking.select(*query, "doc_id", F.col("rank").cast("long").alias("rank"))
    length = listed.groupBy(*query).agg(F.max("rank").alias("listed"))
    place = F.row_number().over(Window.partitionBy(*query).orderBy("doc_id"))
    rest = (
        candidates.select(*query, "doc_id")
        .distinct()
        .join(listed, [*query, "doc_id"], "left_anti")
        .join(length, query, "left")
        .select(*query, "doc_id", (F.coalesce("listed", F.lit(0)) + place).cast("long").alias("rank"))
    )
    return listed.unionByName(rest)


def fuse(rankings: list[DataFrame], query: list[str], k: int = 60, tail: str = "none", candidates: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query, doc_id, rank).

    tail 'none': a document missing in a ranking adds nothing there. 'index': the documents of
    candidates(query, doc_id) that a ranking misses follow it in the order of their ids.
    """
    if tail not in ("none", "index") or (tail == "index") != (candidates is not None):
        raise ValueError("tail is 'none', or 'index' with candidates")
    if tail == "index":
        rankings = [with_tail(r, candidates, query) for r in rankings]
    union = rankings[0].select(*query, "doc_id", "rank")
    for r in rankings[1:]:
        union = union.unionByName(r.select(*query, "doc_id", "rank"))
    return union.groupBy(*query, "doc_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def pool(*lists: Column) -> Column:
    """Candidates of several lists, in order, each once; null lists and elements left out."""
    empty = F.array().cast("array<int>")
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(x, empty) for x in lists]), lambda x: x.isNotNull()))


def with_neighbours(indices: Column, n: Column, radius: int = 1) -> Column:
    """Indices with their neighbours up to radius inside 0..n-1, in the order of the seeds."""
    around = F.flatten(F.transform(F.filter(indices, lambda i: i.isNotNull()), lambda i: F.sequence(i - radius, i + radius)))
    return F.array_distinct(F.filter(around, lambda j: (j >= 0) & (j < n)))


METRICS = ("recall_at_1", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_5")


def list_metrics(top: Column, relevant: Column) -> dict[str, Column]:
    """Metrics of a ranking kept as an array; 0 without relevant items or ranking."""
    empty = F.array().cast("array<int>")
    top = F.coalesce(top, empty)
    rel = F.array_distinct(F.filter(F.coalesce(relevant, empty), lambda x: x.isNotNull()))
    n = F.size(rel)

    def hit(x: Column) -> Column:
        return F.coalesce(F.array_contains(rel, x), F.lit(False))

    def recall(k: int) -> Column:
        return F.when(n > 0, F.size(F.array_intersect(F.slice(top, 1, k), rel)) / n).otherwise(0.0)

    gains = F.transform(F.slice(top, 1, 5), lambda x, i: F.when(hit(x), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    first = F.array_max(F.transform(top, lambda x, i: F.when(hit(x), 1.0 / (i + 1.0))))
    ideal = F.aggregate(
        F.slice(F.array(*[F.lit(i) for i in range(1, 6)]), F.lit(1), F.least(n, F.lit(5))),
        F.lit(0.0),
        lambda s, i: s + 1.0 / F.log2(i + 1.0),
    )
    dcg = F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)
    return {
        "recall_at_1": recall(1),
        "recall_at_5": recall(5),
        "recall_at_10": recall(10),
        "mrr": F.coalesce(first, F.lit(0.0)),
        "ndcg_at_5": F.when(n > 0, dcg / ideal).otherwise(0.0),
    }


def ranking_metrics(ranking: DataFrame, relevant: DataFrame, query: list[str]) -> DataFrame:
    """Metrics of every query in relevant(query, doc_id) against ranking(query, doc_id, rank).

    The reciprocal rank needs the whole ranking; queries that rank nothing relevant get 0.
    """
    hits = relevant.join(ranking.select(*query, "doc_id", "rank"), [*query, "doc_id"], "left")
    r = F.col("rank")

    def within(k: int) -> Column:
        return F.sum(F.when(r <= k, 1).otherwise(0)) / F.count("*")

    counted = hits.groupBy(*query).agg(
        within(1).alias("recall_at_1"),
        within(5).alias("recall_at_5"),
        within(10).alias("recall_at_10"),
        F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(r <= 5, 1.0 / F.log2(r + 1.0)).otherwise(0.0)).alias("dcg"),
        F.count("*").alias("n"),
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(5))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0)
    )
    return counted.select(*query, *METRICS[:4], (F.col("dcg") / ideal).alias("ndcg_at_5"))


def mean_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of each metric, to nine places, with the number of queries."""
    return rows.groupBy(*keys).agg(F.count("*").alias("queries"), *[F.round(F.avg(m), 9).alias(m) for m in METRICS])


def signals(scores: DataFrame, query: list[str]) -> DataFrame:
    """(query, candidates, top_score, top_margin, normalized_entropy) of all candidates' scores.

    The entropy is that of the softmax over ln of the number of candidates.
    """
    top = scores.groupBy(*query).agg(
        F.count("*").alias("candidates"),
        F.max("score").alias("top_score"),
        F.max_by("doc_id", F.struct("score", "doc_id")).alias("top_doc"),
    )
    joined = scores.join(top, query)
    x = F.exp(F.col("score") - F.col("top_score"))
    sums = joined.groupBy(*query).agg(
        F.sum(x).alias("z"), F.max(F.when(F.col("doc_id") != F.col("top_doc"), F.col("score"))).alias("second")
    )
    p = x / F.col("z")
    entropy = joined.join(sums, query).groupBy(*query).agg(
        F.first("candidates").alias("candidates"),
        F.first("top_score").alias("top_score"),
        F.first("second").alias("second"),
        (-F.sum(p * F.log(p + F.lit(1e-12)))).alias("entropy"),
    )
    several = F.col("candidates") > 1
    return entropy.select(
        *query,
        "candidates",
        "top_score",
        F.when(several, F.col("top_score") - F.col("second")).otherwise(0.0).alias("top_margin"),
        F.when(several, F.col("entropy") / F.log("candidates")).otherwise(0.0).alias("normalized_entropy"),
    )
