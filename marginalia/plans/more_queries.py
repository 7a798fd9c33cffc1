"""Further queries of the core operators: aggregates, variants, work lists, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import cost, order, retrieval, routing, splits, stats
from ..session import cut_lineage, table
from . import core_queries as core
from . import sql
from .core_queries import query

LEADS = core.LEADS


@query(
    f"""WITH q AS (SELECT {sql.tokens('question')}[1] AS t FROM evidence_audit WHERE question IS NOT NULL)
    SELECT CASE WHEN t IN ({", ".join(f"'{x}'" for x in LEADS)}) THEN t ELSE 'other' END AS lead, count(*) AS questions FROM q GROUP BY 1"""
)
def question_leads(spark: SparkSession, d: str) -> DataFrame:
    """Questions by their first word."""
    t = F.try_element_at(text.tokens("question"), F.lit(1))
    lead = F.when(t.isin(*LEADS), t).otherwise("other")
    return table(spark, d, "evidence_audit").where("question is not null").groupBy(lead.alias("lead")).agg(F.count("*").alias("questions"))


@query(
    f"""SELECT coalesce(source, 'unknown') AS source, count(DISTINCT {sql.paper_key('paper_id')}) AS papers, count(DISTINCT figure_id) AS images, count(DISTINCT query_id) AS queries,
      count(DISTINCT caption) AS captions FROM figure_results GROUP BY 1"""
)
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """Exact numbers of papers, images, queries and captions of each source."""
    return table(spark, d, "figure_results").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count_distinct(text.paper_key("paper_id")).alias("papers"), F.count_distinct("figure_id").alias("images"),
        F.count_distinct("query_id").alias("queries"), F.count_distinct("caption").alias("captions"),
    )


@query(
    f"""SELECT {sql.paper_key('paper_id')} AS paper, count(*) AS questions, bool_or(textual_evidence_count > 0) AS any_usable, bool_and(textual_evidence_count > 0) AS all_usable,
      round(avg(CASE WHEN textual_evidence_count > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS usable_rate
    FROM evidence_audit WHERE {sql.paper_key('paper_id')} IS NOT NULL AND textual_evidence_count IS NOT NULL GROUP BY 1"""
)
def evidence_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether any and whether all questions of a paper have textual evidence."""
    usable = F.col("textual_evidence_count") > 0
    rows = table(spark, d, "evidence_audit").where("textual_evidence_count is not null").withColumn("paper", text.paper_key("paper_id"))
    return rows.where("paper is not null").groupBy("paper").agg(
        F.count("*").alias("questions"), F.bool_or(usable).alias("any_usable"), F.bool_and(usable).alias("all_usable"),
        F.round(F.avg(F.when(usable, 1.0).otherwise(0.0)), 9).alias("usable_rate"),
    )


@query(core.SQL["page_mapping"].replace("SELECT document_id, id AS paragraph_id,", "SELECT status, count(*) AS paragraphs FROM (SELECT document_id, id AS paragraph_id,").rstrip() + ") GROUP BY status")
def mapping_status(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs by how they map to pages."""
    return core.page_mapping(spark, d).groupBy("status").agg(F.count("*").alias("paragraphs"))


@query(
    core.SQL["shape_similarity"].replace("SELECT document_id, page_pos::BIGINT AS page_pos, count(*)", "SELECT count(*) AS pages, sum(tables)::BIGINT AS tables, round(sum(tables * similarity) / sum(tables), 6) AS mean_per_table, round(avg(similarity), 6) AS mean_per_page FROM (SELECT document_id, page_pos, count(*)")
    + ")"
)
def two_level_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean shape similarity over tables, and over pages of their means: two different numbers."""
    s = core.shape_similarity(spark, d)
    return s.agg(
        F.count("*").alias("pages"), F.sum("tables").alias("tables"),
        F.round(F.sum(F.col("tables") * F.col("similarity")) / F.sum("tables"), 6).alias("mean_per_table"), F.round(F.avg("similarity"), 6).alias("mean_per_page"),
    )


@query(
    f"""WITH g AS (SELECT {sql.paper_key('paper_id')} AS paper, string_agg(result_id::VARCHAR, ',' ORDER BY result_id) AS ids, count(*) AS n FROM figure_results WHERE {sql.paper_key('paper_id')} IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)
    SELECT paper, ids, n FROM (SELECT *, row_number() OVER (ORDER BY paper) AS i FROM g) WHERE i <= 25"""
)
def page_sample_groups(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 papers with at least three questions, and those questions."""
    rows = table(spark, d, "figure_results").select(text.paper_key("paper_id").alias("paper"), "result_id").where("paper is not null")
    papers = splits.window_of(rows.groupBy("paper").agg(F.count("*").alias("n")).where("n >= 3"), ["paper"], 0, 25).select("paper", "n")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("result_id")), lambda x: x.cast("string")), ",")
    return rows.join(papers, "paper").groupBy("paper", "n").agg(ids.alias("ids"))


_P = core.SQL["percentile_nearest"]


@query(
    f"""WITH p AS ({_P}) SELECT c.parser AS cheap, s.parser AS strong, round(s.p50 / c.p50, 9) AS p50_ratio, round(s.p95 / c.p95, 9) AS p95_ratio
    FROM p c JOIN p s ON c.parser = 'pymupdf' AND s.parser <> 'pymupdf' WHERE c.p50 > 0 AND c.p95 > 0"""
)
def latency_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Latency percentiles of every parser against those of the cheapest one."""
    p = cut_lineage(stats.nearest_rank(core._measured(spark, d), ["parser"], "s", [0.5, 0.95]))
    c = p.where("parser = 'pymupdf' and p50 > 0 and p95 > 0").select(F.col("parser").alias("cheap"), F.col("p50").alias("a"), F.col("p95").alias("b"))
    return p.where("parser <> 'pymupdf'").crossJoin(F.broadcast(c)).select(  # one row for a parser
        "cheap", F.col("parser").alias("strong"), F.round(F.col("p50") / F.col("a"), 9).alias("p50_ratio"), F.round(F.col("p95") / F.col("b"), 9).alias("p95_ratio")
    )


@query(
    f"""SELECT paper, page FROM (SELECT {sql.paper_key('paper_id')} AS paper, page::BIGINT AS page FROM ({core._MEASURED_SQL}) WHERE parser = 'pymupdf' AND {sql.paper_key('paper_id')} IS NOT NULL
    INTERSECT SELECT {sql.paper_key('paper_id')}, page::BIGINT FROM ({core._MEASURED_SQL}) WHERE parser = 'docling')"""
)
def parser_key_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Pages that both the cheap and the strong parser have measured."""
    m = core._measured(spark, d).select(text.paper_key("paper_id").alias("paper"), core._long("page").alias("page"), "parser").where("paper is not null")
    return m.where("parser = 'pymupdf'").drop("parser").intersect(m.where("parser = 'docling'").drop("parser"))


_PAGES_SEEN = f"""
    WITH {core._LIST_SQL}, a AS (SELECT result_id, x % 8 AS page, i FROM (SELECT result_id, unnest(top) AS x, generate_subscripts(top, 1) AS i FROM lm)),
    s AS (SELECT result_id, page, row_number() OVER (PARTITION BY result_id ORDER BY min(i), page) AS rank FROM a WHERE page IS NOT NULL GROUP BY result_id, page),
    r AS (SELECT DISTINCT result_id, x % 8 AS page FROM (SELECT result_id, unnest(rel) AS x FROM lm))
"""


@query(
    _PAGES_SEEN
    + """, h AS (SELECT r.result_id, r.page, coalesce(bool_or(s.page = r.page), false) AS got, coalesce(bool_or(abs(s.page - r.page) <= 1), false) AS near
      FROM r LEFT JOIN (SELECT * FROM s WHERE rank <= 3) s ON r.result_id = s.result_id GROUP BY r.result_id, r.page),
    q AS (SELECT result_id, count_if(got)::DOUBLE / count(*) AS recall, count_if(near)::DOUBLE / count(*) AS near FROM h GROUP BY result_id)
    SELECT count(*) AS questions, round(avg(recall), 9) AS page_recall_at_3, round(avg(CASE WHEN recall > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS page_hit_at_3,
      round(avg(near), 9) AS adjacent_recall_at_3, round(avg(CASE WHEN near > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS adjacent_hit_at_3 FROM q"""
)
def ranked_pages(spark: SparkSession, d: str) -> DataFrame:
    """Recall and hits of the first three pages that rankings of paragraphs meet, alone and with the pages beside them (page: index modulo 8)."""
    from ..operators.evidence import pages_of_ranking

    empty = F.array().cast("array<int>")
    rows = table(spark, d, "retrieval_results").select("result_id", F.coalesce("top_indices", empty).alias("top"), F.coalesce("relevant_indices", empty).alias("rel"))
    ranking = rows.select("result_id", F.posexplode("top").alias("rank", "paragraph_id")).where("paragraph_id is not null")
    mapping = ranking.select("paragraph_id").distinct().withColumn("page", F.col("paragraph_id") % 8)
    seen = pages_of_ranking(ranking, mapping, ["result_id"], 3).select("result_id", F.col("page").alias("met"))
    wanted = rows.select("result_id", F.explode("rel").alias("i")).where("i is not null").select("result_id", (F.col("i") % 8).alias("page")).distinct()
    apart = F.abs(F.col("met") - F.col("page"))  # at most three pages met for each wanted one
    each = wanted.join(seen, "result_id", "left").groupBy("result_id", "page").agg(F.min(apart).alias("apart"))
    per = each.groupBy("result_id").agg((F.count_if(F.col("apart") == 0) / F.count("*")).alias("recall"), (F.count_if(F.col("apart") <= 1) / F.count("*")).alias("near"))

    def hit(c: str):
        return F.round(F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0)), 9)

    return per.agg(
        F.count("*").alias("questions"), F.round(F.avg("recall"), 9).alias("page_recall_at_3"), hit("recall").alias("page_hit_at_3"),
        F.round(F.avg("near"), 9).alias("adjacent_recall_at_3"), hit("near").alias("adjacent_hit_at_3"),
    )


@query(f"""WITH m AS ({core.SQL['retrieval_metrics_by_method']}) SELECT arg_max(method, (recall_at_5, ndcg_at_5, method)) AS method, max(recall_at_5) AS recall_at_5 FROM m""")
def best_method(spark: SparkSession, d: str) -> DataFrame:
    """The method with the best recall at five, then nDCG."""
    m = core.retrieval_metrics_by_method(spark, d)
    return m.agg(F.max_by("method", F.struct("recall_at_5", "ndcg_at_5", "method")).alias("method"), F.max("recall_at_5").alias("recall_at_5"))


def _context_sql() -> str:
    known = core._KNOWN_SQL
    wide = known.replace("doc_id, text, ", "doc_id, text, coalesce(section_name, '') || ' ' || text AS ctx, ").replace(sql.tokens("text") + " AS t", sql.tokens("coalesce(section_name, '') || ' ' || text") + " AS t")
    body = core.SQL["bm25_metrics"].split(known, 1)[1]
    return f"SELECT 'plain' AS variant, * FROM ({core.SQL['bm25_metrics']}) UNION ALL SELECT 'section' AS variant, * FROM (WITH {wide}{body})"


@query(_context_sql())
def context_variants(spark: SparkSession, d: str) -> DataFrame:
    """Known-item metrics with plain texts and with the section's name before them."""
    docs, queries = core._known_items(spark, d)
    section = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.coalesce("section_name", F.lit("")), "text").alias("text"))
    wide = docs.drop("text").join(section, "doc_id")
    keys = ["corpus_id", "query_id"]
    asked = queries.where(F.size(text.tokens("text")) > 0).select("corpus_id", "query_id", F.col("query_id").alias("doc_id"))
    rows = None
    for name, corpus in (("plain", docs), ("section", wide)):
        ranking = retrieval.ranked(retrieval.bm25(corpus, queries), keys)
        m = retrieval.ranking_metrics(ranking, asked, keys).withColumn("variant", F.lit(name))
        rows = m if rows is None else rows.unionByName(m)
    return retrieval.mean_metrics(rows, ["variant"])


@query(
    f"""WITH {core._SCORED_SQL}, y AS (SELECT p, CASE WHEN colsmol_metrics.mrr > caption_metrics.mrr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM scored),
    b AS (SELECT least(9, floor(round(p, 9) * 10)) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM y GROUP BY 1)
    SELECT (SELECT count(*) FROM y) AS rows, (SELECT round(avg((p - y) * (p - y)), 9) FROM y) AS brier, round(sum(n * abs(mp - my)) / sum(n), 9) AS ece FROM b"""
)
def calibration_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Brier score and expected calibration error of the published policy (an extension)."""
    y = F.when(F.col("colsmol_metrics.mrr") > F.col("caption_metrics.mrr"), 1.0).otherwise(0.0)
    rows = core._scored(spark, d).select("p", y.alias("y"))
    bins = rows.groupBy(F.least(F.lit(9), F.floor(F.round("p", 9) * 10)).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum((F.col("p") - F.col("y")) ** 2).alias("se")
    )
    n = F.sum("n")
    return bins.agg(n.alias("rows"), F.round(F.sum("se") / n, 9).alias("brier"), F.round(F.sum(F.abs(F.col("sp") - F.col("sy"))) / n, 9).alias("ece"))


@query(
    f"""SELECT paper_id, page::BIGINT AS page, parser, sha256('{{"parser":"' || parser || '","path":"' || paper_id || '.pdf","size":' || page || ',"modified":"r2","page":' || page || '}}') AS cache_key
    FROM (SELECT DISTINCT paper_id, page, parser FROM page_measurements WHERE paper_id IS NOT NULL AND page IS NOT NULL AND parser IS NOT NULL AND cache_hit)"""
)
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cache key of every page and parser that was served from the cache."""
    rows = table(spark, d, "page_measurements").where("paper_id is not null and page is not null and parser is not null and cache_hit")
    rows = rows.select("paper_id", "page", "parser").distinct()
    key = cost.cache_key(F.col("parser"), F.concat("paper_id", F.lit(".pdf")), F.col("page"), F.lit("r2"), F.col("page"))
    return rows.select("paper_id", core._long("page").alias("page"), "parser", key.alias("cache_key"))


@query(
    f"""WITH g AS (SELECT {sql.paper_key('paper_id')} AS paper, count(*) AS size FROM evidence_audit WHERE {sql.paper_key('paper_id')} IS NOT NULL GROUP BY 1),
    r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY paper ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT paper, size, before < 600 AS selected FROM r"""
)
def question_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Papers taken whole, in order, until 600 questions are reached."""
    rows = table(spark, d, "evidence_audit").select(text.paper_key("paper_id").alias("paper")).where("paper is not null")
    return splits.whole_groups(rows, "paper", 600)


@query(
    f"""WITH f AS (SELECT * FROM figure_results WHERE {core._ROUTE_WHERE}), b AS (SELECT least(1.0::DOUBLE, greatest(0.0::DOUBLE, caption_signal.top_score)) AS conf, result_id, caption_metrics.mrr AS m FROM f WHERE caption_signal.top_score IS NOT NULL),
    r AS (SELECT result_id, m, row_number() OVER (ORDER BY conf DESC, result_id) AS k, sum(m) OVER (ORDER BY conf DESC, result_id ROWS UNBOUNDED PRECEDING) AS s FROM b)
    SELECT count(*) AS rows, round(avg(1 - s / k), 6) AS aurc FROM r"""
)
def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Area under the risk-coverage curve of the cheap path's confidence (an extension)."""
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("caption_signal.top_score")))
    rows = core._routable(spark, d).where("caption_signal.top_score is not null").select(conf.alias("conf"), "result_id", F.col("caption_metrics.mrr").alias("m"))
    at = order.running_sums(rows, [-F.col("conf"), F.col("result_id")], {"k": F.lit(1), "s": F.col("m")})
    risk = 1 - (F.col("s") + F.col("m")) / (F.col("k") + 1)
    return at.agg(F.count("*").alias("rows"), F.round(F.avg(risk), 6).alias("aurc"))


@query()
def router_grid(spark: SparkSession, d: str) -> DataFrame:
    """Routers of three penalties and three class weights, fitted on hashed train papers, and the best one."""
    f = routing.invariant_features(F.col("question"), F.col("caption_signal"))
    y = F.when(F.col("colsmol_metrics.mrr") > F.col("caption_metrics.mrr"), 1).otherwise(0)
    rows = core._routable(spark, d).select(
        text.paper_key("paper_id").alias("paper"), *[c.alias(k) for k, c in f.items()], y.alias("y"),
        *[F.col(f"{s}_metrics")[m].alias(f"{m}_{k}") for m in ("mrr", "recall_at_1") for s, k in (("caption", "c"), ("colsmol", "s"))],
    ).dropna()
    parts = cut_lineage(rows.join(splits.hash_split(rows.select("paper"), "paper", 0.7), "paper"))
    grid = routing.router_grid(parts.where("split = 'train'"), parts.where("split <> 'train'"), list(routing.INVARIANT), [0.1, 0.25, 1.0], [1.0, 2.0, 4.0], (0.85, 0.95, 0.95))
    best = routing.best_candidate(grid)
    out = [(g["c"], g["positive_weight"], g["feasible"], g.get("threshold"), g.get("mrr"), g.get("route_rate"), g is best) for g in grid]
    return spark.createDataFrame(out, "c double, positive_weight double, feasible boolean, threshold double, mrr double, route_rate double, best boolean")
