"""Queries of the core operators over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import cost, evidence, nested, order, retrieval, routing, splits, stats, structure
from ..session import table
from . import sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            SQL[f.__name__] = sql.counts_as_bigint(oracle)
        return f

    return add


def _long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# --- nested records ---------------------------------------------------------------------------


def _nodes(spark: SparkSession, d: str, attributes: bool) -> list[tuple[str, DataFrame]]:
    return [
        ("canonical_documents", nested.struct_nodes(table(spark, d, "canonical_documents"), "record_id", "pages", attributes)),
        ("prediction_log", nested.json_nodes(table(spark, d, "prediction_log"), "record_id", "payload", attributes)),
    ]


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Place of every page, block and table cell of both tables."""
    (a, x), (b, y) = _nodes(spark, d, False)
    return nested.node_places(x, a).unionByName(nested.node_places(y, b))


def _tables(spark: SparkSession, d: str, make) -> DataFrame:
    (a, x), (b, y) = _nodes(spark, d, True)
    return make(x).withColumn("origin", F.lit(a)).unionByName(make(y).withColumn("origin", F.lit(b)))


@query()
def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of pages."""
    return _tables(spark, d, nested.page_table)


@query()
def p2_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of blocks."""
    return _tables(spark, d, nested.block_table)


@query()
def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    """Flat table of table cells."""
    return _tables(spark, d, nested.cell_table)


@query(
    """
    WITH p AS (SELECT record_id, unnest(pages) AS page, generate_subscripts(pages, 1) - 1 AS page_pos FROM canonical_documents),
    b AS (SELECT record_id, page_pos, unnest(page.blocks) AS block, generate_subscripts(page.blocks, 1) - 1 AS block_pos FROM p WHERE page IS NOT NULL)
    SELECT record_id, page_pos::BIGINT AS page_pos, block_pos::BIGINT AS block_pos, block.block_id AS block_id, block.type AS type, length(block.text)::BIGINT AS chars
    FROM b WHERE block IS NOT NULL
    """
)
def document_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the nested documents with their places."""
    nodes = nested.block_table(nested.struct_nodes(table(spark, d, "canonical_documents"), "record_id", "pages").where(F.col("path") == nested.BLOCK))
    return nodes.select("record_id", _long("page_pos").alias("page_pos"), _long("block_pos").alias("block_pos"), "block_id", "type", _long(F.length("text")).alias("chars"))


# --- text -------------------------------------------------------------------------------------


@query(
    f"""
    SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents
    FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY term
    """
)
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and document frequency of every token."""
    t = table(spark, d, "documents").select("doc_id", F.explode(text.tokens("text")).alias("term"))
    per = t.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


@query(
    f"""
    SELECT form, count(*) AS copies, max(doc_id) AS last_doc_id, arg_max(text, doc_id) AS last_text
    FROM (SELECT doc_id, text, {sql.evidence('text')} AS form FROM documents WHERE text IS NOT NULL) GROUP BY form
    """
)
def normalize_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose normalised texts are equal, the last spelling kept."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text", text.evidence_form("text").alias("form"))
    return t.groupBy("form").agg(F.count("*").alias("copies"), F.max("doc_id").alias("last_doc_id"), F.max_by("text", "doc_id").alias("last_text"))


@query(
    rf"""
    WITH l AS (SELECT doc_id, section_name, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx FROM l WHERE {sql.evidence('line')} <> '')
    SELECT doc_id, idx::BIGINT AS idx, 'Title: ' || doc_id || chr(10) || 'Section: ' || coalesce(section_name, '') || chr(10) || line AS context FROM k
    """
)
def contextual_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as paragraphs, with section and place among the lines that are not blank."""
    papers = table(spark, d, "documents").where("text is not null").select(
        F.col("doc_id").alias("paper_id"),
        F.col("doc_id").cast("string").alias("title"),
        F.lit("").alias("abstract"),
        F.array(F.struct(F.col("section_name"), F.split("text", "\n").alias("paragraphs"))).alias("full_text"),
    )
    p = evidence.paper_paragraphs(papers)
    return p.select(F.col("paper_id").alias("doc_id"), _long("idx").alias("idx"), evidence.in_context(F.col("title"), F.col("section"), F.col("paragraph")).alias("context"))


@query(
    f"""
    WITH q AS (SELECT result_id, unnest({sql.tokens('question')}) AS t FROM figure_results),
    c AS (SELECT result_id, unnest({sql.tokens('caption')}) AS t FROM figure_results),
    qc AS (SELECT result_id, t, count(*) AS n FROM q GROUP BY ALL), cc AS (SELECT result_id, t, count(*) AS n FROM c GROUP BY ALL),
    s AS (SELECT qc.result_id, sum(least(qc.n, coalesce(cc.n, 0)))::DOUBLE / sum(qc.n)::DOUBLE AS coverage FROM qc LEFT JOIN cc USING (result_id, t) GROUP BY qc.result_id)
    SELECT f.result_id, round(coalesce(s.coverage, 0), 9) AS coverage FROM figure_results f LEFT JOIN s USING (result_id)
    """
)
def token_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of each question's tokens that its caption holds."""
    empty = F.array().cast("array<string>")
    q, c = (F.coalesce(text.tokens(x), empty) for x in ("question", "caption"))
    return table(spark, d, "figure_results").select("result_id", F.round(text.token_coverage(q, c), 9).alias("coverage"))


# --- evidence ---------------------------------------------------------------------------------


@query(
    """
    SELECT coalesce(evidence_type, 'unknown') AS evidence_type, count(*) AS questions, count_if(textual_evidence_count > 0) AS usable,
      sum(textual_evidence_count)::BIGINT AS textual, sum(mapped_textual_evidence_count)::BIGINT AS mapped,
      round(sum(mapped_textual_evidence_count)::DOUBLE / nullif(sum(textual_evidence_count), 0), 9) AS mapping_rate,
      coalesce(round(sum(mapped_textual_evidence_count)::DOUBLE / nullif(sum(textual_evidence_count), 0), 9) >= 0.9, false) AS gate_mapping,
      count_if(textual_evidence_count > 0) >= 50 AS gate_usable,
      coalesce(round(sum(mapped_textual_evidence_count)::DOUBLE / nullif(sum(textual_evidence_count), 0), 9) >= 0.9, false) AND count_if(textual_evidence_count > 0) >= 50 AS gate_passed
    FROM evidence_audit GROUP BY 1
    """
)
def evidence_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mapping rate and gates for each type of evidence."""
    a = table(spark, d, "evidence_audit").groupBy(F.coalesce("evidence_type", F.lit("unknown")).alias("evidence_type")).agg(
        F.count("*").alias("questions"),
        F.count_if(F.col("textual_evidence_count") > 0).alias("usable"),
        F.sum("textual_evidence_count").alias("textual"),
        F.sum("mapped_textual_evidence_count").alias("mapped"),
    )
    rate = F.round(F.col("mapped") / F.nullif(F.col("textual"), F.lit(0)), 9)
    return a.withColumn("mapping_rate", rate).select("*", *cost.gate(gate_mapping=F.col("mapping_rate") >= 0.9, gate_usable=F.col("usable") >= 50))


@query(
    rf"""
    WITH lines AS (SELECT {sql.paper_key('paper_id')} AS paper, unnest(string_split(text, chr(10))) AS line FROM documents),
    c AS (SELECT paper, {sql.evidence('line')} AS form, count(*) AS n FROM lines WHERE paper IS NOT NULL AND {sql.evidence('line')} <> '' GROUP BY 1, 2),
    e AS (SELECT audit_id, {sql.paper_key('paper_id')} AS paper, unnest(unmapped_evidence) AS item FROM evidence_audit),
    f AS (SELECT DISTINCT audit_id, paper, {sql.evidence('item')} AS form FROM e WHERE paper IS NOT NULL AND {sql.evidence('item')} NOT IN ('', 'float selected'))
    SELECT audit_id, count(*) AS textual, count_if(coalesce(n, 0) = 1) AS unique_n, count_if(coalesce(n, 0) > 1) AS tied, count_if(coalesce(n, 0) = 0) AS unmapped
    FROM f LEFT JOIN c USING (paper, form) GROUP BY audit_id
    """
)
def evidence_remap(spark: SparkSession, d: str) -> DataFrame:
    """Unmapped evidence looked up again among all lines of the paper's documents."""
    lines = table(spark, d, "documents").select(text.paper_key("paper_id").alias("paper_id"), F.explode(F.split("text", "\n")).alias("paragraph"))
    items = table(spark, d, "evidence_audit").select(
        text.paper_key("paper_id").alias("paper_id"), F.col("audit_id").alias("question_id"), F.posexplode("unmapped_evidence").alias("pos", "item")
    )
    n = F.col("occurrences")
    mapped = evidence.map_evidence(items.where("paper_id is not null"), lines.where("paper_id is not null"))
    return mapped.groupBy(F.col("question_id").alias("audit_id")).agg(
        F.count("*").alias("textual"), F.count_if(n == 1).alias("unique_n"), F.count_if(n > 1).alias("tied"), F.count_if(n == 0).alias("unmapped")
    )


@query(
    rf"""
    WITH lines AS (SELECT {sql.paper_key('paper_id')} AS paper, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    c AS (SELECT paper, doc_id, pos, {sql.evidence('line')} AS form FROM lines WHERE paper IS NOT NULL AND {sql.evidence('line')} <> ''),
    e AS (SELECT audit_id, {sql.paper_key('paper_id')} AS paper, unnest(unmapped_evidence) AS item FROM evidence_audit),
    f AS (SELECT DISTINCT audit_id, paper, {sql.evidence('item')} AS form FROM e WHERE paper IS NOT NULL AND {sql.evidence('item')} NOT IN ('', 'float selected'))
    SELECT audit_id, count(*) AS relevant, string_agg(doc_id || '/' || pos, ',' ORDER BY doc_id, pos) AS positions FROM f JOIN c USING (paper, form) GROUP BY audit_id
    """
)
def relevant_positions(spark: SparkSession, d: str) -> DataFrame:
    """Places, by document and line, of the paper's lines that a question's evidence repeats."""
    lines = table(spark, d, "documents").select(text.paper_key("paper_id").alias("paper_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "paragraph"))
    items = table(spark, d, "evidence_audit").select(
        text.paper_key("paper_id").alias("paper_id"), F.col("audit_id").alias("question_id"), F.posexplode("unmapped_evidence").alias("pos", "item")
    )
    found = evidence.relevant_positions(items.where("paper_id is not null"), lines.where("paper_id is not null"), ["doc_id", "line"])
    places = F.array_join(F.transform("relevant", lambda x: F.concat_ws("/", x["doc_id"].cast("string"), x["line"].cast("string"))), ",")
    return found.select(F.col("question_id").alias("audit_id"), _long(F.size("relevant")).alias("relevant"), places.alias("positions"))


_PAGES_SQL = rf"""
    docs AS (SELECT arg_max(record_id, record_id) AS record_id, document_id, route, arg_max(pages, record_id) AS pages FROM canonical_documents
      WHERE document_id IS NOT NULL AND route IN ('cheap', 'strong') GROUP BY document_id, route),
    p AS (SELECT document_id, route, unnest(pages) AS page, generate_subscripts(pages, 1) - 1 AS page_pos FROM docs),
    b AS (SELECT document_id, route, page_pos, unnest(page.blocks) AS block, generate_subscripts(page.blocks, 1) - 1 AS block_pos FROM p WHERE page IS NOT NULL),
    texts AS (SELECT document_id, route, page_pos, block_pos, block.type AS type, block.text AS text, block.bbox AS bbox, block.metadata AS metadata FROM b WHERE block IS NOT NULL)
"""


def _routed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the last delivery of each document and route, with their places."""
    docs = table(spark, d, "canonical_documents").where("document_id is not null").where(F.col("route").isin("cheap", "strong"))
    last = docs.groupBy("document_id", "route").agg(F.max_by("pages", "record_id").alias("pages"))
    p = last.select("document_id", "route", F.posexplode("pages").alias("page_pos", "page"))
    b = p.select("document_id", "route", "page_pos", F.posexplode("page.blocks").alias("block_pos", "block"))
    return b.where("block is not null").select("document_id", "route", "page_pos", "block_pos", "block.*")


@query(
    rf"""
    WITH {_PAGES_SQL},
    pages AS (SELECT document_id, page_pos, string_agg({sql.evidence('text')}, ' ' ORDER BY block_pos) AS form FROM texts WHERE route = 'strong' AND text IS NOT NULL GROUP BY ALL),
    paras AS (SELECT document_id, page_pos || '/' || block_pos AS id, {sql.evidence('text')} AS form FROM texts WHERE route = 'cheap' AND text IS NOT NULL AND {sql.evidence('text')} <> ''),
    inside AS (SELECT paras.document_id, id, page_pos, contains(pages.form, paras.form) AS inside FROM paras JOIN pages USING (document_id)),
    pt AS (SELECT document_id, id, t, count(*) AS n FROM (SELECT document_id, id, unnest({sql.tokens('form')}) AS t FROM paras) GROUP BY ALL),
    gt AS (SELECT document_id, page_pos, t, count(*) AS n FROM (SELECT document_id, page_pos, unnest({sql.tokens('form')}) AS t FROM pages) GROUP BY ALL),
    tot AS (SELECT document_id, id, sum(n) AS n FROM pt GROUP BY ALL),
    hit AS (SELECT pt.document_id, pt.id, gt.page_pos, sum(least(pt.n, gt.n)) AS n FROM pt JOIN gt USING (document_id, t) GROUP BY ALL),
    cov AS (SELECT i.document_id, i.id, i.page_pos, i.inside, coalesce(hit.n, 0)::DOUBLE / nullif(tot.n, 0) AS c
      FROM inside i LEFT JOIN tot USING (document_id, id) LEFT JOIN hit ON hit.document_id = i.document_id AND hit.id = i.id AND hit.page_pos = i.page_pos),
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id, id ORDER BY round(coalesce(c, 0), 9) DESC, page_pos) AS r FROM cov),
    a AS (SELECT document_id, id, count_if(inside) AS n, min(CASE WHEN inside THEN page_pos END) AS exact_page, max(CASE WHEN r = 1 THEN page_pos END) AS best_page,
      coalesce(max(CASE WHEN r = 1 THEN coalesce(c, 0) END), 0) AS best, coalesce(max(CASE WHEN r = 2 THEN coalesce(c, 0) END), 0) AS second
      FROM (SELECT document_id, id FROM paras) LEFT JOIN r USING (document_id, id) GROUP BY ALL),
    m AS (SELECT *, round(best - second, 9) AS margin, round(best, 9) >= 0.8 AND round(best - second, 9) >= 0.1 AS near FROM a)
    SELECT document_id, id AS paragraph_id,
      CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' WHEN near THEN 'approximate' WHEN round(best, 9) >= 0.8 THEN 'ambiguous' ELSE 'unmapped' END AS status,
      (CASE WHEN n = 1 THEN exact_page WHEN n = 0 AND near THEN best_page END)::BIGINT AS page,
      CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE round(best, 9) END AS coverage,
      CASE WHEN n = 1 THEN 1.0::DOUBLE WHEN n > 1 THEN 0.0::DOUBLE ELSE margin END AS margin
    FROM m
    """
)
def page_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the cheap parse as paragraphs, mapped to the pages of the strong parse."""
    return _mapped(spark, d, text.evidence_form)


@query()
def page_mapping_pdf(spark: SparkSession, d: str) -> DataFrame:
    """The same by the form of PDF texts: widths alike, words joined that a line end breaks."""
    return _mapped(spark, d, text.pdf_form)


def _mapped(spark: SparkSession, d: str, form) -> DataFrame:
    blocks = _routed_blocks(spark, d).where("text is not null").withColumn("form", form("text"))
    pages = blocks.where("route = 'strong'").groupBy(F.col("document_id").alias("document"), F.col("page_pos").alias("page")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_pos", "form"))), lambda x: x["form"]), " ").alias("form")
    )
    paragraphs = blocks.where("route = 'cheap'").select(
        F.col("document_id").alias("document"), F.concat_ws("/", "page_pos", "block_pos").alias("paragraph_id"), "form"
    )
    return evidence.map_to_pages(paragraphs, pages).withColumnRenamed("document", "document_id")


# --- retrieval --------------------------------------------------------------------------------

_KNOWN_SQL = rf"""
    c AS (SELECT {sql.paper_key('paper_id')} AS corpus, doc_id, text, {sql.tokens('text')} AS t FROM documents WHERE text IS NOT NULL AND {sql.paper_key('paper_id')} IS NOT NULL),
    q AS (SELECT DISTINCT corpus, doc_id AS query_id, unnest({sql.tokens("string_split(text, chr(10))[1]")}) AS term FROM c),
    dl AS (SELECT corpus, doc_id, len(t) AS dl FROM c), st AS (SELECT corpus, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY corpus),
    tf AS (SELECT corpus, doc_id, term, count(*) AS tf FROM (SELECT corpus, doc_id, unnest(t) AS term FROM c) GROUP BY ALL),
    df AS (SELECT corpus, term, count(*) AS df FROM tf GROUP BY ALL),
    w AS (SELECT tf.corpus, tf.doc_id, tf.term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS w
      FROM tf JOIN df USING (corpus, term) JOIN dl USING (corpus, doc_id) JOIN st USING (corpus)),
    s AS (SELECT q.corpus, query_id, doc_id, sum(w) AS score FROM q JOIN w USING (corpus, term) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY corpus, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
"""


def _known_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every document in the corpus of its paper, and its first line as a query for it."""
    docs = table(spark, d, "documents").where("text is not null").select(text.paper_key("paper_id").alias("corpus_id"), "doc_id", "text").where("corpus_id is not null")
    queries = docs.select("corpus_id", F.col("doc_id").alias("query_id"), F.element_at(F.split("text", "\n"), 1).alias("text"))
    return docs, queries


@query(
    f"WITH {_KNOWN_SQL} SELECT corpus AS corpus_id, query_id, doc_id, round(score, 9) AS score, rank FROM r WHERE rank <= 10"
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of the own paper for each document's first line."""
    top = retrieval.ranked(retrieval.bm25(*_known_items(spark, d)), ["corpus_id", "query_id"], n=10)
    return top.select("corpus_id", "query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(
    f"""
    WITH {_KNOWN_SQL}, h AS (SELECT query_id, rank FROM (SELECT DISTINCT corpus, query_id FROM q) LEFT JOIN (SELECT corpus, query_id, rank FROM r WHERE doc_id = query_id) USING (corpus, query_id))
    SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_at_5,
      round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr,
      round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / log2(rank + 1.0::DOUBLE) ELSE 0 END), 9) AS ndcg_at_5
    FROM h
    """
)
def bm25_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of finding a document by its first line."""
    docs, queries = _known_items(spark, d)
    keys = ["corpus_id", "query_id"]
    ranking = retrieval.ranked(retrieval.bm25(docs, queries), keys)
    asked = queries.where(F.size(text.tokens("text")) > 0).select("corpus_id", "query_id", F.col("query_id").alias("doc_id"))
    return retrieval.mean_metrics(retrieval.ranking_metrics(ranking, asked, keys), [])


def _sims(start: int, length: int | None) -> str:
    part = f"[{start}:{start + length - 1}]" if length else ""
    return f"""(SELECT q.vec_id AS query_id, v.vec_id AS doc_id,
      list_inner_product(q.embedding{part}::DOUBLE[], v.embedding{part}::DOUBLE[]) AS score
      FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)"""


def _ranks(inner: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {inner})"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and every twentieth as a query."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e, e.where("vec_id % 20 = 0")


def _search(spark: SparkSession, d: str, n: int | None, length: int | None = None, patch: int | None = None) -> DataFrame:
    top = retrieval.search(*_vectors(spark, d), n, 1, length, patch)
    return top.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(f"SELECT query_id, doc_id, round(score, 9) AS score, rank FROM {_ranks(_sims(1, None))} WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every twentieth one."""
    return _search(spark, d, 10)


_METHOD_SQL = f"""
    WITH rel AS (SELECT query_id, doc_id FROM {_ranks(_sims(1, None))} WHERE rank <= 5),
    cheap AS {_ranks(_sims(1, 16))}, strong AS {_ranks(_sims(1, 32))},
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM
      (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM cheap UNION ALL SELECT query_id, doc_id, rank FROM strong) GROUP BY ALL)),
    r AS (SELECT 'cheap' AS method, query_id, doc_id, rank FROM cheap UNION ALL SELECT 'strong', query_id, doc_id, rank FROM strong UNION ALL SELECT 'fused', query_id, doc_id, rank FROM fused),
    m AS (SELECT k.method, rel.query_id, count(*) AS n, count_if(rank <= 1)::DOUBLE / count(*) AS recall_at_1, count_if(rank <= 5)::DOUBLE / count(*) AS recall_at_5,
      count_if(rank <= 10)::DOUBLE / count(*) AS recall_at_10, coalesce(1.0::DOUBLE / min(rank), 0) AS mrr,
      sum(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / log2(rank + 1.0::DOUBLE) ELSE 0 END) / {sql.ideal('count(*)')} AS ndcg_at_5
      FROM rel CROSS JOIN (SELECT unnest(['cheap', 'strong', 'fused']) AS method) k LEFT JOIN r ON rel.query_id = r.query_id AND rel.doc_id = r.doc_id AND r.method = k.method GROUP BY k.method, rel.query_id)
"""
_MEANS = ", ".join(f"round(avg({m}), 9) AS {m}" for m in retrieval.METRICS)


def _method_rankings(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Relevant: the five nearest by the whole vector. Rankings: all vectors by parts of it, fused."""
    relevant = _search(spark, d, 5).select("query_id", "doc_id")
    cheap, strong = (_search(spark, d, None, n) for n in (16, 32))
    fused = retrieval.ranked(retrieval.fuse([cheap, strong], ["query_id"]), ["query_id"])
    return relevant, {"cheap": cheap, "strong": strong, "fused": fused}


@query(_METHOD_SQL + f"SELECT method, count(*) AS queries, {_MEANS} FROM m GROUP BY method")
def dense_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of a cheap, a strong and their fused ranking."""
    relevant, rankings = _method_rankings(spark, d)
    rows = None
    for name, r in rankings.items():
        m = retrieval.ranking_metrics(r, relevant, ["query_id"]).withColumn("method", F.lit(name))
        rows = m if rows is None else rows.unionByName(m)
    return retrieval.mean_metrics(rows, ["method"])


@query(_METHOD_SQL + "SELECT query_id, doc_id, round(score, 9) AS score, rank FROM fused WHERE rank <= 10")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of the fused ranking."""
    fused = _method_rankings(spark, d)[1]["fused"].where("rank <= 10")
    return fused.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def _patch_sql() -> str:
    dots = ", ".join(f"list_inner_product(q.embedding[{{a}}:{{b}}]::DOUBLE[], v.embedding[{1 + 16 * i}:{16 + 16 * i}]::DOUBLE[])" for i in range(4))
    return " + ".join("greatest(" + dots.format(a=1 + 16 * k, b=16 + 16 * k) + ")" for k in range(4))


@query(
    f"""SELECT query_id, doc_id, round(score, 9) AS score, rank FROM {_ranks(f"(SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {_patch_sql()} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)")} WHERE rank <= 10"""
)
def maxsim_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best by late interaction of four patches."""
    return _search(spark, d, 10, patch=16)


@query(
    f"""WITH pool AS (SELECT query_id, doc_id FROM {_ranks(_sims(1, 16))} WHERE rank <= 20), s AS (SELECT query_id, doc_id, score FROM pool JOIN {_sims(1, None)} USING (query_id, doc_id))
    SELECT query_id, doc_id, round(score, 9) AS score, rank FROM {_ranks('s')} WHERE rank <= 5"""
)
def frozen_pool_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that a part of the vectors gave, kept as they are and ranked anew by the whole vectors."""
    pool = retrieval.search(*_vectors(spark, d), 20, 1, 16).select("query_id", "doc_id")
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    ends = pool.join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").join(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), "doc_id")
    top = retrieval.ranked(ends.select("query_id", "doc_id", retrieval.dot(F.col("q"), F.col("v")).alias("score")), ["query_id"], n=5)
    return top.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


_STRONG_32 = _sims(1, 32)


@query(
    f"""
    WITH s AS {_STRONG_32}, t AS (SELECT query_id, count(*) AS n, max(score) AS m, (list(score ORDER BY score DESC, doc_id))[2] AS second FROM s GROUP BY query_id),
    p AS (SELECT query_id, n, m, second, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY query_id) AS p FROM s JOIN t USING (query_id))
    SELECT query_id, any_value(n) AS candidates, round(any_value(m), 9) AS top_score, round(any_value(m) - any_value(second), 9) AS top_margin,
      round(-sum(p * ln(p + 1e-12)) / ln(any_value(n)), 9) AS normalized_entropy FROM p GROUP BY query_id
    """
)
def score_signals(spark: SparkSession, d: str) -> DataFrame:
    """Confidence signals of the strong ranking's scores."""
    s = retrieval.search_signals(*_vectors(spark, d), 1, 32)
    return s.select("query_id", "candidates", *[F.round(c, 9).alias(c) for c in ("top_score", "top_margin", "normalized_entropy")])


_LIST_SQL = f"""
    rel AS (SELECT result_id, list_distinct(coalesce(list_filter(relevant_indices, lambda x: x IS NOT NULL), [])) AS rel, coalesce(top_indices, []) AS top, * EXCLUDE (result_id) FROM retrieval_results),
    pos AS (SELECT result_id, unnest(top) AS x, generate_subscripts(top, 1) AS i, rel FROM rel),
    hits AS (SELECT result_id, min(i) AS first, sum(CASE WHEN i <= 5 THEN 1.0::DOUBLE / log2(i + 1.0::DOUBLE) ELSE 0 END) AS dcg,
      count(DISTINCT CASE WHEN i <= 1 THEN x END) AS h1, count(DISTINCT CASE WHEN i <= 5 THEN x END) AS h5, count(DISTINCT CASE WHEN i <= 10 THEN x END) AS h10
      FROM pos WHERE list_contains(rel, x) GROUP BY result_id),
    lm AS (SELECT rel.* EXCLUDE (rel, top), rel.rel, rel.top, len(rel.rel) AS n_rel, CASE WHEN len(rel.rel) > 0 THEN coalesce(h1, 0)::DOUBLE / len(rel.rel) ELSE 0 END AS recall_at_1,
      CASE WHEN len(rel.rel) > 0 THEN coalesce(h5, 0)::DOUBLE / len(rel.rel) ELSE 0 END AS recall_at_5, CASE WHEN len(rel.rel) > 0 THEN coalesce(h10, 0)::DOUBLE / len(rel.rel) ELSE 0 END AS recall_at_10,
      coalesce(1.0::DOUBLE / first, 0) AS mrr, CASE WHEN len(rel.rel) > 0 THEN coalesce(dcg, 0) / {sql.ideal('len(rel.rel)')} ELSE 0 END AS ndcg_at_5
      FROM rel LEFT JOIN hits USING (result_id))
"""


def _list_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = retrieval.list_metrics(F.col("top_indices"), F.col("relevant_indices"))
    return table(spark, d, "retrieval_results").select("*", *[c.alias(k) for k, c in m.items()])


@query(f"WITH {_LIST_SQL} SELECT method, count(*) AS queries, {_MEANS} FROM lm GROUP BY method")
def retrieval_metrics_by_method(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the stored rankings, computed anew, per method."""
    return retrieval.mean_metrics(_list_metrics(spark, d), ["method"])


_AT_SQL = "floor(100.0::DOUBLE * list_min(rel) / greatest(1, paragraph_count - 1))"
# The first words of questions that are told apart, and the strata's upper bounds with their names.
LEADS = ("what", "how", "which", "why", "does", "do", "is", "are", "was", "were")
PARAGRAPHS = ((25, 50, 100), ("<=25", "26-50", "51-100", ">100"))
POSITIONS = ((24, 49, 74), ("Q1", "Q2", "Q3", "Q4"))


@query(
    f"""
    WITH {_LIST_SQL}, asked AS (SELECT {sql.paper_key('paper_id')} AS paper, {sql.real_id('question_id')} AS question, arg_max(question, audit_id) AS words FROM evidence_audit
      WHERE question IS NOT NULL AND {sql.paper_key('paper_id')} IS NOT NULL AND {sql.real_id('question_id')} IS NOT NULL GROUP BY 1, 2),
    l AS (SELECT lm.*, words, {sql.tokens('words')}[1] AS t FROM lm LEFT JOIN asked ON asked.paper = {sql.paper_key('lm.paper_id')} AND asked.question = {sql.real_id('lm.question_id')}),
    x AS (SELECT result_id, unnest(['question_lead', 'evidence_count', 'paper_paragraphs', 'evidence_position']) AS field,
      unnest([CASE WHEN words IS NULL THEN 'unknown' WHEN t IN ({", ".join(f"'{x}'" for x in LEADS)}) THEN t ELSE 'other' END,
        CASE WHEN n_rel = 0 THEN 'none' WHEN n_rel = 1 THEN 'single' ELSE 'multiple' END,
        CASE WHEN paragraph_count IS NULL THEN 'unknown' WHEN paragraph_count <= 25 THEN '<=25' WHEN paragraph_count <= 50 THEN '26-50' WHEN paragraph_count <= 100 THEN '51-100' ELSE '>100' END,
        CASE WHEN n_rel = 0 OR paragraph_count IS NULL THEN 'unknown' WHEN {_AT_SQL} <= 24 THEN 'Q1' WHEN {_AT_SQL} <= 49 THEN 'Q2' WHEN {_AT_SQL} <= 74 THEN 'Q3' ELSE 'Q4' END]) AS value,
      recall_at_5 FROM l)
    SELECT field, value, count(*) AS questions, round(avg(CASE WHEN recall_at_5 > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit_at_5, round(avg(recall_at_5), 9) AS recall_at_5 FROM x GROUP BY ALL
    """
)
def strata_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Hits and recall at five by first word of the question, number of relevant paragraphs, length of paper and place of evidence."""
    keys = [text.paper_key("paper_id").alias("paper"), text.real_id("question_id").alias("asked")]
    questions = table(spark, d, "evidence_audit").where("question is not null").select(*keys, "question", "audit_id").where("paper is not null and asked is not null")
    words = questions.groupBy("paper", "asked").agg(F.max_by("question", "audit_id").alias("words"))
    rows = _list_metrics(spark, d).select("*", *keys).join(words, ["paper", "asked"], "left")
    rel = F.filter(F.coalesce("relevant_indices", F.array().cast("array<int>")), lambda x: x.isNotNull())
    n = F.size(F.array_distinct(rel))
    at = F.floor(F.lit(100.0) * F.array_min(rel) / F.greatest(F.lit(1), F.col("paragraph_count") - 1))
    first = F.try_element_at(text.tokens("words"), F.lit(1))
    strata = {
        "question_lead": F.when(F.col("words").isNull(), "unknown").when(first.isin(*LEADS), first).otherwise("other"),
        "evidence_count": F.when(n == 0, "none").when(n == 1, "single").otherwise("multiple"),
        "paper_paragraphs": stats.bucket(F.col("paragraph_count"), *PARAGRAPHS),
        "evidence_position": stats.bucket(F.when(n > 0, at), *POSITIONS),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in strata.items()]))
    return rows.select("recall_at_5", each.alias("s")).select("s.*", "recall_at_5").groupBy("field", "value").agg(
        F.count("*").alias("questions"),
        F.round(F.avg(F.when(F.col("recall_at_5") > 0, 1.0).otherwise(0.0)), 9).alias("hit_at_5"),
        F.round(F.avg("recall_at_5"), 9).alias("recall_at_5"),
    )


_PAIR_KEYS_SQL = f"{sql.paper_key('paper_id')} AS paper, {sql.real_id('question_id')} AS question"
_BY_METHOD_SQL = f"""
    {_LIST_SQL}, k AS (SELECT {_PAIR_KEYS_SQL}, method, max_by(struct_pack(top := top, rel := rel, r5 := recall_at_5, mrr := mrr, n := paragraph_count), result_id) AS s FROM lm
      WHERE {sql.paper_key('paper_id')} IS NOT NULL AND {sql.real_id('question_id')} IS NOT NULL GROUP BY ALL),
    pair AS (SELECT a.paper, a.question, a.s AS a, b.s AS b FROM k a JOIN k b ON a.paper = b.paper AND a.question = b.question AND a.method = 'dense' AND b.method = 'bm25')
"""


def _dense_and_lexical(spark: SparkSession, d: str) -> DataFrame:
    """(paper, question, a, b): the last dense and the last lexical result of each question of a paper."""
    empty = F.array().cast("array<int>")
    rows = _list_metrics(spark, d).select(
        text.paper_key("paper_id").alias("paper"),
        text.real_id("question_id").alias("question"),
        "method",
        "result_id",
        F.coalesce("top_indices", empty).alias("top"),
        F.array_distinct(F.filter(F.coalesce("relevant_indices", empty), lambda x: x.isNotNull())).alias("rel"),
        F.col("recall_at_5").alias("r5"),
        "mrr",
        F.col("paragraph_count").alias("n"),
    )
    rows = rows.where("paper is not null and question is not null").where(F.col("method").isin("dense", "bm25"))
    s = F.struct("top", "rel", "r5", "mrr", "n")
    return (
        rows.groupBy("paper", "question")
        .agg(
            F.max_by(s, F.when(F.col("method") == "dense", F.col("result_id"))).alias("a"),
            F.max_by(s, F.when(F.col("method") == "bm25", F.col("result_id"))).alias("b"),
            F.count_if(F.col("method") == "dense").alias("na"),
            F.count_if(F.col("method") == "bm25").alias("nb"),
        )
        .where("na > 0 and nb > 0")
    )


@query(
    f"""WITH {_BY_METHOD_SQL} SELECT count(*) AS questions, count_if(a.r5 > 0 AND b.r5 > 0) AS both_hit, count_if(a.r5 > 0 AND NOT b.r5 > 0) AS dense_only,
      count_if(NOT a.r5 > 0 AND b.r5 > 0) AS bm25_only, count_if(NOT a.r5 > 0 AND NOT b.r5 > 0) AS neither,
      count_if(a.mrr > b.mrr) AS better, count_if(a.mrr < b.mrr) AS worse, count_if(a.mrr = b.mrr) AS ties FROM pair"""
)
def complementarity(spark: SparkSession, d: str) -> DataFrame:
    """Which of dense and lexical retrieval hits, question by question, and which ranks better."""
    p = _dense_and_lexical(spark, d).select(F.col("a.r5").alias("x"), F.col("b.r5").alias("y"), F.col("a.mrr").alias("ma"), F.col("b.mrr").alias("mb"))
    x, y = F.col("x") > 0, F.col("y") > 0
    return p.agg(
        F.count("*").alias("questions"), F.count_if(x & y).alias("both_hit"), F.count_if(x & ~y).alias("dense_only"),
        F.count_if(~x & y).alias("bm25_only"), F.count_if(~x & ~y).alias("neither"), *[c.alias(k) for k, c in stats.paired(p, "mb", "ma").items()],
    )


@query(
    f"""
    WITH {_BY_METHOD_SQL}, c AS (SELECT paper, question, a.rel AS rel, coalesce(a.n, 0) AS n, list_concat(a.top[1:5], b.top[1:5]) AS seeds FROM pair),
    p AS (SELECT paper, question, rel, n, s, min(i) AS i FROM (SELECT paper, question, rel, n, unnest(seeds) AS s, generate_subscripts(seeds, 1) AS i FROM c) WHERE s IS NOT NULL GROUP BY ALL),
    e AS (SELECT DISTINCT paper, question, s + o AS x FROM p, (SELECT unnest([-1, 0, 1]) AS o) WHERE s + o >= 0 AND s + o < n),
    l AS (SELECT paper, question, string_agg(s::VARCHAR, ',' ORDER BY i) AS pool, count(*) AS pool_size FROM p GROUP BY ALL)
    SELECT c.paper, c.question, coalesce(l.pool, '') AS pool, coalesce(l.pool_size, 0) AS pool_size,
      (SELECT count(*) FROM e WHERE e.paper = c.paper AND e.question = c.question) AS expanded_size,
      CASE WHEN len(c.rel) = 0 THEN 0.0::DOUBLE ELSE round((SELECT count(*) FROM e WHERE e.paper = c.paper AND e.question = c.question AND list_contains(c.rel, e.x))::DOUBLE / len(c.rel), 9) END AS candidate_recall
    FROM c LEFT JOIN l USING (paper, question)
    """
)
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of both rankings, widened by neighbours, and how much of the evidence they hold."""
    pool = retrieval.pool(F.slice("a.top", 1, 5), F.slice("b.top", 1, 5))
    p = _dense_and_lexical(spark, d).withColumn("pool", pool)
    p = p.withColumn("wide", retrieval.with_neighbours(F.col("pool"), F.coalesce("a.n", F.lit(0)), 1))
    recall = F.when(F.size("a.rel") == 0, 0.0).otherwise(F.size(F.array_intersect("wide", "a.rel")) / F.size("a.rel"))
    return p.select(
        "paper", "question", F.array_join(F.col("pool").cast("array<string>"), ",").alias("pool"), _long(F.size("pool")).alias("pool_size"),
        _long(F.size("wide")).alias("expanded_size"), F.round(recall, 9).alias("candidate_recall"),
    )


@query(
    f"""WITH {_LIST_SQL} SELECT count(*) AS questions, {", ".join(f"round(avg(CASE WHEN n_rel > 0 THEN least({k}, n_rel)::DOUBLE / n_rel ELSE 0 END), 9) AS recall_at_{k}" for k in (1, 5, 10))},
      round(avg(CASE WHEN n_rel > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS mrr FROM lm"""
)
def oracle_evidence_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ceiling: metrics of the ranking that puts the evidence first."""
    rel = F.array_sort(F.array_distinct(F.filter(F.coalesce("relevant_indices", F.array().cast("array<int>")), lambda x: x.isNotNull())))
    m = retrieval.list_metrics(rel, rel)
    rows = table(spark, d, "retrieval_results").select(*[c.alias(k) for k, c in m.items()])
    return rows.agg(F.count("*").alias("questions"), *[F.round(F.avg(k), 9).alias(k) for k in retrieval.METRICS[:4]])


_CAPTIONS_SQL = f"""
    f AS (SELECT result_id, {sql.paper_key('paper_id')} AS paper, question, caption FROM figure_results WHERE {sql.paper_key('paper_id')} IS NOT NULL),
    cap AS (SELECT paper, caption, min(result_id) AS doc_id FROM f WHERE caption IS NOT NULL GROUP BY ALL)
"""


@query(
    f"""
    WITH {_CAPTIONS_SQL}, q AS (SELECT result_id AS query_id, paper, question FROM f WHERE result_id % 20 = 0 AND question IS NOT NULL),
    qt AS (SELECT query_id, paper, t, count(*) AS n FROM (SELECT query_id, paper, unnest({sql.tokens('question')}) AS t FROM q) GROUP BY ALL),
    ct AS (SELECT doc_id, paper, t, count(*) AS n FROM (SELECT doc_id, paper, unnest({sql.tokens('caption')}) AS t FROM cap) GROUP BY ALL),
    tot AS (SELECT query_id, sum(n) AS n FROM qt GROUP BY ALL),
    hit AS (SELECT query_id, doc_id, sum(least(qt.n, ct.n)) AS n FROM qt JOIN ct USING (paper, t) GROUP BY ALL),
    s AS (SELECT q.query_id, cap.doc_id, coalesce(hit.n::DOUBLE / tot.n::DOUBLE, 0) AS score FROM q JOIN cap USING (paper) LEFT JOIN tot USING (query_id) LEFT JOIN hit ON hit.query_id = q.query_id AND hit.doc_id = cap.doc_id)
    SELECT query_id, doc_id, round(score, 9) AS score, rank FROM {_ranks('s')} WHERE rank <= 5
    """
)
def coverage_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Captions of the same paper reranked by the share of the question's tokens they hold."""
    f = table(spark, d, "figure_results").select("result_id", text.paper_key("paper_id").alias("paper"), "question", "caption").where("paper is not null")
    captions = f.where("caption is not null").groupBy("paper", "caption").agg(F.min("result_id").alias("doc_id"))
    asked = f.where("result_id % 20 = 0 and question is not null").select(F.col("result_id").alias("query_id"), "paper", text.tokens("question").alias("q"))
    pairs = asked.join(captions.select("paper", "doc_id", text.tokens("caption").alias("c")), "paper")
    scores = pairs.select("query_id", "doc_id", text.token_coverage(F.col("q"), F.col("c")).alias("score"))
    return retrieval.ranked(scores, ["query_id"], n=5).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


# --- routing ----------------------------------------------------------------------------------

_ROUTE_WHERE = "question IS NOT NULL AND candidate_images IS NOT NULL AND caption_signal IS NOT NULL AND colsmol_signal IS NOT NULL AND caption_metrics IS NOT NULL AND colsmol_metrics IS NOT NULL"


def _routable(spark: SparkSession, d: str) -> DataFrame:
    """Figure results that hold all that routing reads; others cannot be routed."""
    return table(spark, d, "figure_results").where(_ROUTE_WHERE)


def _mean_struct(which: str) -> str:
    return ", ".join(f"round(avg({which}.{m}), 9) AS {m}" for m in retrieval.METRICS)


@query(
    f"""
    WITH f AS (SELECT *, CASE WHEN ends_with(qa_pair_type, ' non-visual') THEN 'non-visual' WHEN ends_with(qa_pair_type, ' visual') THEN 'visual' ELSE 'other' END AS kind FROM figure_results WHERE {_ROUTE_WHERE}),
    u AS (SELECT kind, 'cheap' AS method, caption_metrics AS m FROM f UNION ALL SELECT kind, 'strong', colsmol_metrics FROM f
      UNION ALL SELECT kind, 'oracle', CASE WHEN colsmol_metrics.mrr > caption_metrics.mrr THEN colsmol_metrics ELSE caption_metrics END FROM f)
    SELECT coalesce(kind, 'all') AS kind, method, count(*) AS queries, {_mean_struct('m')} FROM u GROUP BY GROUPING SETS ((kind, method), (method))
    """
)
def metrics_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics of both paths and of the oracle that picks the better one, by kind and over all."""
    c, s = F.col("caption_metrics"), F.col("colsmol_metrics")
    best = F.when(s["mrr"] > c["mrr"], s).otherwise(c)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("method"), m.alias("m")) for k, m in (("cheap", c), ("strong", s), ("oracle", best))]))
    rows = _routable(spark, d).select(text.suffix_class("qa_pair_type").alias("kind"), each.alias("x")).select("kind", "x.method", "x.m.*")
    per_kind = rows.groupBy("kind", "method").agg(F.count("*").alias("queries"), *[F.sum(m).alias(m) for m in retrieval.METRICS])
    both = F.explode(F.array(F.col("kind"), F.lit("all"))).alias("kind")
    sums = per_kind.select("method", "queries", *retrieval.METRICS, both).groupBy("kind", "method").agg(
        F.sum("queries").alias("queries"), *[F.sum(m).alias(m) for m in retrieval.METRICS]
    )
    return sums.select("kind", "method", "queries", *[F.round(F.col(m) / F.col("queries"), 9).alias(m) for m in retrieval.METRICS])


def _mentions_sql(q: str, words) -> str:
    return "CASE WHEN " + " OR ".join(f"contains({q}, '{w}')" for w in words) + " THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


_EARLY_SQL = f"""ln(1 + candidate_images) AS candidate_log, len({sql.router_tokens('question')})::DOUBLE AS question_tokens,
    {_mentions_sql(sql.fold('question'), routing.TABLE_WORDS)} AS mentions_table, {_mentions_sql(sql.fold('question'), routing.VISUAL_WORDS)} AS mentions_visual,
    caption_signal.top_score AS caption_top, caption_signal.top_margin AS caption_margin, caption_signal.normalized_entropy AS caption_entropy"""
_STRONG_SQL = """colsmol_signal.top_score AS strong_top, colsmol_signal.top_margin AS strong_margin, colsmol_signal.normalized_entropy AS strong_entropy,
    colsmol_signal.top_score - caption_signal.top_score AS top_difference, colsmol_signal.top_margin - caption_signal.top_margin AS margin_difference,
    colsmol_signal.normalized_entropy - caption_signal.normalized_entropy AS entropy_difference"""


def _rounded(inner: str, names) -> str:
    return f"SELECT result_id, {', '.join(f'round({n}, 9) AS {n}' for n in names)} FROM (SELECT result_id, {inner} FROM figure_results WHERE {_ROUTE_WHERE})"


@query(_rounded(f"{_EARLY_SQL}, {_STRONG_SQL}", routing.EARLY + routing.STRONG))
def inference_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of both paths for every figure question; the early ones are the first seven."""
    f = routing.inference_features(F.col("question"), F.col("candidate_images"), F.col("caption_signal"), F.col("colsmol_signal"))
    return _routable(spark, d).select("result_id", *[F.round(c, 9).alias(k) for k, c in f.items()])


def _whole_words_sql(words) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"CASE WHEN list_has_any({sql.router_tokens('question')}, [{listed}]) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


_INVARIANT_SQL = f"""ln(1 + len({sql.router_tokens('question')})) AS question_log_tokens,
    len(list_distinct({sql.router_tokens('question')}))::DOUBLE / greatest(len({sql.router_tokens('question')}), 1) AS question_token_diversity,
    {_whole_words_sql(routing.TABLE_WORDS)} AS mentions_table, {_whole_words_sql(routing.VISUAL_WORDS)} AS mentions_visual,
    caption_signal.top_score AS caption_top, caption_signal.top_margin AS caption_margin, caption_signal.normalized_entropy AS caption_entropy"""


@query(_rounded(_INVARIANT_SQL, routing.INVARIANT))
def invariant_features(spark: SparkSession, d: str) -> DataFrame:
    """Features that do not depend on the number of candidates."""
    f = routing.invariant_features(F.col("question"), F.col("caption_signal"))
    return _routable(spark, d).select("result_id", *[F.round(c, 9).alias(k) for k, c in f.items()])


def _policy_sql() -> str:
    p = routing.INVARIANT_POLICY
    z = " + ".join(f"({n} - ({m!r})::DOUBLE) / ({s!r})::DOUBLE * ({w!r})::DOUBLE" for n, m, s, w in zip(p.feature_names, p.mean, p.scale, p.coefficients))
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least(({p.intercept!r})::DOUBLE + {z}, 50), -50)))"


_SCORED_SQL = f"""
    f AS (SELECT result_id, source, caption_metrics, colsmol_metrics, {_INVARIANT_SQL} FROM figure_results WHERE {_ROUTE_WHERE}),
    scored AS (SELECT result_id, source, caption_metrics, colsmol_metrics, {_policy_sql()} AS p FROM f WHERE caption_top IS NOT NULL AND caption_margin IS NOT NULL AND caption_entropy IS NOT NULL)
"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    f = routing.invariant_features(F.col("question"), F.col("caption_signal"))
    p = routing.INVARIANT_POLICY.probability(f, clip=50.0)
    return _routable(spark, d).select("result_id", "source", "caption_metrics", "colsmol_metrics", p.alias("p")).where("p is not null")


_T = routing.INVARIANT_POLICY.threshold


@query(f"WITH {_SCORED_SQL} SELECT result_id, round(p, 9) AS p, round(p, 9) >= round({_T!r}::DOUBLE, 9) AS strong FROM scored")
def locked_policy_score(spark: SparkSession, d: str) -> DataFrame:
    """Probability and route of every figure question under the published policy."""
    return _scored(spark, d).select("result_id", F.round("p", 9).alias("p"), (F.round("p", 9) >= round(_T, 9)).alias("strong"))


@query(
    f"""WITH {_SCORED_SQL}, r AS (SELECT coalesce(source, 'unknown') AS source, round(p, 9) >= round({_T!r}::DOUBLE, 9) AS s, CASE WHEN round(p, 9) >= round({_T!r}::DOUBLE, 9) THEN colsmol_metrics ELSE caption_metrics END AS m FROM scored)
    SELECT source, count(*) AS queries, round(avg(CASE WHEN s THEN 1.0::DOUBLE ELSE 0 END), 9) AS route_rate, round(1 - avg(CASE WHEN s THEN 1.0::DOUBLE ELSE 0 END), 9) AS saving, {_mean_struct('m')} FROM r GROUP BY source"""
)
def routed_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics, route rate and saving of the published policy, per source."""
    p = F.round("p", 9)
    rows = _scored(spark, d).select(
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.when(p >= round(_T, 9), 1.0).otherwise(0.0).alias("s"),
        *[routing.routed(p, round(_T, 9), F.col("caption_metrics")[m], F.col("colsmol_metrics")[m]).alias(m) for m in retrieval.METRICS],
    )
    return rows.groupBy("source").agg(
        F.count("*").alias("queries"), F.round(F.avg("s"), 9).alias("route_rate"), F.round(routing.INVARIANT_POLICY.saving(F.avg("s")), 9).alias("saving"),
        *[F.round(F.avg(m), 9).alias(m) for m in retrieval.METRICS],
    )


_SWEEP_SQL = f"""
    {_SCORED_SQL}, r AS (SELECT round(p, 9) AS p, caption_metrics.mrr AS cm, colsmol_metrics.mrr AS sm, caption_metrics.recall_at_1 AS cr, colsmol_metrics.recall_at_1 AS sr FROM scored),
    g AS (SELECT p, count(*) AS c, sum(cm) AS cm, sum(sm) AS sm, sum(cr) AS cr, sum(sr) AS sr FROM r GROUP BY p UNION ALL SELECT 'infinity'::DOUBLE, 0, 0, 0, 0, 0),
    w AS (SELECT p AS threshold, sum(c) OVER o / sum(c) OVER () AS route_rate, (sum(sm) OVER o + sum(cm) OVER () - sum(cm) OVER o) / sum(c) OVER () AS mrr,
      (sum(sr) OVER o + sum(cr) OVER () - sum(cr) OVER o) / sum(c) OVER () AS recall_at_1, sum(sm) OVER () / sum(c) OVER () AS mrr_s, sum(sr) OVER () / sum(c) OVER () AS r1_s
      FROM g WINDOW o AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
"""


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).select(
        "p", *[F.col(f"{s}_metrics")[m].alias(f"{m}_{s}") for m in ("mrr", "recall_at_1") for s in ("caption", "colsmol")]
    )
    return routing.threshold_sweep(rows, {m: (f"{m}_caption", f"{m}_colsmol") for m in ("mrr", "recall_at_1")})


@query(f"WITH {_SWEEP_SQL} SELECT threshold, round(route_rate, 9) AS route_rate, round(mrr, 9) AS mrr, round(recall_at_1, 9) AS recall_at_1 FROM w")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """What routing gives at every threshold."""
    return _sweep(spark, d).select("threshold", *[F.round(c, 9).alias(c) for c in ("route_rate", "mrr", "recall_at_1")])


@query(
    f"""WITH {_SWEEP_SQL} SELECT threshold, round(route_rate, 9) AS route_rate, round(mrr, 9) AS mrr, round(recall_at_1, 9) AS recall_at_1 FROM w
    WHERE route_rate <= 0.85 AND recall_at_1 >= 0.8 * r1_s AND mrr >= 0.8 * mrr_s ORDER BY round(mrr, 9) DESC, round(recall_at_1, 9) DESC, round(route_rate, 9), threshold DESC LIMIT 1"""
)
def threshold_constrained(spark: SparkSession, d: str) -> DataFrame:
    """The best threshold under a route cap and retention bounds."""
    best = routing.best_threshold(_sweep(spark, d), 0.85, 0.8, 0.8)
    return best.select("threshold", *[F.round(c, 9).alias(c) for c in ("route_rate", "mrr", "recall_at_1")])


@query(
    f"""WITH {_SCORED_SQL}, r AS (SELECT coalesce(source, 'unknown') AS source, round(p, 9) AS p, CASE WHEN colsmol_metrics.mrr > caption_metrics.mrr THEN 1 ELSE 0 END AS y FROM scored),
    k AS (SELECT source, y, rank() OVER (PARTITION BY source ORDER BY p) + (count(*) OVER (PARTITION BY source, p) - 1) / 2.0::DOUBLE AS rk FROM r)
    SELECT source, round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif((sum(y) * (count(*) - sum(y)))::DOUBLE, 0), 9) AS auc, count(*) AS rows FROM k GROUP BY source"""
)
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    """How well the policy's probability ranks the questions that need the strong path, per source."""
    y = F.when(F.col("colsmol_metrics.mrr") > F.col("caption_metrics.mrr"), 1).otherwise(0)
    return routing.auc(_scored(spark, d).select(F.coalesce("source", F.lit("unknown")).alias("source"), "p", y.alias("y")), "p", "y", ["source"])


_PASS_SQL = f"SELECT result_id, coalesce(candidate_images <= 500 AND {{m}}.mrr >= 0.8 AND {{m}}.ndcg_at_5 >= 0.5, false) AS x FROM figure_results WHERE {_ROUTE_WHERE}"


@query(
    f"""
    WITH a AS ({_PASS_SQL.format(m='caption_metrics')}), b AS ({_PASS_SQL.format(m='colsmol_metrics')}), r AS (SELECT a.x AS c, b.x AS s FROM a JOIN b USING (result_id)),
    n AS (SELECT count(*) AS pages, count_if(c AND s) AS cheap_sufficient, count_if(s AND NOT c) AS strong_needed, count_if(NOT c AND NOT s) AS both_fail, count_if(c AND NOT s) AS strong_regression,
      count_if(c) AS cn, count_if(s) AS sn, count_if(c OR s) AS an FROM r)
    SELECT pages, cheap_sufficient, strong_needed, both_fail, strong_regression, round(cn::DOUBLE / pages, 9) AS cheap_sufficient_rate, round(sn::DOUBLE / pages, 9) AS strong_sufficient_rate,
      round(an::DOUBLE / pages, 9) AS oracle_sufficient_rate, round(91.64::DOUBLE / 667.22::DOUBLE, 9) AS cost_ratio,
      round((cn * 91.64::DOUBLE + (pages - cn) * 667.22::DOUBLE) / (pages * 667.22::DOUBLE), 9) AS oracle_normalized_cost, round(1 - (cn * 91.64::DOUBLE + (pages - cn) * 667.22::DOUBLE) / (pages * 667.22::DOUBLE), 9) AS oracle_saving,
      sn > cn AS gate_coverage, round(1 - (cn * 91.64::DOUBLE + (pages - cn) * 667.22::DOUBLE) / (pages * 667.22::DOUBLE), 9) >= 0.15 AS gate_saving, true AS gate_cost_ratio,
      sn > cn AND round(1 - (cn * 91.64::DOUBLE + (pages - cn) * 667.22::DOUBLE) / (pages * 667.22::DOUBLE), 9) >= 0.15 AS gate_passed FROM n
    """
)
def oracle_routing(spark: SparkSession, d: str) -> DataFrame:
    """Capability counts and cost of a zero-cost oracle over both paths."""
    exact = F.col("candidate_images") <= 500
    rows = _routable(spark, d).select(
        *[routing.sufficient(exact, F.col(f"{m}_metrics.mrr"), F.col(f"{m}_metrics.ndcg_at_5")).alias(m) for m in ("caption", "colsmol")]
    )
    return routing.oracle_summary(rows, "caption", "colsmol", 91.64, 667.22, 0.15, 0.5)


@query(
    f"""WITH a AS ({_PASS_SQL.format(m='caption_metrics')}), b AS ({_PASS_SQL.format(m='colsmol_metrics')})
    SELECT result_id, CASE WHEN a.x AND b.x THEN 'cheap_sufficient' WHEN a.x THEN 'strong_regression' WHEN b.x THEN 'strong_needed' ELSE 'both_fail' END AS capability, CASE WHEN a.x THEN 'cheap' ELSE 'strong' END AS oracle_route FROM a JOIN b USING (result_id)"""
)
def capability_labels(spark: SparkSession, d: str) -> DataFrame:
    """Capability label and oracle route of every figure question."""
    exact = F.col("candidate_images") <= 500
    c, s = (routing.sufficient(exact, F.col(f"{m}_metrics.mrr"), F.col(f"{m}_metrics.ndcg_at_5")) for m in ("caption", "colsmol"))
    return _routable(spark, d).select("result_id", routing.capability(c, s).alias("capability"), F.when(c, "cheap").otherwise("strong").alias("oracle_route"))


@query()
def fit_router(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of a router fitted on the train questions' early features."""
    f = routing.early_features(F.col("question"), F.col("candidate_images"), F.col("caption_signal"))
    y = F.when(F.col("colsmol_metrics.mrr") > F.col("caption_metrics.mrr"), 1).otherwise(0)
    rows = _routable(spark, d).where("split = 'train'").select(*[c.alias(k) for k, c in f.items()], y.alias("y")).dropna()
    p = routing.fit_router(rows, list(routing.EARLY))
    return spark.createDataFrame(
        list(zip(p.feature_names, p.mean, p.scale, p.coefficients, [p.intercept] * len(p.feature_names))),
        "feature string, mean double, scale double, coefficient double, intercept double",
    )


# --- statistics -------------------------------------------------------------------------------


@query(
    f"""WITH f AS (SELECT source, caption_metrics.recall_at_1 AS a, colsmol_metrics.recall_at_1 AS b FROM figure_results WHERE {_ROUTE_WHERE}),
    g AS (SELECT coalesce(source, 'unknown') AS source, count_if(b > a) AS better, count_if(b < a) AS worse FROM f GROUP BY 1)
    SELECT source, better, worse, round(CASE WHEN better + worse = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum([exp(lgamma(better + worse + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(better + worse - i + 1.0::DOUBLE) - (better + worse) * ln(2.0::DOUBLE)) FOR i IN range(0, least(better, worse) + 1)])) END, 6) AS p_value FROM g"""
)
def mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    """Exact test whether the strong path's first hit differs from the cheap one's, per source."""
    rows = _routable(spark, d).select(F.coalesce("source", F.lit("unknown")).alias("source"), F.col("caption_metrics.recall_at_1").alias("a"), F.col("colsmol_metrics.recall_at_1").alias("b"))
    n = rows.groupBy("source").agg(F.count_if(F.col("b") > F.col("a")).alias("better"), F.count_if(F.col("b") < F.col("a")).alias("worse"))
    return n.select("source", "better", "worse", F.round(stats.mcnemar(F.col("worse"), F.col("better")), 6).alias("p_value"))


_WEIGHT_SQL = " + ".join(f"CASE WHEN u >= {x!r}::DOUBLE THEN 1 ELSE 0 END" for x in stats.POISSON)


@query(
    f"""WITH f AS (SELECT result_id, colsmol_metrics.recall_at_1 - caption_metrics.recall_at_1 AS v FROM figure_results WHERE {_ROUTE_WHERE}),
    x AS (SELECT r, v, ('0x' || substr(md5('7-' || r || '-' || result_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM f, range(1, 201) t(r) WHERE v IS NOT NULL),
    w AS (SELECT r, v, {_WEIGHT_SQL} AS w FROM x), m AS (SELECT r, sum(w * v) / sum(w) AS m FROM w GROUP BY r)
    SELECT (SELECT round(avg(v), 9) FROM f) AS mean, (SELECT count(*) FROM f WHERE v IS NOT NULL) AS rows, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m"""
)
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean difference of the paths' first hits."""
    rows = _routable(spark, d).select("result_id", (F.col("colsmol_metrics.recall_at_1") - F.col("caption_metrics.recall_at_1")).alias("v"))
    return stats.bootstrap(rows, "result_id", "v")


_MEASURED_SQL = "SELECT paper_id, page, parser, arg_max(latency_seconds, (received_at, measurement_id)) AS s FROM page_measurements WHERE paper_id IS NOT NULL AND page IS NOT NULL AND parser IS NOT NULL AND latency_seconds >= 0 AND latency_seconds < 'infinity'::DOUBLE AND NOT isnan(latency_seconds) GROUP BY ALL"


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """The last valid latency of each page and parser."""
    v = F.col("latency_seconds")
    rows = table(spark, d, "page_measurements").where((v >= 0) & (v < float("inf")) & ~F.isnan(v))
    rows = rows.where("paper_id is not null and page is not null and parser is not null")
    return rows.groupBy("paper_id", "page", "parser").agg(F.max_by("latency_seconds", F.struct("received_at", "measurement_id")).alias("s"))


@query(f"SELECT paper_id, page::BIGINT AS page, parser, s AS latency_seconds FROM ({_MEASURED_SQL})")
def latest_measurements(spark: SparkSession, d: str) -> DataFrame:
    """The last write of each page and parser."""
    return _measured(spark, d).select("paper_id", _long("page").alias("page"), "parser", F.col("s").alias("latency_seconds"))


_NEAREST = ", ".join(f"list_sort(list(s))[1 + round_even((count(*) - 1) * {f}::DOUBLE, 0)::BIGINT] AS p{round(f * 100)}" for f in (0.5, 0.95, 0.99))


@query(f"SELECT parser, count(*) AS n, {_NEAREST} FROM ({_MEASURED_SQL}) GROUP BY parser")
def percentile_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank latency percentiles of each parser, exact."""
    return stats.nearest_rank(_measured(spark, d), ["parser"], "s", [0.5, 0.95, 0.99])


@query(
    f"WITH r AS (SELECT result_id, score, row_number() OVER (ORDER BY score, result_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT result_id, caption_metrics.mrr AS score FROM figure_results WHERE {_ROUTE_WHERE}) WHERE score IS NOT NULL) SELECT CASE WHEN i = 0 THEN 'worst' WHEN i = n // 2 THEN 'median' ELSE 'best' END AS which, result_id, score FROM r WHERE i IN (0, n // 2, n - 1)"
)
def worst_median_best(spark: SparkSession, d: str) -> DataFrame:
    """The worst, the middle and the best question of the cheap path."""
    return stats.worst_median_best(_routable(spark, d).select("result_id", F.col("caption_metrics.mrr").alias("score")), "score", "result_id")


# --- splits, work lists, cost -----------------------------------------------------------------


@query(
    f"""WITH g AS (SELECT DISTINCT {sql.paper_key('paper_id')} AS paper FROM figure_results WHERE {sql.paper_key('paper_id')} IS NOT NULL),
    r AS (SELECT paper, row_number() OVER (ORDER BY sha256('7:' || paper), paper) - 1 AS i, count(*) OVER () AS n FROM g)
    SELECT paper, CASE WHEN i < greatest(1, least(n - 1, round_even(n * 0.7::DOUBLE, 0)::BIGINT)) THEN 'train' ELSE 'calibration' END AS split FROM r"""
)
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """Papers split by the order of their hashes."""
    return splits.hash_split(table(spark, d, "figure_results").select(text.paper_key("paper_id").alias("paper")), "paper", 0.7)


@query(
    "WITH g AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey), r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT o_custkey, size, before < 5000 AS selected FROM r"
)
def whole_group_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Customers taken whole, in order, until 5,000 orders are reached."""
    return splits.whole_groups(table(spark, d, "orders"), "o_custkey", 5000)


@query(
    "SELECT result_id, qa_pair_type, place FROM (SELECT result_id, qa_pair_type, row_number() OVER (PARTITION BY qa_pair_type ORDER BY paper_id NULLS FIRST, result_id) AS place FROM figure_results) WHERE place <= 20"
)
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty questions of each type."""
    rows = table(spark, d, "figure_results").select("result_id", "qa_pair_type", "paper_id")
    return splits.balanced_sample(rows, "qa_pair_type", ["paper_id", "result_id"], 20).select("result_id", "qa_pair_type", "place")


@query(
    rf"""WITH r AS (SELECT query_id, regexp_replace(regexp_replace(paper_id, '\.pdf$', ''), 'v\d+$', '') AS paper, figure_id AS figure, caption, question FROM figure_results WHERE split <> 'train' AND paper_id IS NOT NULL AND figure_id IS NOT NULL AND query_id IS NOT NULL),
    x AS (SELECT DISTINCT regexp_replace(regexp_replace(paper_id, '\.pdf$', ''), 'v\d+$', '') AS paper FROM figure_results WHERE split = 'train' AND paper_id IS NOT NULL),
    k AS (SELECT * FROM r WHERE paper NOT IN (SELECT paper FROM x)),
    c AS (SELECT figure, row_number() OVER (ORDER BY figure) - 1 AS i FROM (SELECT DISTINCT figure FROM k))
    SELECT query_id, paper, figure, i AS relevant_index FROM k JOIN c USING (figure)"""
)
def manifest_build(spark: SparkSession, d: str) -> DataFrame:
    """Held-out figure questions of papers that train does not hold, with their figure's index."""
    f = table(spark, d, "figure_results").where("paper_id is not null")
    rows = f.where("split <> 'train'").select("query_id", "paper_id", F.col("figure_id").alias("figure"), "caption", "question", F.col("qa_pair_type").alias("type"))
    papers = f.where("split = 'train'").select(text.paper_id_form("paper_id").alias("paper"))
    return splits.manifest(rows, papers, [])[1].select("query_id", "paper", "figure", "relevant_index")


@query(
    f"""WITH g AS (SELECT DISTINCT {sql.paper_key('paper_id')} AS g, split AS s FROM figure_results WHERE {sql.paper_key('paper_id')} IS NOT NULL AND split IS NOT NULL)
    SELECT a.s AS split_a, b.s AS split_b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.s < b.s GROUP BY ALL"""
)
def disjointness(spark: SparkSession, d: str) -> DataFrame:
    """Papers that splits have in common."""
    return splits.shared_groups(table(spark, d, "figure_results"), text.paper_key("paper_id"))


_WORK_SQL = f"""work AS (SELECT DISTINCT {sql.paper_key('document_id')} AS paper, page.page_id::BIGINT AS page FROM (SELECT document_id, unnest(pages) AS page FROM canonical_documents) WHERE page IS NOT NULL AND page.page_id IS NOT NULL AND {sql.paper_key('document_id')} IS NOT NULL)"""


def _all_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "canonical_documents").select(text.paper_key("document_id").alias("paper"), F.explode("pages.page_id").alias("page"))
    return p.where("paper is not null and page is not null").select("paper", _long("page").alias("page")).distinct()


@query(
    f"WITH {_WORK_SQL} SELECT paper, page FROM work EXCEPT SELECT {sql.paper_key('paper_id')}, page::BIGINT FROM ({_MEASURED_SQL})"
)
def checkpoint_pending(spark: SparkSession, d: str) -> DataFrame:
    """Pages of parsed documents that no measurement covers yet."""
    done = _measured(spark, d).select(text.paper_key("paper_id").alias("paper"), _long("page").alias("page"))
    return cost.pending(_all_pages(spark, d), done, ["paper", "page"])


@query(
    f"""
    WITH {_WORK_SQL}, m AS (SELECT {sql.paper_key('paper_id')} AS paper, page::BIGINT AS page, max(s) AS seconds FROM ({_MEASURED_SQL}) WHERE {sql.paper_key('paper_id')} IS NOT NULL GROUP BY ALL),
    calls AS (SELECT {sql.paper_key('paper_id')} AS paper, result_id, list_distinct(list_filter([x % 8 FOR x IN top_indices], lambda y: y IS NOT NULL)) AS idx FROM retrieval_results WHERE method = 'dense' AND {sql.paper_key('paper_id')} IS NOT NULL),
    top AS (SELECT 'top' AS strategy, paper, result_id, unnest(idx)::BIGINT AS page FROM calls),
    adj AS (SELECT DISTINCT 'top_and_adjacent' AS strategy, paper, result_id, page + o AS page FROM top, (SELECT unnest([-1, 0, 1]) AS o) WHERE page + o BETWEEN 0 AND 7),
    u AS (SELECT * FROM top UNION ALL SELECT * FROM adj), t AS (SELECT count(*) AS all_pages, coalesce(sum(seconds), 0) AS always FROM work LEFT JOIN m USING (paper, page)),
    k AS (SELECT strategy, paper, page, count(*) AS calls, coalesce(any_value(seconds), 0) AS s FROM u LEFT JOIN m USING (paper, page) GROUP BY ALL),
    g AS (SELECT strategy, count(*) AS unique_pages, sum(calls)::BIGINT AS uncached_calls, sum(s) AS cached, sum(s * calls) AS uncached FROM k GROUP BY strategy)
    SELECT strategy, unique_pages, uncached_calls, round(1 - unique_pages::DOUBLE / all_pages, 9) AS page_reduction, round(cached, 6) AS cached_seconds, round(1 - cached / always, 9) AS cached_saving,
      round(uncached, 6) AS uncached_seconds, round(1 - uncached / always, 9) AS uncached_saving, round(1 - unique_pages::DOUBLE / all_pages, 9) >= 0.1 AND round(1 - cached / always, 9) >= 0.1 AS gate_passed FROM g, t
    """
)
def cost_cached_vs_uncached(spark: SparkSession, d: str) -> DataFrame:
    """Seconds and savings of page rescue, with and without a cache.

    The page of a paragraph is taken as its index modulo 8, as the tables hold no mapping.
    """
    latency = _measured(spark, d).select(text.paper_key("paper_id").alias("paper"), _long("page").alias("page"), "s").where("paper is not null")
    latency = latency.groupBy("paper", "page").agg(F.max("s").alias("seconds"))
    calls = table(spark, d, "retrieval_results").where("method = 'dense'").select(
        text.paper_key("paper_id").alias("paper"), F.col("result_id").alias("query_id"),
        F.transform(F.filter("top_indices", lambda x: x.isNotNull()), lambda x: _long(x % 8)).alias("indices"), F.lit(8).alias("n"),
    ).where("paper is not null")
    return cost.rescue_cost(calls, _all_pages(spark, d), latency, {"top": 0, "top_and_adjacent": 1}, 0.1, 0.1)


@query(
    "SELECT event_type, count(*) AS events, sum((props::JSON->>'k')::BIGINT)::BIGINT AS k_sum, round(avg(value), 6) AS mean_value, arg_max(event_id, event_id) AS last_event FROM events GROUP BY event_type"
)
def run_log_summary(spark: SparkSession, d: str) -> DataFrame:
    """Run log with JSON properties, by type."""
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("events"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"),
        F.round(F.avg("value"), 6).alias("mean_value"), F.max("event_id").alias("last_event"),
    )


@query(
    "WITH w AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id) SELECT user_id AS run_offset, event_id, event_type, value FROM w JOIN events USING (user_id, event_id)"
)
def latest_run_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The latest run of each offset."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return order.last_written(e, ["user_id"], ["event_id"]).withColumnRenamed("user_id", "run_offset")


@query(
    "SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) WHERE i >= 20 AND i < 70"
)
def sample_window(spark: SparkSession, d: str) -> DataFrame:
    """A window of the work list by offset and limit."""
    return splits.window_of(table(spark, d, "customer"), ["c_custkey"], 20, 50).select("c_custkey", "c_name")


# --- structure --------------------------------------------------------------------------------


@query(
    f"""WITH {_PAGES_SQL}, n AS (SELECT document_id, count_if(route = 'cheap' AND type = 'table') AS detected, count_if(route = 'strong' AND type = 'table') AS expected FROM texts GROUP BY document_id)
    SELECT document_id, detected, expected, round(CASE WHEN detected = 0 AND expected = 0 THEN NULL WHEN detected = 0 OR expected = 0 THEN 0.0::DOUBLE
      ELSE 2 * (least(detected, expected)::DOUBLE / detected) * (least(detected, expected)::DOUBLE / expected) / (least(detected, expected)::DOUBLE / detected + least(detected, expected)::DOUBLE / expected) END, 9) AS count_f1 FROM n"""
)
def count_f1(spark: SparkSession, d: str) -> DataFrame:
    """Table counts of the cheap parse against those of the strong one, per document."""
    is_table = F.col("type") == "table"
    n = _routed_blocks(spark, d).groupBy("document_id").agg(
        F.count_if((F.col("route") == "cheap") & is_table).alias("detected"), F.count_if((F.col("route") == "strong") & is_table).alias("expected")
    )
    return n.select("*", F.round(structure.count_f1(F.col("expected"), F.col("detected")), 9).alias("count_f1"))


@query(
    f"""WITH {_PAGES_SQL}, t AS (SELECT document_id, page_pos, block_pos, bbox FROM texts WHERE route = 'cheap' AND len(bbox) = 4),
    pairs AS (SELECT a.document_id, a.page_pos, a.block_pos, a.bbox AS a, b.bbox AS b FROM t a JOIN t b ON a.document_id = b.document_id AND a.page_pos = b.page_pos AND b.block_pos = a.block_pos + 1),
    i AS (SELECT *, greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[4], b[4]) - greatest(a[2], b[2]), 0) AS common,
      greatest(a[3] - a[1], 0) * greatest(a[4] - a[2], 0) + greatest(b[3] - b[1], 0) * greatest(b[4] - b[2], 0) AS areas FROM pairs)
    SELECT document_id, page_pos::BIGINT AS page_pos, block_pos::BIGINT AS block_pos, round(CASE WHEN areas - common > 0 THEN common / (areas - common) ELSE 0.0::DOUBLE END, 9) AS iou FROM i"""
)
def bbox_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of every block's box with that of the next block."""
    t = _routed_blocks(spark, d).where("route = 'cheap' and size(bbox) = 4").select("document_id", "page_pos", "block_pos", "bbox")
    after = t.select("document_id", "page_pos", (F.col("block_pos") - 1).alias("block_pos"), F.col("bbox").alias("next"))
    return t.join(after, ["document_id", "page_pos", "block_pos"]).select(
        "document_id", _long("page_pos").alias("page_pos"), _long("block_pos").alias("block_pos"), F.round(structure.iou(F.col("bbox"), F.col("next")), 9).alias("iou")
    )


@query(
    f"""WITH {_PAGES_SQL}, t AS (SELECT document_id, page_pos, block_pos, bbox AS b, greatest(bbox[3] - bbox[1], 0) * greatest(bbox[4] - bbox[2], 0) > 0 AS good FROM texts WHERE route = 'cheap' AND len(bbox) = 4),
    e AS (SELECT document_id, page_pos, min(b[1]) AS x0, min(b[2]) AS y0, greatest(max(b[3]) - min(b[1]), 1e-9) AS w, greatest(max(b[4]) - min(b[2]), 1e-9) AS h FROM t WHERE good GROUP BY ALL)
    SELECT t.document_id, t.page_pos::BIGINT AS page_pos, t.block_pos::BIGINT AS block_pos, {", ".join(f"round(CASE WHEN e.w IS NULL THEN b[{k + 1}] WHEN good THEN (b[{k + 1}] - {o}) / {s} ELSE 0.0::DOUBLE END, 9) AS {n}" for k, (o, s, n) in enumerate((("x0", "w", "x0n"), ("y0", "h", "y0n"), ("x0", "w", "x1n"), ("y0", "h", "y1n"))))}
    FROM t LEFT JOIN e USING (document_id, page_pos)"""
)
def normalize_cells(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page's blocks against the extent of all of them."""
    t = _routed_blocks(spark, d).where("route = 'cheap' and size(bbox) = 4")
    pages = t.groupBy("document_id", "page_pos").agg(F.sort_array(F.collect_list(F.struct("block_pos", "bbox"))).alias("x"))
    boxes = pages.withColumn("n", structure.normalised_boxes(F.col("x.bbox"))).select("document_id", "page_pos", F.explode(F.arrays_zip("x", "n")).alias("z"))
    return boxes.select(
        "document_id", _long("page_pos").alias("page_pos"), _long("z.x.block_pos").alias("block_pos"), *[F.round(F.col("z.n")[k], 9).alias(n) for k, n in enumerate(("x0n", "y0n", "x1n", "y1n"))]
    )


_SHAPES_SQL = f"""{_PAGES_SQL}, sh AS (SELECT document_id, route, page_pos, row_number() OVER (PARTITION BY document_id, route, page_pos ORDER BY block_pos) - 1 AS table_index,
      TRY_CAST(metadata['row_count'] AS BIGINT) AS r, TRY_CAST(metadata['column_count'] AS BIGINT) AS c FROM texts WHERE type = 'table')"""


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    t = _routed_blocks(spark, d).where("type = 'table'").select(
        "document_id", "route", "page_pos", "block_pos",
        F.expr("try_cast(metadata['row_count'] AS BIGINT)").alias("row_count"), F.expr("try_cast(metadata['column_count'] AS BIGINT)").alias("column_count"),
    )
    w = Window.partitionBy("document_id", "route", "page_pos").orderBy("block_pos")
    return t.withColumn("table_index", F.row_number().over(w) - 1)


@query(
    f"""WITH {_SHAPES_SQL}, j AS (SELECT document_id, page_pos, a.r AS ar, a.c AS ac, b.r AS br, b.c AS bc FROM (SELECT * FROM sh WHERE route = 'strong') a FULL JOIN (SELECT * FROM sh WHERE route = 'cheap') b USING (document_id, page_pos, table_index))
    SELECT document_id, page_pos::BIGINT AS page_pos, count(*) AS tables, round(avg(CASE WHEN ar IS NULL OR br IS NULL THEN 0.0::DOUBLE ELSE
      ((CASE WHEN greatest(ar, br) = 0 THEN 1.0::DOUBLE ELSE least(ar, br)::DOUBLE / greatest(ar, br) END) + (CASE WHEN greatest(ac, bc) = 0 THEN 1.0::DOUBLE ELSE least(ac, bc)::DOUBLE / greatest(ac, bc) END)) / 2 END), 9) AS similarity FROM j GROUP BY ALL"""
)
def shape_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of the cheap parse's tables against those of the strong one's, per page."""
    s = _shapes(spark, d)
    out = structure.shape_similarity(s.where("route = 'strong'"), s.where("route = 'cheap'"), ["document_id", "page_pos"])
    return out.withColumn("page_pos", _long("page_pos"))


@query(
    f"""WITH {_PAGES_SQL}, n AS (SELECT document_id, page_pos, count_if(type = 'table') AS tables FROM texts WHERE route = 'strong' GROUP BY ALL),
    r AS (SELECT document_id, page_pos, tables, coalesce(sum(tables) OVER (PARTITION BY document_id ORDER BY page_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM n)
    SELECT document_id || '_table_' || (first + i) || '.xml' AS file, document_id, page_pos::BIGINT AS page_pos FROM r, LATERAL (SELECT unnest(range(0, tables)) AS i)"""
)
def page_offset_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Structure file of each table, numbered through its document."""
    n = _routed_blocks(spark, d).where("route = 'strong'").groupBy("document_id", "page_pos").agg(F.count_if(F.col("type") == "table").alias("tables"))
    w = Window.partitionBy("document_id").orderBy("page_pos").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("tables").over(w), F.lit(0))
    return n.withColumn("first", first).where("tables > 0").select(
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("tables") - 1)).alias("i"), "document_id", "page_pos"
    ).select(F.concat("document_id", F.lit("_table_"), "i", F.lit(".xml")).alias("file"), "document_id", _long("page_pos").alias("page_pos"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of every table of both routes: regions of the cells stated with offsets, else one slot each, with its stored box or a zero box."""
    w = Window.partitionBy("document_id", "route", "page_pos").orderBy("block_pos")
    grid = _routed_blocks(spark, d).where(F.col("type") == "table").select(
        "document_id", "route", "page_pos", (F.row_number().over(w) - 1).alias("table_index"),
        F.from_json(F.expr("metadata['grid_cell_bboxes']"), "array<array<array<double>>>").alias("stored"),
        F.from_json(F.expr("metadata['table_cells']"), structure.REGIONS).alias("regions"),
        F.expr("try_cast(metadata['row_count'] AS INT)").alias("r"), F.expr("try_cast(metadata['column_count'] AS INT)").alias("c"),
    )
    cells = F.when(F.size("regions") > 0, structure.region_cells(F.col("regions"))).otherwise(structure.predicted_cells(F.col("r"), F.col("c"), F.col("stored")))
    return grid.select("document_id", "route", "page_pos", "table_index", cells.alias("cells"))


def _table_cells(spark: SparkSession, d: str, route: str, name: str) -> DataFrame:
    """Cells of every table of a route."""
    return _cells(spark, d).where(F.col("route") == route).select("document_id", "page_pos", "table_index", F.col("cells").alias(name))


@query()
def grits_top_loc(spark: SparkSession, d: str) -> DataFrame:
    """Grid alignment of the cheap parse's tables with the strong one's, missing tables scoring 0."""
    keys = ["document_id", "page_pos", "table_index"]
    of = F.col("route")  # a route has one table of an index
    pairs = _cells(spark, d).groupBy(*keys).agg(*[F.max_by("cells", F.when(of == r, 1)).alias(c) for r, c in (("strong", "t"), ("cheap", "p"))])
    return pairs.withColumn("s", structure.grits_scores(F.col("t"), F.col("p"))).select(*keys, "s.*")
