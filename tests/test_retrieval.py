import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import evidence, order, retrieval


def words(t):
    return re.findall(r"[^\W_]+", t.casefold())


def slow_bm25(query, docs, k1=1.2, b=0.75):
    toks = [words(t) for t in docs]
    avg = sum(map(len, toks)) / len(toks)
    df = Counter(w for t in toks for w in set(t))
    out = []
    for i, t in enumerate(toks):
        f = Counter(t)
        s = 0.0
        for w in set(words(query)):
            if f[w]:
                s += math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * f[w] * (k1 + 1) / (f[w] + k1 * (1 - b + b * len(t) / avg))
        out.append((-round(s, 9), i))
    return [i for _, i in sorted(out)]


def test_bm25_equals_plain_formula(spark):
    rng = random.Random(3)
    vocab = ["alpha", "Beta", "gamma", "straße", "STRASSE", "x_y", "ß", "delta", "epsilon"]
    docs = [(c, i, " ".join(rng.choices(vocab, k=rng.randint(0, 12)))) for c in ("p", "q") for i in range(12)]
    docs.append(("p", 12, None))
    queries = [("p", 0, "alpha strasse"), ("q", 1, "gamma Y delta delta"), ("q", 2, "nothing here"), ("r", 3, "alpha")]
    d = spark.createDataFrame(docs, "corpus_id string, doc_id int, text string")
    q = spark.createDataFrame(queries, "corpus_id string, query_id int, text string")
    r = retrieval.ranked(retrieval.bm25(d, q, keep_zero=True), ["corpus_id", "query_id"]).collect()
    for c, qid, t in queries[:3]:
        got = [x.doc_id for x in sorted((x for x in r if x.query_id == qid), key=lambda x: x["rank"])]
        assert got == slow_bm25(t, [x[2] for x in docs if x[0] == c and x[2] is not None])
    assert not [x for x in r if x.query_id == 3]


def test_list_metrics(spark):
    rows = [([3, 1, 2], [1]), ([5, 4], [9]), (None, [1]), ([1], None), ([1, None, 2, 2], [2, 7, 2]), ([], [])]
    df = spark.createDataFrame(rows, "top array<int>, rel array<int>")
    m = retrieval.list_metrics(F.col("top"), F.col("rel"))
    got = df.select(*[c.alias(k) for k, c in m.items()]).collect()
    assert (got[0].recall_at_1, got[0].recall_at_5, got[0].mrr) == (0.0, 1.0, 0.5)
    assert abs(got[0].ndcg_at_5 - 1 / math.log2(3)) < 1e-12
    assert [got[i].mrr for i in (1, 2, 3, 5)] == [0.0] * 4
    assert got[4].recall_at_5 == 0.5 and abs(got[4].mrr - 1 / 3) < 1e-12


def test_fusion_and_pools(spark):
    rows = [("a", i, r) for r, i in enumerate([0, 1, 2], 1)], [("a", i, r) for r, i in enumerate([2, 1, 0], 1)]
    both = [spark.createDataFrame(x, "query_id string, doc_id int, rank int") for x in rows]
    top = retrieval.ranked(retrieval.fuse(both, ["query_id"]), ["query_id"], n=1).first()
    assert top.doc_id == 0
    one = spark.createDataFrame([([0, 2], 4), ([0, 3], 4), ([None, 9], 4)], "i array<int>, n int")
    got = [r[0] for r in one.select(retrieval.with_neighbours(F.col("i"), F.col("n"), 1)).collect()]
    assert got == [[0, 1, 2, 3], [0, 1, 2, 3], []]


def test_signals(spark):
    rows = [(1, i, s) for i, s in enumerate([0.1, 0.5, 0.3])] + [(2, 0, 0.7)]
    got = {r.query_id: r for r in retrieval.signals(spark.createDataFrame(rows, "query_id int, doc_id int, score double"), ["query_id"]).collect()}
    assert abs(got[1].top_margin - 0.2) < 1e-9 and 0 < got[1].normalized_entropy <= 1
    assert (got[2].top_margin, got[2].normalized_entropy) == (0.0, 0.0)


def test_text_forms(spark):
    df = spark.createDataFrame([("A  b\tc ", "2001.12345v3", " Y11-1002.PDF"), (None, None, "N/A"), ("", "x.pdf", "")], "a string, b string, c string")
    got = df.select(text.evidence_form("a"), text.paper_id_form("b"), text.paper_key("c")).collect()
    assert [tuple(r) for r in got] == [("a b c", "2001.12345", "y11-1002"), (None, None, None), ("", "x", None)]
    pdf = spark.createDataFrame([("hyphen-\n ated ﬁne  text",)], "t string").select(text.pdf_form("t")).first()[0]
    assert pdf == "hyphenated fine text"


def test_evidence_audit(spark):
    schema = "paper_id string, question_id string, answers array<struct<answer:struct<unanswerable:boolean,evidence:array<string>>>>"
    q = spark.createDataFrame(
        [("p", "q", [((False, ["Twice.", " twice.", "Once", "FLOAT SELECTED: no", "float selected", "gone"]),), ((True, ["x"]),)]), ("p", "r", [((True, ["Once"]),)])],
        schema,
    )
    p = spark.createDataFrame([("p", "twice."), ("p", "TWICE. "), ("p", "once"), ("p", "  ")], "paper_id string, paragraph string")
    rows = evidence.audit(q, p).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.evidence_type, r.textual_evidence_count, r.unique_mapping_count, r.tied_mapping_count, r.unmapped_count) == ("mixed", 4, 1, 1, 2)


def test_paragraphs_in_order(spark):
    schema = "paper_id string, title string, abstract string, full_text array<struct<section_name:string,paragraphs:array<string>>>"
    df = spark.createDataFrame([("p", "T", "abs", [("S", ["one", " ", "two"]), ("U", None)]), ("q", None, None, None)], schema)
    got = [(r.paper_id, r.idx, r.section, r.paragraph) for r in evidence.paper_paragraphs(df).collect()]
    assert got == [("p", 0, "Abstract", "abs"), ("p", 1, "S", "one"), ("p", 2, "S", "two")]


def test_page_mapping(spark):
    p = spark.createDataFrame([("d", 0, "alpha beta"), ("d", 1, "gamma"), ("d", 2, "one two three four five"), ("e", 0, "x")], "document string, paragraph_id int, form string")
    g = spark.createDataFrame([("d", 0, "start alpha beta end gamma"), ("d", 1, "gamma"), ("d", 2, "five four three two one")], "document string, page int, form string")
    got = {(r.document, r.paragraph_id): (r.status, r.page) for r in evidence.map_to_pages(p, g).collect()}
    assert got == {("d", 0): ("exact", 0), ("d", 1): ("ambiguous", None), ("d", 2): ("approximate", 2), ("e", 0): ("unmapped", None)}


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 5)) for i in range(500)]
    rng.shuffle(rows)
    got = {r.i: r.before for r in order.running_before(spark.createDataFrame(rows, "i int, v int"), [F.col("i")], F.col("v")).collect()}
    total = 0
    for i, v in sorted(rows):
        assert got[i] == total
        total += v
    assert order.running_before(spark.createDataFrame([], "i int"), [F.col("i")]).count() == 0


def test_search_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = np.round(rng.normal(size=(70, 8)), 1).astype("float32")
    m[5] = m[6]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<float>")
    for rows in (1000, 16):
        for length, patch in ((None, None), (4, None), (None, 4)):
            got = {}
            for r in retrieval.search(df, df.where("vec_id % 20 = 0"), 3, 1, length, patch, rows).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.doc_id)
            a = m.astype(float)[:, :length]
            for q in (0, 20, 40, 60):
                if patch:
                    s = sum(np.max([a[:, y : y + 4] @ a[q, x : x + 4] for y in (0, 4)], axis=0) for x in (0, 4))
                else:
                    s = a @ a[q]
                order_ = sorted((i for i in range(70) if i != q), key=lambda i: (-round(s[i], 9), i))
                assert got[q] == order_[:3]
    assert retrieval.search(df.limit(0), df.limit(0), 3).count() == 0


def test_whole_rankings_are_fused(spark, tmp_path):
    import numpy as np

    from marginalia.plans import core_queries

    rng = random.Random(5)
    vectors = {i: [rng.gauss(0, 1 + 2 * (j >= 16) + 3 * (j >= 32)) for j in range(64)] for i in range(600)}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")

    def order_of(q, n):
        s = {i: round(float(np.dot(vectors[q][:n], v[:n])), 9) for i, v in vectors.items() if i != q}
        return sorted(s, key=lambda i: (-s[i], i))

    queries, best, mrr = range(0, 600, 20), {}, {"cheap": [], "strong": [], "fused": []}
    for q in queries:
        orders = {"cheap": order_of(q, 16), "strong": order_of(q, 32)}
        score = Counter()
        for o in orders.values():
            for rank, i in enumerate(o, 1):
                score[i] += 1 / (60 + rank)
        orders["fused"] = sorted(score, key=lambda i: (-round(score[i], 9), i))
        best[q] = orders["fused"][:10]
        relevant = order_of(q, 64)[:5]
        for name, o in orders.items():
            mrr[name].append(1 / min(o.index(i) + 1 for i in relevant))
    got = {}
    for r in core_queries.rrf_hybrid(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == best
    for r in core_queries.dense_metrics(spark, str(tmp_path)).collect():
        assert r.queries == len(queries) and abs(r.mrr - sum(mrr[r.method]) / len(queries)) < 1e-8


def test_fusion_with_index_tail(spark):
    lists = [[3, 1], [0, 3]]
    both = [spark.createDataFrame([("a", i, r) for r, i in enumerate(x, 1)], "query_id string, doc_id int, rank int") for x in lists]
    every = spark.createDataFrame([("a", i) for i in range(5)], "query_id string, doc_id int")
    want = Counter()
    for x in lists:
        for rank, i in enumerate(x + [i for i in range(5) if i not in x], 1):
            want[i] += 1 / (60 + rank)
    got = {r.doc_id: r.score for r in retrieval.fuse(both, ["query_id"], tail="index", candidates=every).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_signals_of_blocks(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from marginalia.operators import retrieval

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).astype("float32").tolist()) for i in range(60)] + [(60, None), (61, [1.0] * 6), (62, [1.0] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = v.where("vec_id % 20 = 0 or vec_id = 61")
    want = {r.query_id: r for r in retrieval.signals(retrieval.dense(v, asked), ["query_id"]).collect()}
    for size in (7, 1000):
        got = {r.query_id: r for r in retrieval.search_signals(v, asked, rows=size).collect()}
        assert got.keys() == want.keys() and len(got) == 4
        for k, r in got.items():
            assert r.candidates == want[k].candidates == 61
            assert all(abs(r[c] - want[k][c]) < 1e-9 for c in ("top_score", "top_margin", "normalized_entropy"))
    two = v.where("vec_id >= 61")
    assert [(r.candidates, r.top_margin, r.normalized_entropy) for r in retrieval.search_signals(two, two).collect()] == [(1, 0.0, 0.0)] * 2
    assert retrieval.search_signals(v.where("vec_id < 0"), asked).count() == 0


def test_evidence_positions(spark):
    from marginalia.operators import evidence

    text = ["Alpha beta.", "gamma  DELTA", "alpha BETA.", "", "epsilon"]
    p = spark.createDataFrame([("p", t, i) for i, t in enumerate(text)] + [("other", "epsilon", 0)], "paper_id string, paragraph string, idx int")
    e = spark.createDataFrame(
        [("p", "q1", "alpha beta."), ("p", "q1", "Gamma delta"), ("p", "q2", "epsilon"), ("p", "q3", "nowhere"), ("p", "q4", "FLOAT SELECTED"), ("p", "q4", ""), ("p", "q5", None)],
        "paper_id string, question_id string, item string",
    )
    got = {r.question_id: [x.idx for x in r.relevant] for r in evidence.relevant_positions(e, p, ["idx"]).collect()}
    assert got == {"q1": [0, 1, 2], "q2": [4]}


def test_pdf_texts_map_over_line_ends(spark):
    from pyspark.sql import functions as F

    from marginalia.functions import text
    from marginalia.operators import evidence

    p = spark.createDataFrame([("d", "a", "The classi\ufb01er converges quickly")], "document string, paragraph_id string, t string").withColumn("form", text.pdf_form("t"))
    g = spark.createDataFrame([("d", 0, "Nothing here"), ("d", 1, "so the classifier con-\nverges   quickly, as seen")], "document string, page int, t string")
    row = evidence.map_to_pages(p, g.withColumn("form", text.pdf_form("t"))).first()
    assert (row.status, row.page) == ("exact", 1)
    plain = evidence.map_to_pages(p.withColumn("form", text.evidence_form("t")), g.withColumn("form", text.evidence_form(F.col("t")))).first()
    assert plain.status != "exact"
