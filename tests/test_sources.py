import io
import json
import tarfile
import time
import zipfile

from pyspark.sql import functions as F

from marginalia.operators import splits
from marginalia.sources import files, parsers
from marginalia.streaming import ingest


def test_names(spark):
    names = ["PMC4504083_6.jpg", "a/b/paper-page_12.xml", "x_table_3_page1.png", "plain.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(files.document_id(F.col("n")), files.page_index(F.col("n")))
    assert [tuple(r) for r in df.collect()] == [("PMC4504083", 6), ("paper", 12), ("x", 1), ("plain", None)]


def test_voc_pages(spark, tmp_path):
    obj = "<object><name>{}</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object>"
    for i, name in enumerate(["PMC1_0.jpg", "PMC1_1.jpg", "PMC2_0.jpg"]):
        (tmp_path / f"{i}.xml").write_text(f"<annotation><filename>{name}</filename>{obj.format('Table')}{obj.format('table row')}</annotation>")
    pages = files.voc_pages(spark, str(tmp_path / "*.xml"))
    r = pages.select("document_id", "page_index", files.table_boxes(F.col("objects")).alias("b")).where("page_index = 1").first()
    assert (r.document_id, r.page_index, r.b) == ("PMC1", 1, [[1.0, 2.0, 3.0, 4.0]])
    assert files.page_subset(pages, 7, 3).count() == 2
    out = spark.createDataFrame([("PMC1",)], "document_id string")
    assert [x.document_id for x in files.page_subset(pages, 7, 3, out).collect()] == ["PMC2"]
    assert files.page_subset(pages, 7, 2, one_per_document=False).count() == 2


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as t:
        body = json.dumps({"p1": {"title": "x"}, "p2": {"title": "ü"}}).encode()
        info = tarfile.TarInfo("dev.json")
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
    got = files.archive_json(spark, str(tmp_path / "a.tgz"), "dev.json")
    assert sorted(r.key for r in got.collect()) == ["p1", "p2"]
    assert files.archive_json(spark, str(tmp_path / "a.tgz"), "none.json").count() == 0
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("i/a.png", b"1")
    assert [(r.name, r.bytes) for r in files.zip_members(spark, str(tmp_path / "b.zip")).collect()] == [("i/a.png", None)]
    assert bytes(files.zip_members(spark, str(tmp_path / "b.zip"), True).first().bytes) == b"1"


def test_json_lines_and_runs(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"document_id": "a", "page": 1}\n\nbroken\n{"document_id": "b", "page": null}\n')
    lines = files.prediction_lines(spark, str(tmp_path / "l.jsonl"), "document_id STRING, page INT").cache()
    assert lines.where("_corrupt is null").count() == 2
    runs = spark.createDataFrame([(0, "r1", "x"), (0, "r2", "y"), (-1, "r9", "z"), (50, "r1", "w")], "offset int, run_id string, path string")
    assert {tuple(r) for r in files.latest_runs(runs).collect()} == {(0, "y"), (50, "w")}
    rows = spark.createDataFrame([("a", 1, 1, "old"), ("a", 1, 2, "new")], "d string, p int, seq int, v string")
    assert files.latest_predictions(rows, ["d", "p"], ["seq"]).first().v == "new"


def test_parsers(spark):
    work = spark.createDataFrame([("a", "<h1>T</h1><p>x</p><table><tr><td>1</td></tr></table>"), ("b", None)], "d string, c string")
    ok, failed = files.by_status(parsers.parse_documents(work, "d", "c", "html"))
    blocks = json.loads(ok.first().pages)[0]["blocks"]
    assert [b["type"] for b in blocks] == ["title", "text", "table"] and failed.first().error.startswith("ValueError")
    assert parsers.fingerprint("x", {"a": 1, "b": 2}) == parsers.fingerprint("x", {"b": 2, "a": 1}) != parsers.fingerprint("x", {"a": 2})
    df = spark.createDataFrame([("ab", "abc"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(parsers.scored(lambda p, q: len(set(p) & set(q)), F.col("a"), F.col("b"))).collect()] == [2.0, None]
    v = df.select(parsers.encoded(lambda ts: [[3.0, 4.0] for _ in ts], F.col("a")).alias("v")).first().v
    assert [round(x, 6) for x in v] == [0.6, 0.8]


def test_stream_parses_each_item_once(spark, tmp_path):
    work, out = tmp_path / "work", str(tmp_path / "out")
    for i, rows in enumerate([[("a", "x\n\ny"), ("a", "x\n\ny")], [("a", "x"), ("b", "z")]]):
        spark.createDataFrame(rows, "document_id string, content string").withColumn("arrived", F.lit("2061-03-01").cast("timestamp")).write.mode("append").parquet(str(work))
        stream = spark.readStream.schema("document_id string, content string, arrived timestamp").parquet(str(work))
        q = ingest.ingest(stream, out, str(tmp_path / "cp"))
        q.awaitTermination(60)
        time.sleep(0.1)
    assert sorted(r.document_id for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_manifests_and_splits(spark):
    rows = spark.createDataFrame(
        [("q1", "2001.1v3", "b.png", "c1", "?", "finite"), ("q2", "2001.1v3", "b.png", "c2", "?", "finite"), ("q3", "9.9", "a.png", "c3", "?", "finite"), ("q4", "Y1.pdf", "a.png", "c4", "?", "unanswerable")],
        "query_id string, paper_id string, figure string, caption string, question string, type string",
    )
    excluded = spark.createDataFrame([("9.9",)], "paper string")
    corpus, queries = splits.manifest(rows, excluded, ["unanswerable"])
    assert [tuple(r) for r in corpus.collect()] == [(0, "b.png", "c1", "2001.1")]
    assert sorted((r.query_id, r.relevant_index) for r in queries.collect()) == [("q1", 0), ("q2", 0)]
    g = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4), ("c", 5)], "g string, x int")
    assert {r.g: r.selected for r in splits.whole_groups(g, "g", 3).collect()} == {"a": True, "b": True, "c": False}
    h = splits.hash_split(g, "g", 0.5).collect()
    assert sorted(r.split for r in h) == ["calibration", "train", "train"] and h == splits.hash_split(g, "g", 0.5).collect()
    assert splits.hash_split(g.limit(0), "g", 0.5).count() == 0


def test_multi_manifest(spark):
    schema = "paper_id string, questions array<string>, question_ids array<string>, references array<array<string>>, figures map<string,string>"
    rows = spark.createDataFrame([("p", ["a?", "b?"], ["1", "2"], [["f2", "f1"], ["f2"]], {"f1": "x", "f2": "y"})], schema)
    corpus, queries = splits.multi_manifest(rows)
    assert corpus.count() == 2
    assert {r.query_id: r.relevant_indices for r in queries.collect()} == {"1": [0, 1], "2": [1]}


def test_lines_keep_their_place(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n".join(['{"k": 1, "v": "old"}', "", "{broken", '{"k": 2, "v": "x"}', '{"k": 1, "v": "new"}']) + "\n")
    lines = files.prediction_lines(spark, str(tmp_path / "p.jsonl"), "k INT, v STRING")
    assert [(r.k, r.v) for r in lines.orderBy("path", "place").collect()] == [(1, "old"), (None, None), (2, "x"), (1, "new")]
    assert lines.where("_corrupt is not null").count() == 1
    last = files.latest_predictions(lines.where("_corrupt is null"), ["k"], ["path", "place"])
    assert {r.k: r.v for r in last.collect()} == {1: "new", 2: "x"}


def test_hashes_and_splits(spark, tmp_path):
    import hashlib
    import io
    import tarfile

    import pytest

    (tmp_path / "a.bin").write_bytes(b"\x00abc" * 1000)
    got = files.file_hashes(spark, str(tmp_path / "a.bin")).first()
    assert (got.length, got.sha256) == (4000, hashlib.sha256(b"\x00abc" * 1000).hexdigest())
    with tarfile.open(tmp_path / "x.tgz", "w:gz") as t:
        for name, body in (("filler.json", b"[]" * 5000), ("dev.json", b'{"p1": {"n": 1}, "p2": null}')):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    got = {r.key: r.value for r in files.split_of_archive(spark, str(tmp_path / "x.tgz"), "dev", {"dev": "dev.json", "train": "train.json"}).collect()}
    assert got == {"p1": '{"n": 1}', "p2": "null"}
    assert files.split_of_archive(spark, str(tmp_path / "x.tgz"), "train", {"train": "train.json"}).count() == 0
    with pytest.raises(ValueError):
        files.split_of_archive(spark, str(tmp_path / "x.tgz"), "test", {"dev": "dev.json"})


def test_ingest_tells_a_broken_table_from_a_missing_one(spark, tmp_path):
    import pytest

    from marginalia.streaming import ingest

    like = spark.createDataFrame([("d",)], "document_id string")
    assert ingest._known(spark, str(tmp_path / "nothing"), like).count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        ingest._known(spark, str(tmp_path / "broken"), like).count()
