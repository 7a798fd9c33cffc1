import json

from pyspark.sql import Row

from marginalia.operators import nested


def places(nodes):
    return {tuple(r)[1:] for r in nested.node_places(nodes, "x").collect()}


def brute(payload):
    """Places by plain recursion over parsed values."""

    def load(v):
        while isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return None
        return v

    def kids(v):
        v = load(v)
        if isinstance(v, list):
            return v
        if isinstance(v, dict) and v:
            return [v[k] for k in sorted(v, key=int)] if all(k.isdigit() for k in v) else [v]
        return []

    root = load(payload)
    out = set()
    if not isinstance(root, dict):
        return out
    doc = load(root.get("document"))
    doc = doc if isinstance(doc, dict) else root
    for p, page in enumerate(kids(doc.get("pages"))):
        page = load(page)
        if not isinstance(page, dict):
            continue
        out.add((p, -1, -1, -1))
        for b, block in enumerate(kids(page.get("blocks"))):
            block = load(block)
            if not isinstance(block, dict):
                continue
            out.add((p, b, -1, -1))
            md = load(block.get("metadata"))
            if not isinstance(md, dict):
                continue
            for r, row in enumerate(kids(md.get("cells"))):
                out |= {(p, b, r, c) for c, _ in enumerate(kids(row))}
            for cell in kids(md.get("table_cells")):
                cell = load(cell)
                if isinstance(cell, dict):
                    out.add((p, b, cell["start_row_offset_idx"], cell["start_col_offset_idx"]))
    return out


def test_layouts(spark):
    page = {"page_id": 0, "blocks": [None, {"block_id": "b", "metadata": {"cells": [["a", None], None, [""]]}}]}
    cell = {"text": "x", "start_row_offset_idx": 2, "start_col_offset_idx": 3}
    payloads = [
        {"pages": [None, page]},
        {"document": {"pages": page}},
        {"document": json.dumps({"pages": json.dumps([page])})},
        {"pages": {"10": page, "2": None, "3": {"blocks": {"7": {"metadata": json.dumps({"table_cells": [cell, cell]})}}}}},
        {"pages": [], "metadata": {"raw_parser_output": {"pages": [page]}}},
        {"error": "no pages"},
        {"pages": {"blocks": {"text": "single"}}},
    ]
    texts = [json.dumps(p) for p in payloads] + ["{broken", "", "null", "[]", json.dumps(json.dumps(payloads[0]))]
    df = spark.createDataFrame([Row(record_id=i, payload=t, path="clash", dewey=1) for i, t in enumerate(texts)])
    nodes = nested.json_nodes(df, "record_id", "payload").cache()
    got = {}
    for r in nested.node_places(nodes, "x").collect():
        got.setdefault(r.record_id, set()).add((r.page_pos, r.block_pos, r.row_pos, r.col_pos))
    assert got == {i: b for i, t in enumerate(texts) if (b := brute(t))}
    assert (2, 0, 2, 3) not in got[0] and (1, 1, 0, 1) in got[0] and (1, 1, 2, 0) in got[0]
    assert (1, 0, 2, 3) in got[3] and (2, -1, -1, -1) in got[3]
    keys = {r.page_key for r in nested.page_table(nodes).collect()}
    assert {r.page_key for r in nested.block_table(nodes).collect()} <= keys
    assert {r.page_key for r in nested.cell_table(nodes).collect()} <= keys


def test_null_and_empty(spark):
    empty = spark.createDataFrame([], "record_id long, payload string")
    assert nested.json_nodes(empty, "record_id", "payload").count() == 0
    nulls = spark.createDataFrame([(None, '{"pages": [{}]}'), (1, None)], "record_id long, payload string")
    assert nested.json_nodes(nulls, "record_id", "payload").count() == 0
    deep = "[" * 100_000
    assert nested.json_nodes(spark.createDataFrame([(1, deep)], "record_id long, payload string"), "record_id", "payload").count() == 0


def test_columns_and_text_agree(spark):
    schema = "record_id long, pages array<struct<page_id:int,width:double,height:double,blocks:array<struct<block_id:string,type:string,bbox:array<double>,text:string,confidence:double,metadata:map<string,string>>>>>"
    block = ("b", "table", [0.0, 0.0, 1.0, 1.0], None, None, {"cells": '[["a"],[null,"b"],null]'})
    rows = [(1, [(0, 1.0, 1.0, [None, block]), None, (2, 1.0, 1.0, None)]), (2, []), (3, None), (None, [(0, 1.0, 1.0, [])])]
    df = spark.createDataFrame(rows, schema)
    got = places(nested.struct_nodes(df, "record_id", "pages"))
    assert got == {(1, 0, -1, -1, -1), (1, 2, -1, -1, -1), (1, 0, 1, -1, -1), (1, 0, 1, 0, 0), (1, 0, 1, 1, 0), (1, 0, 1, 1, 1)}
