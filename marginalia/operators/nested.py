"""Deeply nested records to flat tables by Dewey labels.

Every node of a record gets the list of its ordinal places from the root down (its Dewey
label) and the schema path of its level. The parent of a node is the node whose label is
the same list without its last places, so parent keys are cut out of the label and no join
is needed; the tables are the nodes grouped by schema path.

Defined results
  * null pages, blocks and rows count for the places of their neighbours but give no row;
  * a list element's place is its index; children stored under numbers ("0", "7", ...) take
    the order of the numbers; a single child that stands where a list is expected has place 0;
  * JSON kept as text (the payload, a document, metadata, cells) is read as what it holds,
    also when it was encoded more than once; text that cannot be read gives nothing;
  * an empty object where children are expected has no children;
  * cell entries may be null or empty, they are rows all the same; an entry of table_cells
    without whole, non-negative start offsets gives nothing;
  * only the path document -> pages -> blocks -> metadata is followed, so raw parser output
    kept elsewhere gives nothing; extra columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "record_id long, path string, dewey array<int>, repeated boolean, attributes map<string,string>"
)
PAGE, BLOCK = "pages", "pages.blocks"
CELL, TABLE_CELL = "pages.blocks.cells", "pages.blocks.table_cells"
PAGE_FIELDS = ("page_id", "width", "height")
BLOCK_FIELDS = ("block_id", "type", "bbox", "text", "confidence", "metadata")


def read_json(value):
    """The value that text holds, through any number of encodings; None if unreadable."""
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def children(value) -> list[tuple[int, object]]:
    """(place, child) of a list, of an object keyed by numbers, or of a single object."""
    value = read_json(value)
    if isinstance(value, list):
        return list(enumerate(value))
    if isinstance(value, dict) and value:
        if all(k.isascii() and k.isdigit() for k in value):
            return list(enumerate(value[k] for k in sorted(value, key=lambda k: (int(k), k))))
        return [(0, value)]
    return []


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _offset(value) -> int | None:
    if isinstance(value, str) and value.strip().isdecimal():
        value = int(value)
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return value if isinstance(value, int) and not isinstance(value, bool) and 0 <= value < 2**31 else None


def cell_nodes(metadata, prefix: list[int], wanted: bool) -> Iterator[tuple]:
    """Nodes of the table cells in one block's metadata."""
    metadata = read_json(metadata)
    if not isinstance(metadata, dict):
        return
    seen = set()
    for row, entries in children(metadata.get("cells")):
        for col, entry in children(entries):
            seen.add((row, col))
            yield CELL, [*prefix, row, col], False, {"text": _text(entry)} if wanted else None
    for _, entry in children(metadata.get("table_cells")):
        entry = read_json(entry)
        if not isinstance(entry, dict):
            continue
        row, col = _offset(entry.get("start_row_offset_idx")), _offset(entry.get("start_col_offset_idx"))
        if row is None or col is None:
            continue
        again = (row, col) in seen
        seen.add((row, col))
        yield TABLE_CELL, [*prefix, row, col], again, {"text": _text(entry.get("text"))} if wanted else None


def document_nodes(payload, wanted: bool) -> Iterator[tuple]:
    """Nodes of one payload: a document, or the record around it."""
    root = read_json(payload)
    if not isinstance(root, dict):
        return
    inner = read_json(root.get("document"))
    document = inner if isinstance(inner, dict) else root
    for p, page in children(document.get("pages")):
        page = read_json(page)
        if not isinstance(page, dict):
            continue
        yield PAGE, [p], False, {k: _text(page.get(k)) for k in PAGE_FIELDS} if wanted else None
        for b, block in children(page.get("blocks")):
            block = read_json(block)
            if not isinstance(block, dict):
                continue
            yield BLOCK, [p, b], False, {k: _text(block.get(k)) for k in BLOCK_FIELDS} if wanted else None
            yield from cell_nodes(block.get("metadata"), [p, b], wanted)


def _frames(ids, nodes_of, per_frame: int = 20_000) -> Iterator[pd.DataFrame]:
    """Nodes of many records in frames of bounded size."""
    columns = ["record_id", "path", "dewey", "repeated", "attributes"]
    rows: list[tuple] = []
    for i, args in ids:
        for node in nodes_of(*args):
            rows.append((i, *node))
            if len(rows) >= per_frame:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def json_nodes(df: DataFrame, record: str, payload: str, attributes: bool = True) -> DataFrame:
    """Labelled nodes of JSON documents kept as text (any layout named above).

    attributes=False leaves the nodes' own fields out, so that only labels leave Python.
    """

    def run(batches):
        for batch in batches:
            yield from _frames(
                zip(batch["r"].tolist(), zip(batch["p"].tolist())), lambda p: document_nodes(p, attributes)
            )

    return (
        df.select(F.col(record).cast("long").alias("r"), F.col(payload).alias("p"))
        .where(F.col("r").isNotNull() & F.col("p").isNotNull())
        .mapInPandas(run, NODE_SCHEMA)
    )


def _attribute_map(node: Column, fields: tuple[str, ...]) -> Column:
    text = {"bbox", "metadata"}
    return F.create_map(
        *[
            x
            for k in fields
            for x in (F.lit(k), F.to_json(node[k]) if k in text else node[k].cast("string"))
        ]
    )


def struct_nodes(df: DataFrame, record: str, pages: str, attributes: bool = True) -> DataFrame:
    """Labelled nodes of documents held in nested columns (pages ARRAY<STRUCT<..., blocks ...>>).

    Pages and blocks are labelled by posexplode inside the JVM; only the cell texts of blocks
    that have any pass through Python.
    """
    none = F.lit(None).cast("map<string,string>")
    p = (
        df.select(F.col(record).cast("long").alias("record_id"), F.posexplode(pages).alias("p", "page"))
        .where(F.col("record_id").isNotNull() & F.col("page").isNotNull())
    )
    b = p.select("record_id", "p", F.posexplode("page.blocks").alias("b", "block")).where(F.col("block").isNotNull())
    page_nodes = p.select(
        "record_id",
        F.lit(PAGE).alias("path"),
        F.array("p").alias("dewey"),
        F.lit(False).alias("repeated"),
        (_attribute_map(F.col("page"), PAGE_FIELDS) if attributes else none).alias("attributes"),
    )
    block_nodes = b.select(
        "record_id",
        F.lit(BLOCK).alias("path"),
        F.array("p", "b").alias("dewey"),
        F.lit(False).alias("repeated"),
        (_attribute_map(F.col("block"), BLOCK_FIELDS) if attributes else none).alias("attributes"),
    )

    def run(batches):
        for batch in batches:
            yield from _frames(
                zip(batch["record_id"].tolist(), zip(batch["p"], batch["b"], batch["cells"], batch["table_cells"])),
                lambda p, b, cells, table_cells: cell_nodes(
                    {"cells": cells, "table_cells": table_cells}, [int(p), int(b)], attributes
                ),
            )

    md = F.col("block.metadata")
    cells = (
        b.select("record_id", "p", "b", md["cells"].alias("cells"), md["table_cells"].alias("table_cells"))
        .where(F.col("cells").isNotNull() | F.col("table_cells").isNotNull())
        .mapInPandas(run, NODE_SCHEMA)
    )
    return page_nodes.unionByName(block_nodes).unionByName(cells)


def place(level: int) -> Column:
    """The label's place at a level counted from 1; -1 where the label ends above it."""
    return F.when(F.size("dewey") >= level, F.element_at("dewey", level)).otherwise(F.lit(-1)).cast("int")


def node_places(nodes: DataFrame, origin: str) -> DataFrame:
    """(origin, record_id, page_pos, block_pos, row_pos, col_pos): one row for each place."""
    return nodes.where(~F.col("repeated")).select(
        F.lit(origin).alias("origin"),
        "record_id",
        place(1).alias("page_pos"),
        place(2).alias("block_pos"),
        place(3).alias("row_pos"),
        place(4).alias("col_pos"),
    )


def dewey_key(depth: int) -> Column:
    """Key of a node or, with a depth above it, of its ancestor: the label cut to depth."""
    return F.concat_ws(".", F.col("record_id").cast("string"), F.slice("dewey", 1, depth).cast("array<string>"))


def page_table(nodes: DataFrame) -> DataFrame:
    """Pages with their key and the key of their record."""
    return nodes.where(F.col("path") == PAGE).select(
        dewey_key(1).alias("page_key"),
        "record_id",
        place(1).alias("page_pos"),
        F.expr("try_cast(attributes['page_id'] AS INT)").alias("page_id"),
        F.expr("try_cast(attributes['width'] AS DOUBLE)").alias("width"),
        F.expr("try_cast(attributes['height'] AS DOUBLE)").alias("height"),
    )


def block_table(nodes: DataFrame) -> DataFrame:
    """Blocks with their key and the keys of their page and record."""
    a = F.col("attributes")
    return nodes.where(F.col("path") == BLOCK).select(
        dewey_key(2).alias("block_key"),
        dewey_key(1).alias("page_key"),
        "record_id",
        place(1).alias("page_pos"),
        place(2).alias("block_pos"),
        *[a[k].alias(k) for k in ("block_id", "type", "text")],
        F.expr("try_cast(attributes['confidence'] AS DOUBLE)").alias("confidence"),
        a["bbox"].alias("bbox"),
        a["metadata"].alias("metadata"),
    )


def cell_table(nodes: DataFrame) -> DataFrame:
    """Table cells with their place and the keys of their block, page and record."""
    return nodes.where(F.col("path").isin(CELL, TABLE_CELL)).select(
        dewey_key(2).alias("block_key"),
        dewey_key(1).alias("page_key"),
        "record_id",
        place(1).alias("page_pos"),
        place(2).alias("block_pos"),
        place(3).alias("row_pos"),
        place(4).alias("col_pos"),
        F.element_at(F.split("path", "[.]"), -1).alias("kept_as"),
        F.col("attributes")["text"].alias("text"),
    )
