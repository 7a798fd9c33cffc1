"""Pluggable parsers and scorers, run and measured in Arrow batches.

A parser is a function from the bytes or text of one item to a list of pages (dictionaries);
a scorer is a function from two texts to a number. Both are registered by name.
"""

from __future__ import annotations

import hashlib
import html.parser
import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARSERS: dict[str, Callable[..., Callable[[object], list[dict]]]] = {}


def register_parser(name: str, factory: Callable[..., Callable[[object], list[dict]]]) -> None:
    """Make a parser available; factory takes the options and gives the parser."""
    _PARSERS[name] = factory


def build_parser(name: str, **options) -> Callable[[object], list[dict]]:
    """A registered parser; ValueError for an unknown name."""
    if name not in _PARSERS:
        raise ValueError(f"no parser {name!r} among {sorted(_PARSERS)}")
    return _PARSERS[name](**options)


def fingerprint(name: str, options: dict) -> str:
    """SHA-256 of a parser's name and options, whatever their order."""
    return hashlib.sha256(json.dumps([name, options], sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class _Blocks(html.parser.HTMLParser):
    KINDS = {"h1": "title", "h2": "title", "h3": "title", "p": "text", "figcaption": "caption", "table": "table"}

    def __init__(self):
        super().__init__()
        self.blocks: list[dict] = []
        self.open: dict | None = None

    def handle_starttag(self, tag, attrs):
        if tag in self.KINDS and (self.open is None or self.open["type"] != "table"):
            self.open = {"block_id": f"b{len(self.blocks)}", "type": self.KINDS[tag], "text": ""}
            self.blocks.append(self.open)

    def handle_endtag(self, tag):
        if self.open is not None and self.KINDS.get(tag) == self.open["type"]:
            self.open = None

    def handle_data(self, data):
        if self.open is not None:
            self.open["text"] += data


def _html(**_options) -> Callable[[object], list[dict]]:
    def parse(item: object) -> list[dict]:
        p = _Blocks()
        p.feed(item if isinstance(item, str) else bytes(item).decode("utf-8", errors="replace"))
        return [{"page_id": 0, "blocks": p.blocks}]

    return parse


def _text(**_options) -> Callable[[object], list[dict]]:
    def parse(item: object) -> list[dict]:
        text = item if isinstance(item, str) else bytes(item).decode("utf-8", errors="replace")
        pages = text.split("\f")
        return [
            {"page_id": i, "blocks": [{"block_id": f"p{i}-{k}", "type": "text", "text": t} for k, t in enumerate(x for x in page.split("\n\n") if x.strip())]}
            for i, page in enumerate(pages)
        ]

    return parse


register_parser("html", _html)
register_parser("text", _text)

PARSED = "document_id string, parser string, pages string, latency_ms double, error string"


def parse_documents(work: DataFrame, document: str, content: str, parser: str, options: dict | None = None) -> DataFrame:
    """(document_id, parser, pages as JSON, latency_ms, error): failures are rows, not exceptions."""

    def run(batches):
        parse = build_parser(parser, **(options or {}))
        for batch in batches:
            rows = []
            for d, item in zip(batch["d"], batch["c"]):
                began = time.perf_counter()
                try:
                    if item is None:
                        raise ValueError("no content")
                    pages, error = json.dumps(parse(item), ensure_ascii=False), None
                except Exception as e:  # a parser may raise anything; the row tells it
                    pages, error = None, f"{type(e).__name__}: {e}"
                rows.append((d, parser, pages, (time.perf_counter() - began) * 1000, error))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PARSED.split(", ")])

    return work.select(F.col(document).cast("string").alias("d"), F.col(content).alias("c")).mapInPandas(run, PARSED)


def scored(score: Callable[[str, str], float], a: Column, b: Column) -> Column:
    """A scorer of text pairs as a column; null texts score null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else float(score(p, q)) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def encoded(encode: Callable[[list[str]], list[list[float]]], text: Column) -> Column:
    """An encoder of texts as a column of vectors of length 1; null texts have none."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        known = [t for t in x if t is not None]
        vectors = iter(encode(known) if known else [])
        out = []
        for t in x:
            if t is None:
                out.append(None)
                continue
            v = [float(z) for z in next(vectors)]
            norm = sum(z * z for z in v) ** 0.5 or 1.0
            out.append([z / norm for z in v])
        return pd.Series(out, dtype=object)

    return run(text)
