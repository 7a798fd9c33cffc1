"""SQL expressions that DuckDB reads as the functions of this library."""

from __future__ import annotations

from ..functions.text import PLACEHOLDERS


def fold(c: str) -> str:
    return f"replace(replace(lower({c}), 'ß', 'ss'), 'ς', 'σ')"


def tokens(c: str) -> str:
    return rf"regexp_extract_all({fold(c)}, '[\p{{L}}\p{{N}}]+')"


def router_tokens(c: str) -> str:
    return rf"regexp_extract_all({fold(c)}, '[\p{{L}}\p{{N}}_]+')"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def evidence(c: str) -> str:
    return fold(rf"trim(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'))")


def real_id(c: str) -> str:
    listed = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
    return f"(CASE WHEN lower({strip(c)}) NOT IN ({listed}) THEN lower({strip(c)}) END)"


def paper_key(c: str) -> str:
    inner = rf"regexp_replace(regexp_replace({real_id(c)}, '\.pdf$', ''), 'v\d+$', '')"
    return real_id(inner)


def ideal(n: str) -> str:
    """Ideal gain of min(5, n) relevant items."""
    return f"list_sum([1.0::DOUBLE / log2(i + 1.0::DOUBLE) FOR i IN range(1, least(5, {n}) + 1)])"


def counts_as_bigint(query: str) -> str:
    """The query with count_if, a HUGEINT in DuckDB, written as a filtered count."""
    while (at := query.find("count_if(")) >= 0:
        start = end = at + len("count_if(")
        depth = 1
        while depth:
            depth += {"(": 1, ")": -1}.get(query[end], 0)
            end += 1
        query = f"{query[:at]}(count(*) FILTER (WHERE {query[start : end - 1]})){query[end:]}"
    return query
