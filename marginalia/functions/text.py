"""Text expressions that stay inside the JVM.

Null in, null out, unless stated; empty texts give empty lists or ''.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
ROUTER_WORD = r"[\p{L}\p{N}_]+"

#: Ids that stand for "no id", compared in lower case.
PLACEHOLDERS = ("", "unknown", "n/a", "na", "none", "null", "nan", "nil", "-", "--", "?", "tbd", "missing", "undefined")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Case folding: lower case, sharp s as ss, final sigma as sigma."""
    return F.replace(F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def tokens(c: Column | str) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(WORD), F.lit(0))


def router_tokens(c: Column | str) -> Column:
    """Runs of letters, digits and underscores of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(ROUTER_WORD), F.lit(0))


def word_count(c: Column | str) -> Column:
    """Number of runs of letters, digits and underscores."""
    return F.size(F.regexp_extract_all(_col(c), F.lit(ROUTER_WORD), F.lit(0)))


def evidence_form(c: Column | str) -> Column:
    """Folded text with single blanks, none at either end."""
    return fold(F.trim(F.regexp_replace(_col(c), r"(?U)[\s\p{Z}]+", " ")))


def nfkc(c: Column | str) -> Column:
    """Compatibility composition, which Spark has no function for."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")

    return compose(_col(c))


def pdf_form(c: Column | str) -> Column:
    """Text of a PDF page: compatibility form, folded, hyphenated breaks joined, single blanks."""
    joined = F.regexp_replace(fold(nfkc(_col(c))), r"(?<=[\p{L}\p{N}_])-(?U)\s+(?=[\p{L}\p{N}_])", "")
    return F.trim(F.regexp_replace(joined, r"(?U)\s+", " "))


def strip(c: Column | str) -> Column:
    """Text without blanks of any kind at its ends."""
    return F.regexp_replace(_col(c), r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def paper_id_form(c: Column | str) -> Column:
    """A paper id without the file ending and then without the version."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"\.pdf$", ""), r"v\d+$", "")


def real_id(c: Column | str) -> Column:
    """An id in lower case without outer blanks; null for a placeholder.

    Written as one match, so that the id is computed once and not once for each branch.
    """
    listed = "|".join(re.escape(p) for p in PLACEHOLDERS if p)
    found = F.regexp_extract_all(F.lower(strip(c)), F.lit(rf"(?s)^(?!(?:{listed})$).+$"), F.lit(0))
    return F.try_element_at(found, F.lit(1))


def paper_key(c: Column | str) -> Column:
    """A paper id as it is compared: real_id, then without file ending and version."""
    return real_id(paper_id_form(real_id(c)))


def token_coverage(reference: Column, candidate: Column) -> Column:
    """Share of the reference's tokens (as a multiset) found among the candidate's; 0 if none.

    Both are token arrays; counted by sorted distinct tokens, inside one row.
    """

    candidate = F.coalesce(candidate, F.array().cast("array<string>"))

    def times(a: Column, t: Column) -> Column:
        return F.size(F.filter(a, lambda x: x == t))

    hits = F.aggregate(
        F.array_distinct(reference),
        F.lit(0),
        lambda s, t: s + F.least(times(reference, t), times(candidate, t)),
    )
    return F.when(F.size(reference) > 0, hits / F.size(reference)).otherwise(F.lit(0.0))


def suffix_class(c: Column | str) -> Column:
    """visual, non-visual or other, from how a pair type ends."""
    return (
        F.when(F.endswith(_col(c), F.lit(" non-visual")), "non-visual")
        .when(F.endswith(_col(c), F.lit(" visual")), "visual")
        .otherwise("other")
    )
