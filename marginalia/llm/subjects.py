"""Subjects of documents, by spreading readers' labels over a graph of similar documents.

Two documents are neighbours where they share a verified term: one found in several papers (a
system's own name ties the documents of one paper, whatever they are about) and concentrated
on few subjects. Their similarity is a sum over the terms they share, so a step of spreading
over all edges is two joins, documents to terms and terms to documents: a term takes the mean
label of the documents that hold it, which is what its edges carry to each of them. No pair of
documents is listed, however many hold a term, and no edge is left out.

  1. seeds: documents with readers' labels, spellings matched to the subjects' names. Equal
     texts are one node;
  2. terms: share of each subject among the labelled documents that hold the term, drawn
     towards the corpus average by `strength` documents; those that reach `vague` are verified;
  3. documents: a sentence, table row or reference line is about a subject if it holds a term
     whose share reaches `clear`, or, failing any such term, one that reaches `vague` while
     the document has a clear unit of that subject or a trusted label of it;
     documents with at least `units` units on a subject deal with it. All that reach it stay;
  4. seeds are clamped: whatever is spread, their labels stay, in the result too. Trust is lost
     only by a seed that its text contradicts: no unit on what the readers named, and a clear
     one on what they did not. It takes what step 3 gave, like all other documents;
  5. 2 to 4 are repeated until less than the share `settled` of all labels changes.

Texts are taken apart once. Terms in more than a two-hundredth of the labelled documents (and in
30 of them) that come nowhere near `vague` are background and left out from there on; there are
at most 200 times as many of them as a document has terms.

Defined results
  * null, empty and tiny texts, and texts without any known term, deal with no subject, unless
    a reader named one;
  * look-alike characters, case, plural endings and hyphens at line ends make no difference;
  * label rows whose subject is not a subject's name are ignored; a document whose readers all
    found none is a seed for none; repeated label rows count once;
  * equal texts are one node and get equal subjects; ids that repeat are one document;
  * without subjects or without documents the result is empty; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import paper_key
from ..session import cut_lineage, spread
from .lookalike import by_table

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PLAIN = re.compile("[a-z]+")
BREAK = regex.compile(r"(?<=\p{L})-\r?\n(?=\p{L})")
LINE = regex.compile(r"[\r\n]+")
SENTENCE = regex.compile(r"(?<=[.!?])[\"”'’)\]]*\s+")


#: Verified terms up to this many (some 20 MB) are joined by broadcast, more by a shuffle, with the same result.
SENT_TERMS = 200_000


def text_units(text: str) -> list[str]:
    """Sentences and lines of a text."""
    return [u for line in LINE.split(BREAK.sub("", text)) for u in SENTENCE.split(line) if u.strip()]


def stem(word: str) -> str:
    """The word without a plural ending."""
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 3 and word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


@lru_cache(maxsize=100_000)
def _word(word: str) -> int:
    """Hash of a folded word without its plural ending."""
    return xxhash.xxh64_intdigest(stem(word))


_PAIR, _SIDE, _SIGN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(1 << 63)


def text_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(unit, term) of a text: hashes of its words and of the word pairs inside a unit."""
    found, ends = [], []
    for unit in text_units(text):
        if unit.isascii():
            found += map(_word, PLAIN.findall(unit.lower()))
        else:  # tokens come again, so each is spelled once
            spelled = " ".join([t if t.isascii() else by_table(t) for t in unit.split()])
            found += map(_word, WORD.findall(spelled.casefold()))
        ends.append(len(found))
    words = np.array(found, dtype=np.uint64)
    unit = np.repeat(np.arange(len(ends)), np.diff(np.array(ends, dtype=np.int64), prepend=0))
    if len(words) < 2:
        return unit, (words ^ _SIGN).view(np.int64)
    with np.errstate(over="ignore"):
        pairs = words[:-1] * _PAIR + (words[1:] ^ _SIDE)
    inside = unit[:-1] == unit[1:]
    return np.concatenate([unit, unit[:-1][inside]]), (np.concatenate([words, pairs[inside]]) ^ _SIGN).view(np.int64)


def tokenised(texts: DataFrame, background: np.ndarray | None = None) -> DataFrame:
    """texts(node, text, paper) with unit and term arrays in the place of text, background terms (sorted) left out."""
    known = np.array([], dtype=np.int64) if background is None else background

    def run(batches):
        for batch in batches:
            units, terms = [], []
            for text in batch["text"]:
                unit, term = text_terms(text)
                if len(known):
                    new = known[np.minimum(np.searchsorted(known, term), len(known) - 1)] != term
                    unit, term = unit[new], term[new]
                units.append(unit.astype(np.int32))
                terms.append(term)
            yield pd.DataFrame({"node": batch["node"], "paper": batch["paper"], "unit": units, "term": terms})

    return texts.select("node", "text", "paper").mapInPandas(run, "node string, paper string, unit array<int>, term array<long>")


def subject_key(c: Column | str) -> Column:
    """A subject's name as it is compared."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def seeds(labels: DataFrame, names: list[str], key_of: str, subject: str = "subject") -> DataFrame:
    """(key_of, s0, s1, ...): 1 for each subject that a reader named, else 0."""
    key = subject_key(subject)
    return labels.groupBy(key_of).agg(
        *[F.coalesce(F.max((key == n).cast("double")), F.lit(0.0)).alias(f"s{i}") for i, n in enumerate(names)]
    )


def learn(tokens: DataFrame, known: DataFrame, n: int, strength: float, least_documents: int, least_papers: int) -> DataFrame:
    """(term, documents, s0, ...): each term's share of each subject.

    tokens(t, paper, term array), known(t, s0, ...). Tasks sum up what they see before the
    shuffle, with up to least_papers distinct papers of each term as 64-bit hashes.
    """
    columns = [f"s{i}" for i in range(n)]
    schema = "term long, n double, papers array<long>, " + ", ".join(f"{c} double" for c in columns)

    def run(batches):
        for batch in batches:
            shares = batch[columns].to_numpy()
            papers = [p if isinstance(p, str) else f"document {d}" for d, p in zip(batch["t"], batch["paper"])]
            hashes, paper = np.unique(np.array([xxhash.xxh64_intdigest(p) for p in papers], dtype=np.uint64).view(np.int64), return_inverse=True)
            lengths = [len(t) for t in batch["term"]]
            if not sum(lengths):
                continue
            place, distinct = pd.factorize(np.concatenate(batch["term"].to_list()))
            pair = np.unique(place * len(lengths) + np.repeat(np.arange(len(lengths)), lengths))  # term and document, each pair once
            place, at = np.divmod(pair, len(lengths))
            held = np.unique(place * len(hashes) + paper[at])  # term and paper, each pair once
            of = held // len(hashes)
            few = np.arange(len(of)) - np.searchsorted(of, of) < least_papers
            seen = np.split(hashes[held[few] % len(hashes)], np.flatnonzero(np.diff(of[few])) + 1)
            sums = {c: np.bincount(place, shares[at, i], len(distinct)) for i, c in enumerate(columns)}
            yield pd.DataFrame({"term": distinct, "n": np.bincount(place, minlength=len(distinct)).astype(float), "papers": seen, **sums})

    base = known.agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in columns]).first()
    counted = (
        tokens.select("t", "paper", "term").join(known, "t")
        .mapInPandas(run, schema)
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("papers")))).alias("papers"), *[F.sum(c).alias(c) for c in columns])
        .where((F.col("n") >= least_documents) & (F.col("papers") >= least_papers))
    )
    return counted.select(
        "term", F.col("n").alias("documents"), *[((F.col(c) + strength * base[i]) / (F.col("n") + strength)).alias(c) for i, c in enumerate(columns)]
    )


def _best(n: int) -> Column:
    return F.greatest(*[F.col(f"s{i}") for i in range(n)], F.lit(0.0))


def support(tokens: DataFrame, terms: DataFrame, trusted: DataFrame, n: int, clear: float, vague: float) -> DataFrame:
    """(t, subject_at, units, clear_units): number of units of each document on each subject.

    trusted(t, subject_at): labels that stand in for a clear unit.
    """
    each = F.array(*[F.struct(F.lit(i).alias("subject_at"), F.col(f"s{i}").alias("share")) for i in range(n)])
    reached = terms.select("term", F.filter(each, lambda x: x["share"] >= vague).alias("reached"))
    if terms.count() <= SENT_TERMS:
        reached = F.broadcast(reached)
    hits = tokens.select("t", F.explode(F.arrays_zip("unit", "term")).alias("x")).select("t", F.col("x.unit").alias("unit"), F.col("x.term").alias("term"))
    # a trusted label is one more clear unit, numbered -1; all that follows is grouped by document
    labels = trusted.select("t", F.lit(-1).alias("unit"), "subject_at", F.lit(1.0).alias("share"))
    every = hits.join(reached, "term").select("t", "unit", F.inline("reached")).unionByName(labels).repartition("t")
    best = every.groupBy("t", "unit", "subject_at").agg(F.max("share").alias("share"))
    is_clear = F.col("share") >= clear
    marked = best.select(
        "t",
        "unit",
        "subject_at",
        is_clear.alias("clear"),
        F.max(is_clear).over(Window.partitionBy("t", "unit")).alias("unit_clear"),
        F.max(is_clear).over(Window.partitionBy("t", "subject_at")).alias("backed"),
    )
    counts = (F.col("unit") >= 0) & (F.col("clear") | (F.col("backed") & ~F.col("unit_clear")))
    return marked.where(counts).groupBy("t", "subject_at").agg(F.count("*").cast("int").alias("units"), F.count_if("clear").cast("int").alias("clear_units"))


def contradicted(named: DataFrame, found: DataFrame) -> DataFrame:
    """(t) of seeds named(t, subject_at) whose text speaks against them: see step 4 of the module."""
    silent = named.join(found, ["t", "subject_at"], "left_anti").select("t").distinct()
    other = found.where("clear_units > 0").join(named, ["t", "subject_at"], "left_anti").select("t").distinct()
    return silent.join(other, "t", "left_semi")


def document_subjects(
    documents: DataFrame,
    labels: DataFrame,
    names: list[str],
    rounds: int = 8,
    clear: float = 0.75,
    vague: float = 0.3,
    units: int = 2,
    strength: float = 1.0,
    least_documents: int = 3,
    least_papers: int = 3,
    settled: float = 0.005,
) -> DataFrame:
    """(doc_id, subject, units) of every subject that at least `units` units of a document are on, and of trusted seeds.

    documents(doc_id, text, paper_id), labels(doc_id, subject), names: the subjects. units is
    that of the text, which a trusted seed's may fall short of.
    """
    spark = documents.sparkSession
    if not names:
        return spark.createDataFrame([], "doc_id long, subject string, units int")
    n = len(names)
    columns = [f"s{i}" for i in range(n)]
    texts = documents.where((F.length("text") > 0) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("node"), "text", paper_key("paper_id").alias("paper")
    )
    names_ = [regex.sub(r"[\s_-]+", "_", x.strip().lower()) for x in names]
    of_node = texts.select("doc_id", "node").distinct()
    said = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "subject")
    first = cut_lineage(seeds(said.join(of_node, "doc_id"), names_, "node"))
    nodes = texts.groupBy("node").agg(F.min_by(F.struct("text", "paper"), "doc_id").alias("x")).select("node", "x.text", "x.paper")
    # what is common among the labelled documents and says nothing about them
    labelled = tokenised(spread(nodes.join(first.select("node"), "node", "left_semi"), "node")).withColumnRenamed("node", "t")
    common = max(30.0, first.count() / 200)
    plain = learn(labelled, first.withColumnRenamed("node", "t"), n, strength, least_documents, 1).where((F.col("documents") >= common) & (_best(n) < vague / 2))
    background = np.sort(np.array([r[0] for r in plain.select("term").collect()], dtype=np.int64))
    tokens = cut_lineage(tokenised(spread(nodes, "node"), background).withColumn("t", F.monotonically_increasing_id()))  # fixed by the checkpoint
    of_text = tokens.select("node", "t")
    seeded = cut_lineage(first.join(of_text, "node").select("t", *columns))
    each = F.array(*[F.struct(F.lit(i).alias("subject_at"), F.col(c).alias("y")) for i, c in enumerate(columns)])
    named = cut_lineage(seeded.select("t", F.inline(each)).where("y > 0").select("t", "subject_at"))
    known, trusted, before = seeded, named, None
    for _ in range(rounds):
        terms = cut_lineage(learn(tokens, known, n, strength, least_documents, least_papers).where(_best(n) >= vague))
        found = cut_lineage(support(tokens, terms, trusted, n, clear, vague))
        doubtful = cut_lineage(contradicted(named, found))
        trusted = cut_lineage(named.join(doubtful, "t", "left_anti"))
        reached = found.where(F.col("units") >= units).select("t", "subject_at")
        now = cut_lineage(reached.unionByName(trusted).distinct())
        size = now.count()
        if before is not None:
            either = now.unionByName(before[0]).distinct().count()
            if 2 * either - size - before[1] <= settled * max(size, 1):
                break
        before = now, size
        kept = seeded.join(doubtful, "t", "left_anti")
        spread_ = (
            reached.join(kept.select("t"), "t", "left_anti")  # what nothing has reached yet says nothing
            .groupBy("t")
            .agg(*[F.coalesce(F.max((F.col("subject_at") == i).cast("double")), F.lit(0.0)).alias(c) for i, c in enumerate(columns)])
        )
        known = cut_lineage(kept.unionByName(spread_))
    name_of = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("subject_at") + 1)
    of_t = now.join(found.select("t", "subject_at", "units"), ["t", "subject_at"], "left").join(of_text, "t")
    return of_t.select("node", name_of.alias("subject"), F.coalesce("units", F.lit(0)).alias("units")).join(of_node, "node").select("doc_id", "subject", "units")


def subject_shares(documents: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """(subject, documents, share): share of each subject in the corpus, then that of none.

    A document with several subjects gives each an equal part, so shares sum to 1; subjects of
    no document come out with 0.
    """
    ids = documents.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    parts = found.withColumn("part", 1.0 / F.count("*").over(Window.partitionBy("doc_id")))
    total = ids.count()
    of = parts.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("part").alias("part"))
    none = ids.join(found.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").alias("documents"))
    spark = documents.sparkSession
    every = spark.createDataFrame([(x,) for x in names], "subject string").join(of, "subject", "left")
    return every.select(
        "subject",
        F.coalesce("documents", F.lit(0)).cast("long").alias("documents"),
        (F.coalesce("part", F.lit(0.0)) / F.lit(max(1, total))).alias("share"),
    ).unionByName(none.select(F.lit("none").alias("subject"), "documents", (F.col("documents") / F.lit(max(1, total))).alias("share")))
