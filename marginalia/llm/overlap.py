"""Records of evaluation splits that also occur, exactly or nearly, among train records.

Records are normalised to words and cut into content-defined chunks: a chunk ends after a word
at which a hash rolling over the last words says so, hence an edit moves no cuts but those
around it. Chunk digests are joined across the splits; pairs that meet are compared exactly, by
the longest common subsequence of their words, and the lengths of the chunks they share, in
caption and question, are summed into the fraction of the longer record that they have in common.

An exact way for the rest. Edits in every few words can leave no chunk whole, and a chunk that
very many texts hold is no key. So single words, the finest chunks, are joined beside them: two
texts that share at least `least` of the words of the longer one have their k rarest common
words among the e + k rarest of each, e being the number of words that may differ. The rarest
one alone is the key where it is rare; where it is not, the two or three rarest together are.
No word, chunk or pair is capped: every true pair meets under some key, and no key is hot.

Captions first. Many records share a caption, so distinct captions are compared, and questions
only among the records of captions that are alike, under keys of caption pair and word. Pairs
are thinned by what travels with the keys (lengths, and a parity of word hashes whose distance
never exceeds the number of words that differ) before any text is fetched.

Defined results
  * case, punctuation, blanks and look-alike characters make no difference;
  * a null or empty question or caption (no words) is no copy of anything;
  * repeated records are compared once, as one distinct text, and every row of them comes out;
  * rows of other splits than train, validation and test, or with a null split, pair nothing;
  * an id that occurs twice yields its pairs once;
  * fraction can be 0 for a true pair, if edits leave no chunk whole; it decides nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import paper_key
from ..operators.structure import bound
from ..session import cut_lineage, spread
from .lookalike import by_table, respelled

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
PLAIN_WORD = re.compile(r"[a-z0-9]+")
HELD_OUT = ("validation", "test")
#: A word or chunk in more texts than this is no key of its own.
HOT = 64


def words(text: str | None) -> list[str]:
    """Words that remain when case, punctuation, blanks and look-alikes make no difference."""
    if not text:
        return []
    if text.isascii():
        return PLAIN_WORD.findall(text.lower())
    return [by_table(w) for w in WORD.findall(respelled(text).casefold())]


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text, seed)


def chunks(ws: list[str], mean: int = 4, window: int = 3, longest: int = 16, seed: int = 7) -> list[tuple[int, int]]:
    """(digest, length in words) of the content-defined chunks of a list of words.

    The hash rolls over `window` words; a chunk ends where it is 0 modulo `mean`, or after
    `longest` words.
    """
    hashes = np.array([_hash(w, seed) for w in ws], dtype=np.uint64)
    rolled = np.zeros(len(ws), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for back in range(min(window, len(ws))):
            rolled[back:] = rolled[back:] * np.uint64(0x9E3779B97F4A7C15) + hashes[: len(ws) - back]
    found, start = [], 0
    for i, cut in enumerate((rolled >> np.uint64(17)) % np.uint64(mean) == 0):
        if cut or i - start + 1 >= longest or i == len(ws) - 1:
            found.append((_hash("\x1f".join(ws[start : i + 1]), seed) - (1 << 63), i - start + 1))
            start = i + 1
    return found


def shared_length(a: list[str], b: list[str], mean: int = 4) -> int:
    """Summed length in words of the chunks that two lists of words share."""
    if a == b:
        return len(a)
    held = {d for d, _ in numbered(chunks(b, mean))}
    return sum(n for d, n in numbered(chunks(a, mean)) if d in held)


def parity(digests: list[int]) -> tuple[int, int]:
    """128 bits, each the parity of the digests that fall on it, as two longs.

    Texts that differ in d digests (of both sides) differ in at most d bits.
    """
    bits = 0
    for d in digests:
        bits ^= 1 << (d & 127)
    return (bits & 0xFFFFFFFFFFFFFFFF) - (1 << 63), (bits >> 64) - (1 << 63)


def numbered(items: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Digests made distinct: the k-th occurrence of a digest in one record gets its own."""
    seen: dict[int, int] = {}
    out = []
    for digest, n in items:
        k = seen[digest] = seen.get(digest, -1) + 1
        out.append((digest if not k else _hash(f"{digest}/{k}", 11) - (1 << 63), n))
    return out


def word_digests(ws: list[str]) -> list[int]:
    """Digests of words as a multiset."""
    return [d for d, _ in numbered([(_hash(w, 3) - (1 << 63), 1) for w in ws])]


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def alike(a: list[str], b: list[str], least: float) -> bool:
    """At least the share `least` of the words of the longer list, in the same order."""
    longer = max(len(a), len(b))
    return longer > 0 and min(len(a), len(b)) >= least * longer - 1e-9 and common_words(a, b) >= least * longer - 1e-9


TEXTS = "raw string, name string, words string, n int, b0 long, b1 long, w array<long>, c array<long>"


def signed_texts(texts: DataFrame, mean: int = 4) -> DataFrame:
    """texts(raw, text) with normalised words, word digests, chunk digests and parity; `name` names the words.

    Texts without words are left out.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for raw, text in zip(batch["raw"], batch["text"]):
                ws = words(text)
                if ws:
                    w, joined = word_digests(ws), " ".join(ws)
                    c = [d for d, _ in numbered(chunks(ws, mean))]
                    rows.append((raw, xxhash.xxh128_hexdigest(joined), joined, len(ws), *parity(w), w, c))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in TEXTS.split(", ")])

    return texts.select("raw", "text").mapInPandas(run, TEXTS)


def distinct_texts(signed: DataFrame) -> DataFrame:
    """Distinct texts of signed(raw, ..., in_train, in_held), numbered by `t`, with all their raw spellings."""
    same = [F.any_value(x).alias(x) for x in ("words", "n", "b0", "b1", "w", "c")]
    one = signed.groupBy("name").agg(F.bool_or("in_train").alias("in_train"), F.bool_or("in_held").alias("in_held"), F.collect_set("raw").alias("raws"), *same)
    return cut_lineage(one.withColumn("t", F.monotonically_increasing_id()))  # fixed by the checkpoint


def _fits(a: Column | str, b: Column | str, least: float) -> Column:
    """The smaller is at least the share `least` of the larger."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def _may_be_alike(least: float) -> Column:
    """Lengths and parities of sides a and b allow `least`."""
    apart = sum((F.bit_count(F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}"))) for x in ("b0", "b1")), F.lit(0))
    kept = F.ceil(least * F.greatest("a.n", "b.n") - 1e-9)
    return _fits("a.n", "b.n", least) & (apart <= F.col("a.n") + F.col("b.n") - 2 * kept)


def _counted(texts: DataFrame, digests: str) -> tuple[DataFrame, DataFrame]:
    """(t, total, digest) of all digests, and (digest, texts, both) of each."""
    items = texts.select("t", F.col("n").alias("total"), "in_train", "in_held", F.explode(digests).alias("digest"))
    counts = items.groupBy("digest").agg(F.count("*").alias("texts"), (F.max("in_train") & F.max("in_held")).alias("both"))
    return items.select("t", "total", "digest"), counts


def _with_counts(items: DataFrame, counts: DataFrame, share: float = 0.001) -> DataFrame:
    """items with their digest's counts. Digests with more than `share` of all items, of which
    there are fewer than 1 / share, are joined by broadcast; no other key of the shuffle is larger."""
    bound_ = counts.agg(F.sum("texts")).first()[0] or 0
    large = F.broadcast(counts.where(F.col("texts") > share * bound_))
    return items.join(large, "digest").unionByName(items.join(large, "digest", "left_anti").join(counts, "digest"))


def word_keys(texts: DataFrame, least: float, hot: int = HOT) -> DataFrame:
    """(t, key): texts that are alike to `least` have a key in common."""
    if least <= 2 / 3:
        raise ValueError("the keys need more than two thirds of common words")
    items, counts = _counted(texts, "w")
    counts = cut_lineage(counts)
    n_texts = texts.count()
    n = F.col("texts")
    # how many of the rarest common words make the key: by the rarest one's count alone, so that both texts agree
    level = F.when(n <= hot, 1).when(n * n <= hot * n_texts, 2).otherwise(3)
    ranked = (
        _with_counts(items, counts)
        .groupBy("t", "total")
        .agg(F.array_sort(F.collect_list(F.struct("texts", "digest", level.alias("level"), "both"))).alias("p"))
    )
    e = F.floor(F.col("total") * (1 - least) + 1e-9).cast("int")

    def keys(p: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            def rest(k: int) -> Column:
                return F.slice(p, i + 2, F.greatest(e + k - i - 1, F.lit(0)))

            triples = bound(
                rest(3),
                lambda r: F.flatten(
                    F.transform(r, lambda y, j: F.transform(F.slice(r, j + 2, F.size(r)), lambda z: F.xxhash64(x["digest"], y["digest"], z["digest"])))
                ),
            )
            return (
                F.when((x["level"] == 1) & x["both"], F.array(x["digest"]))
                .when(x["level"] == 2, F.transform(rest(2), lambda y: F.xxhash64(x["digest"], y["digest"])))
                .when(x["level"] == 3, triples)
                .otherwise(F.array().cast("array<long>"))
            )

        return F.flatten(F.transform(F.slice(p, F.lit(1), e + 1), of))

    return ranked.select("t", F.explode(bound(F.slice("p", F.lit(1), e + 3), keys)).alias("key"))


def chunk_keys(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(t, key): the chunks that texts of both sides hold, but not very many texts."""
    items, counts = _counted(texts, "c")
    shared = counts.where(F.col("both") & (F.col("texts") <= hot))
    return items.join(shared, "digest").select("t", F.xxhash64(F.lit("chunk"), "digest").alias("key"))


def _keys(texts: DataFrame, least: float, hot: int) -> DataFrame:
    """(t, in_train, in_held, n, b0, b1, key) of distinct texts."""
    keys = chunk_keys(texts, hot).unionByName(word_keys(texts, least, hot))
    return cut_lineage(keys.join(texts.select("t", "in_train", "in_held", "n", "b0", "b1"), "t"))


def _verified(pairs: DataFrame, texts: DataFrame, least: float, mean: int) -> DataFrame:
    """pairs(t_a, t_b) that are alike, with n_a, n_b and the summed length of their shared chunks."""
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("t").alias(f"t_{x}"), F.col("words").alias(f"w_{x}"), F.col("n").alias(f"n_{x}")), f"t_{x}")

    @F.pandas_udf("int")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        split = [(x.split(" "), y.split(" ")) for x, y in zip(a, b)]
        return pd.Series([shared_length(x, y, mean) if alike(x, y, least) else -1 for x, y in split], dtype="int32")

    return pairs.withColumn("shared", shared("w_a", "w_b")).where("shared >= 0").select("t_a", "t_b", "n_a", "n_b", "shared")


def _same(texts: DataFrame) -> DataFrame:
    """Texts of both sides as pairs with themselves."""
    n = F.col("n")
    return texts.where("in_train and in_held").select(*[F.col("t").alias(f"t_{x}") for x in "ab"], n.alias("n_a"), n.alias("n_b"), n.alias("shared"))


def caption_pairs(texts: DataFrame, least: float = 0.8, hot: int = HOT, mean: int = 4) -> DataFrame:
    """(t_a, t_b, n_a, n_b, shared) of train and held-out texts that are alike, equal ones included."""
    sides = _keys(texts, least, hot)
    a, b = sides.where("in_train").alias("a"), sides.where("in_held").alias("b")
    met = (
        a.join(b, F.col("a.key") == F.col("b.key"))
        .where((F.col("a.t") != F.col("b.t")) & _may_be_alike(least))
        .select(F.col("a.t").alias("t_a"), F.col("b.t").alias("t_b"))
        .distinct()
    )
    return _verified(met, texts, least, mean).unionByName(_same(texts))


def question_pairs(held: DataFrame, texts: DataFrame, captions: DataFrame, least: float = 0.8, hot: int = HOT, mean: int = 4) -> DataFrame:
    """(pair, t_a, t_b, n_a, n_b, shared): alike questions among the records of each pair of captions.

    held(c, t, in_train, in_held): which questions the records of a caption ask, on which side;
    captions(pair, c_a, c_b). Keys are those of questions within a pair of captions.
    """
    keys = _keys(texts, least, hot).select("t", "n", "b0", "b1", "key")

    def side(flag: str, end: str) -> DataFrame:
        of = held.where(flag).select(F.col("c").alias(f"c_{end}"), "t")
        return captions.select("pair", f"c_{end}").join(of, f"c_{end}").select("pair", "t")

    a, b = (side("in_train", "a"), side("in_held", "b"))
    x, y = (s.join(keys, "t").alias(k) for s, k in ((a, "a"), (b, "b")))
    met = (
        x.join(y, (F.col("a.pair") == F.col("b.pair")) & (F.col("a.key") == F.col("b.key")))
        .where((F.col("a.t") != F.col("b.t")) & _may_be_alike(least))
        .select(F.col("a.pair").alias("pair"), F.col("a.t").alias("t_a"), F.col("b.t").alias("t_b"))
        .distinct()
    )
    met = cut_lineage(met)
    near = met.join(_verified(met.select("t_a", "t_b").distinct(), texts, least, mean), ["t_a", "t_b"])
    equal = a.join(b, ["pair", "t"]).join(_same(texts).withColumnRenamed("t_a", "t"), "t").withColumnRenamed("t", "t_a")
    return near.select("pair", "t_a", "t_b", "n_a", "n_b", "shared").unionByName(equal.select("pair", "t_a", "t_b", "n_a", "n_b", "shared"))


def cross_split_pairs(
    df: DataFrame,
    record: str = "result_id",
    split: str = "split",
    question: str = "question",
    caption: str = "caption",
    mean: int = 4,
    least: float = 0.8,
    hot: int = HOT,
) -> DataFrame:
    """(id_a, id_b, fraction, held_out_id): one train and one held-out row each, the smaller id first."""
    side = F.lower(F.trim(split))
    rows = df.select(F.col(record).cast("long").alias("row"), (side == "train").alias("in_train"), F.col(question).alias("q"), F.col(caption).alias("c"))
    rows = rows.where(side.isin("train", *HELD_OUT) & F.col(record).isNotNull() & F.col(question).isNotNull() & F.col(caption).isNotNull())

    def named(texts: DataFrame, column: str, *keys: str) -> DataFrame:
        """Distinct raw texts with the sides they stand on."""
        flags = F.bool_or("in_train").alias("in_train"), F.bool_or(~F.col("in_train")).alias("in_held")
        return texts.groupBy(*keys, F.col(column).alias("text")).agg(*flags).withColumn("raw", F.md5("text"))

    def numbered_texts(raw: DataFrame) -> DataFrame:
        flags = raw.groupBy("raw").agg(F.bool_or("in_train").alias("in_train"), F.bool_or("in_held").alias("in_held"))
        return distinct_texts(signed_texts(spread(raw.dropDuplicates(["raw"]), "raw"), mean).join(flags, "raw"))

    captions = numbered_texts(named(rows, "c"))
    alike_c = cut_lineage(caption_pairs(captions, least, hot, mean).withColumn("pair", F.monotonically_increasing_id()))
    wanted = alike_c.select(F.col("t_a").alias("t")).unionByName(alike_c.select(F.col("t_b").alias("t"))).distinct()
    of_caption = captions.join(wanted, "t", "left_semi").select(F.col("t").alias("caption"), F.explode("raws").alias("raw_c"))
    asked = cut_lineage(rows.withColumn("raw_c", F.md5("c")).join(of_caption, "raw_c").select("row", "in_train", "caption", "q", F.md5("q").alias("raw_q")))
    questions = numbered_texts(named(asked, "q"))
    of_question = questions.select(F.col("t").alias("question"), F.explode("raws").alias("raw_q"))
    of_rows = cut_lineage(asked.join(of_question, "raw_q").select("row", "in_train", "caption", "question").distinct())
    held = of_rows.groupBy(F.col("caption").alias("c"), F.col("question").alias("t")).agg(
        F.bool_or("in_train").alias("in_train"), F.bool_or(~F.col("in_train")).alias("in_held")
    )
    ends = alike_c.select("pair", F.col("t_a").alias("c_a"), F.col("t_b").alias("c_b"), F.col("n_a").alias("m_a"), F.col("n_b").alias("m_b"), F.col("shared").alias("of_captions"))
    found = question_pairs(cut_lineage(held), questions, ends.select("pair", "c_a", "c_b"), least, hot, mean).join(ends, "pair")
    longer = F.greatest(F.col("n_a") + F.col("m_a"), F.col("n_b") + F.col("m_b"))
    found = found.select("c_a", "c_b", "t_a", "t_b", ((F.col("shared") + F.col("of_captions")) / longer).alias("fraction"))

    def rows_of(train: bool, end: str, name: str) -> DataFrame:
        side_ = of_rows.where(F.col("in_train") == train)
        return side_.select(F.col("row").alias(name), F.col("caption").alias(f"c_{end}"), F.col("question").alias(f"t_{end}"))

    return (
        found.join(rows_of(True, "a", "x"), ["c_a", "t_a"])
        .join(rows_of(False, "b", "y"), ["c_b", "t_b"])
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "fraction", F.col("y").alias("held_out_id"))
    )


def record_overlaps(pairs: DataFrame) -> DataFrame:
    """(held_out_id, copies, fraction): train records that a held-out record occurs in, and the most it shares with one."""
    return pairs.groupBy("held_out_id").agg(F.count_distinct("id_a", "id_b").alias("copies"), F.round(F.max("fraction"), 9).alias("fraction"))


def split_report(df: DataFrame, pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """Per held-out split and source: rows, overlapping rows, pairs, their mean fraction, papers shared with train.

    Claims of external_summary stand beside it, the least and the most where a dataset and
    split are published more than once; null where nothing is published.
    """
    rows = df.select(
        F.col("result_id").alias("held_out_id"), F.lower(F.trim("split")).alias("split"), "source", paper_key("paper_id").alias("paper")
    )
    train_papers = rows.where("split = 'train' and paper is not null").select("paper").distinct()
    shared = (
        rows.where(F.col("split").isin(*HELD_OUT) & F.col("paper").isNotNull())
        .select("split", "source", "paper")
        .distinct()
        .join(train_papers, "paper", "left_semi")
        .groupBy("split", "source")
        .agg(F.count("*").alias("papers_shared"))
    )
    hits = record_overlaps(pairs).withColumnRenamed("copies", "pairs")
    counted = (
        rows.where(F.col("split").isin(*HELD_OUT))
        .join(hits, "held_out_id", "left")
        .groupBy("split", "source")
        .agg(
            F.count("*").alias("records"),
            F.count("pairs").alias("overlapping_records"),
            F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"),
            F.round(F.avg("fraction"), 6).alias("mean_fraction"),
        )
    )
    claimed = claims.groupBy(F.col("dataset").alias("source"), F.lower(F.trim("split")).alias("split")).agg(
        F.min("contract.spiqa_paper_overlap").alias("claimed_least"), F.max("contract.spiqa_paper_overlap").alias("claimed_most")
    )
    on = ["split", "source"]

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.select(*[F.col(c).alias(f"_{c}" if c in on else c) for c in right.columns])
        return left.join(r, F.col("split").eqNullSafe(F.col("_split")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_split", "_source")

    return join(join(counted, shared), claimed).withColumn("papers_shared", F.coalesce("papers_shared", F.lit(0)).cast("long"))
