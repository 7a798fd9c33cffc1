"""One form for texts that read alike but are stored with different characters.

Tokens of the corpus are matched against tries of its own vocabulary by a weighted edit
automaton. A look-alike letter read as the letter it most likely stands for, another width, a
split or joined accent and an ignorable character cost nothing; a letter that is drawn like
several (a bar that reads I or l) costs SECOND for a reading but the likeliest; every other edit
costs one. The token takes the spelling of the cheapest vocabulary word within the budget, the
most frequent of equally cheap ones; a token that reaches none is spelled by the look-alike
table. So what a bar reads as is decided by the words of the corpus, not by the table.

The vocabulary that gives spellings are the words without look-alikes, odd widths and
ignorables, however frequent others are: no form holds a look-alike that the table knows.

Defined results
  * null text gives a null form, text without visible characters gives '';
  * blanks of any kind are one blank, runs of them too, none at either end;
  * case, accents, raised or lowered digits, Greek letters without a Latin twin and all other
    visible signs stay as they are;
  * repeated rows and ties: the spelling is chosen per distinct token, by (cost, frequency,
    spelling), so equal texts get equal forms.
"""

from __future__ import annotations

import heapq
import itertools
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread

# Letters drawn as a Latin one in usual fonts (Unicode names them apart).
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ү": "Y", "Һ": "h",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i",
    "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ү": "y", "ѵ": "v", "Ѵ": "V",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    # Latin and Armenian
    "ɡ": "g", "ɑ": "a", "օ": "o", "ս": "u", "հ": "h", "ց": "g",
    # signs
    "µ": "μ", "‐": "-", "‑": "-", "⁃": "-", "‘": "'", "’": "'", "‛": "'", "ʼ": "'", "＇": "'",
    "“": '"', "”": '"', "‟": '"', "∶": ":", "ː": ":", "٫": ",", "∕": "/", "⁄": "/", "․": ".", "…": "...", "‥": "..",
}

# Letters drawn like several Latin ones, the likeliest reading first.
SEVERAL = {"І": "Il", "Ι": "Il", "Ӏ": "Il", "Ⅰ": "Il", "ӏ": "lI", "ⅼ": "lI"}
#: Cost of a reading but the likeliest, and of all free and second readings of a token together.
SECOND, BUDGET = 0.25, 0.5

#: Anything that is not a plain printable ASCII character.
UNUSUAL = r"[^\x20-\x7E]"
#: Blanks of every kind, as a class for Java's and Python's regular expressions alike.
BLANK_CHARACTERS = "".join(
    map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x2800, 0x3000, 0x3164])
)
BLANKS = r"[\s" + BLANK_CHARACTERS + "]+"


def _between(ch: str, first: int, last: int) -> bool:
    return first <= ord(ch) <= last


@lru_cache(maxsize=65536)
def reading(ch: str) -> str:
    """What one character reads as: '' if it is not seen, ' ' for a blank."""
    if " " < ch < "\x7f":
        return ch
    kind = unicodedata.category(ch)
    if ch.isspace() or ch in BLANK_CHARACTERS:
        return " "
    if kind in ("Cf", "Cc") or _between(ch, 0xFE00, 0xFE0F) or _between(ch, 0xE0100, 0xE01EF) or ord(ch) == 0x034F:
        return ""  # formatting, variation selectors, the grapheme joiner
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    if _between(ch, 0xFF00, 0xFFEF) or _between(ch, 0xFB00, 0xFB06) or _between(ch, 0x2160, 0x217F):  # widths, ligatures, numerals
        wide = unicodedata.normalize("NFKC", ch)
        return "".join(LOOKALIKES.get(c, c) for c in wide)
    return ch


def respelled(text: str) -> str:
    """A text spelled by the look-alike table, accents joined."""
    if text.isascii() and text.isprintable():
        return text
    apart = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", "".join(map(reading, apart)))


@lru_cache(maxsize=200_000)
def by_table(token: str) -> str:
    """respelled for single tokens, which come again."""
    return respelled(token)


@lru_cache(maxsize=65536)
def readings(ch: str) -> tuple[tuple[str, float], ...]:
    """What one character can read as, with costs, the cheapest first."""
    if ch in SEVERAL:
        return tuple((r, 0.0 if i == 0 else SECOND) for i, r in enumerate(SEVERAL[ch]))
    return ((reading(ch), 0.0),)


def skeleton(spelled: str) -> str:
    """What a token and every word that it can read as have in common: letters drawn alike as one."""
    return spelled.replace("I", "l")


class Trie:
    """Vocabulary words by their characters, accents apart."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, rank) -> None:
        node = self.root
        for ch in unicodedata.normalize("NFD", word):
            node = node.setdefault(ch, {})
        if "" not in node or rank < node[""][0]:
            node[""] = (rank, word)

    def nearest(self, token: str, budget: float = BUDGET) -> str | None:
        """Spelling of the word at the least cost within budget; ties by rank.

        States are (trie node, place in the token), visited by rising cost.
        """
        apart = unicodedata.normalize("NFD", token)
        order = itertools.count()
        best, seen = None, {}
        waiting = [(0.0, next(order), self.root, 0)]

        def go(cost: float, node: dict | None, at: int) -> None:
            if node is not None and cost <= budget and cost < seen.get((id(node), at), budget + 1):
                seen[id(node), at] = cost
                heapq.heappush(waiting, (cost, next(order), node, at))

        while waiting:
            cost, _, node, at = heapq.heappop(waiting)
            if best is not None and cost > best[0]:
                break
            if at == len(apart):
                if "" in node and (best is None or (cost, *node[""]) < best):
                    best = (cost, *node[""])
            else:
                for read, price in readings(apart[at]):
                    to = node
                    for ch in read:
                        to = to.get(ch) if to is not None else None
                    go(cost + price, to, at + 1)
            if cost + 1 <= budget:
                if at < len(apart):
                    go(cost + 1, node, at + 1)
                for ch, to in node.items():
                    if ch:
                        go(cost + 1, to, at)
                        if at < len(apart):
                            go(cost + 1, to, at + 1)
        return best[2] if best else None


def match_words(vocabulary: list[tuple[str, int]], tokens: list[str], budget: float = BUDGET) -> list[str]:
    """Canonical spelling of each token, given (word, frequency) pairs; words that the table would spell anew give none."""
    trie = Trie()
    for word, n in vocabulary:
        if by_table(word) == word:
            trie.add(word, (-n, word))
    return [trie.nearest(t, budget) or by_table(t) for t in tokens]


def tokens_of(text: Column) -> Column:
    """Tokens between blanks."""
    return F.filter(F.split(text, BLANKS), lambda t: t != "")


def spellings(tokens: DataFrame, budget: float = BUDGET, trie_words: int = 50_000) -> DataFrame:
    """(token, n, spelling) of every distinct token in tokens(token, n) that is not plain ASCII.

    Below the cost of an ordinary edit a token reaches only words of its own skeleton, so tokens
    and words are sharded by it. Within a task they are sorted by it and tries of at most about
    trie_words words are built one after another, so that memory does not grow with the
    vocabulary. A larger budget would need words of other shards and is refused here;
    Trie.nearest itself takes any.
    """
    if budget >= 1.0:
        raise ValueError("an ordinary edit takes a token out of its shard")

    @F.pandas_udf("string")
    def bones(t: pd.Series) -> pd.Series:
        return t.map(lambda x: skeleton(by_table(x)))

    def run(batches):
        words: list[tuple[str, int]] = []
        asked: list[tuple[str, int]] = []
        last = None

        def flush():
            tokens_, n = [t for t, _ in asked], [n for _, n in asked]
            return pd.DataFrame({"token": tokens_, "n": n, "spelling": match_words(words, tokens_, budget)})

        for batch in batches:
            for shard, token, n in zip(batch["shard"], batch["token"], batch["n"]):
                if shard != last and len(words) >= trie_words:
                    if asked:
                        yield flush()
                    words, asked = [], []
                last = shard
                words.append((token, int(n)))
                if not (token.isascii() and token.isprintable()):
                    asked.append((token, int(n)))
        if asked:
            yield flush()

    unusual = cut_lineage(tokens.where(F.col("token").rlike(UNUSUAL)).withColumn("shard", bones("token")))
    usual = tokens.where(~F.col("token").rlike(UNUSUAL)).withColumn("shard", F.translate("token", "I", "l"))
    # words that no unusual token shares its skeleton with cannot be reached
    reachable = usual.join(unusual.select("shard").distinct(), "shard", "left_semi")
    return (
        spread(unusual.unionByName(reachable), "shard")
        .sortWithinPartitions("shard", "token")
        .mapInPandas(run, "token string, n long, spelling string")
    )


def canonical_forms(df: DataFrame, keys: list[str], text: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """df's keys and text with `form`, equal for texts that read alike.

    keys identify a row. vocabulary(token, n) is counted over df itself unless given; it must
    hold every token of df. Only rows with unusual characters are taken apart: the form of the
    rest is the text with single blanks. All rows are kept, null texts with a null form.
    """
    rows = df.select(*keys, F.col(text).alias("text"))
    if vocabulary is None:
        vocabulary = cut_lineage(token_counts(rows, "text"))  # read several times below
    loose = F.col("text").rlike("^ | $|  ")
    plain = F.when(loose, F.array_join(tokens_of(F.col("text")), " ")).otherwise(F.col("text"))
    odd = F.coalesce(F.col("text").rlike(UNUSUAL), F.lit(False))
    odd_rows = rows.where(odd).withColumn("tid", F.sha2("text", 256))
    odd_texts = odd_rows.groupBy("tid").agg(F.first("text").alias("whole"))
    spelled = cut_lineage(spellings(vocabulary))
    # tokens in more than a thousandth of all places are fewer than a thousand: no other key is as hot
    hot = spelled.where(F.col("n") > 0.001 * (spelled.agg(F.sum("n")).first()[0] or 0)).drop("n")
    each = odd_texts.select("tid", F.explode(F.array_distinct(tokens_of(F.col("whole")))).alias("token")).where(F.col("token").rlike(UNUSUAL))
    parts = (
        each.join(F.broadcast(hot), "token", "left_anti").join(spelled.drop("n"), "token")
        .unionByName(each.join(F.broadcast(hot), "token"))
        .groupBy("tid")
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "spelling"))).alias("spelled"))
    )
    respelled = F.array_join(
        F.filter(
            F.transform(tokens_of(F.col("text")), lambda t: F.coalesce(F.try_element_at("spelled", t), t)),
            lambda t: t != "",
        ),
        " ",
    )
    whole = odd_rows.join(parts, "tid", "left").select(*keys, "text", respelled.alias("form"))
    return rows.where(~odd).select(*keys, "text", plain.alias("form")).unionByName(whole)


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """(token, n) over all texts."""
    return (
        df.select(F.explode(tokens_of(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    )


def alike_classes(forms: DataFrame, kind: str = "kind", key: str = "key") -> DataFrame:
    """(kind, key, class, spelling, texts, rows, links) of rows whose form occurs in several spellings.

    forms(kind, key, text, form). class and spelling are digests of form and text; texts is the
    number of spellings of the class, rows that of its rows, links that of the rows with another
    spelling than this one. Copies of one text are counted, not paired. Empty forms are no class.
    """
    f = cut_lineage(
        forms.where(F.col("form") != "").select(F.col(kind).alias("kind"), F.col(key).alias("key"), F.md5("form").alias("class"), F.md5("text").alias("spelling"))
    )
    several = f.groupBy("kind", "class").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("kind", "class")
    f = cut_lineage(f.join(several, ["kind", "class"]))
    per = f.groupBy("kind", "class", "spelling").agg(F.count("*").alias("copies"))
    of = per.groupBy("kind", "class").agg(F.count("*").alias("texts"), F.sum("copies").alias("rows"))
    counted = per.join(of, ["kind", "class"]).withColumn("links", F.col("rows") - F.col("copies"))
    return f.join(counted.drop("copies"), ["kind", "class", "spelling"])


def alike_pairs(forms: DataFrame, kind: str = "kind", key: str = "key") -> DataFrame:
    """(kind, key_a, key_b): rows whose texts differ in characters but have one form, the classes expanded."""
    f = alike_classes(forms, kind, key).select("kind", "key", "class", "spelling")
    a, b = f.alias("a"), f.alias("b")
    same = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.class") == F.col("b.class"))
    return (
        a.join(b, same & (F.col("a.key") < F.col("b.key")) & (F.col("a.spelling") != F.col("b.spelling")))
        .select(F.col("a.kind").alias("kind"), F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))
    )


def question_and_block_texts(audit: DataFrame, documents: DataFrame) -> DataFrame:
    """(kind, key, text) of every question and every block of the two tables."""
    questions = audit.select(
        F.lit("question").alias("kind"), F.col("audit_id").cast("string").alias("key"), F.col("question").alias("text")
    )
    blocks = (
        documents.select("record_id", F.posexplode("pages").alias("p", "page"))
        .select("record_id", "p", F.posexplode("page.blocks").alias("b", "block"))
        .select(
            F.lit("block").alias("kind"),
            F.concat_ws("/", F.col("record_id").cast("string"), "p", "b").alias("key"),
            F.col("block.text").alias("text"),
        )
    )
    return questions.unionByName(blocks)
