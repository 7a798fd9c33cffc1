import unicodedata

import pytest

from marginalia.llm import lookalike
from marginalia.llm.lookalike import Trie, by_table


def trie(*words):
    t = Trie()
    for w in words:
        t.add(w, (by_table(w) != w, 0, w))
    return t


E_ACUTE = unicodedata.normalize("NFD", "é")


@pytest.mark.parametrize(
    "token, word",
    [
        ("dерloyment", "deployment"), ("ﬁre", "fire"), ("aﬃdavit", "affidavit"), ("naïve", "naïve"),
        ("naïve", "naïve"), ("co­p", "cop"), ("​cop⁠", "cop"), ("Ｃｏｐ", "Cop"), ("K", "K"), ("Å", "Å"),
    ],
)
def test_free_edits(token, word):
    t = trie("deployment", "fire", "affidavit", "naïve", "cop", "Cop", "K", "Å")
    assert t.nearest(token) == word == by_table(token)


@pytest.mark.parametrize("token", ["Fire", "fires", "fir", "naive", "f1re", "fire²", "α"])
def test_visible_signs_cost(token):
    assert trie("fire", "naïve", "a").nearest(token) is None


def test_budget():
    t = trie("fire", "naïve")
    assert t.nearest("fir", 1.0) == "fire" and t.nearest("fires", 1.0) == "fire" and t.nearest("naive", 1.0) == "naïve"
    assert t.nearest("fir", 0.5) is None


def test_no_word_gives_a_look_alike():
    spoof, clean = "Gekοjire", "Gekojire"
    assert lookalike.match_words([(spoof, 50), ("\u200b" + spoof, 9)], [spoof, "\u200b" + clean, "９８８"]) == [clean, clean, "988"]
    assert lookalike.match_words([("таблица", 3)], ["таблица", "тaблица"]) == [by_table("таблица")] * 2


def test_the_vocabulary_decides_what_a_bar_reads_as():
    words = [("model", 4), ("Ion", 2), ("all", 3), ("aIl", 1), ("Illinois", 1), ("alll", 9)]
    got = lookalike.match_words(words, ["modeӀ", "Ӏon", "aӀӀ", "аӏl", "ӀӀӀinois", "aӀӀӀ", "ӏӀx"])
    assert got == ["model", "Ion", "aIl", "all", "Illinois", "aIII", "lIx"]
    # "aӀӀ": one second reading (aIl) is cheaper than two (all); three (alll) are beyond the budget
    by_reading = {by_table(w): w for w, _ in words}
    assert by_reading.get(by_table("modeӀ")) is None  # grouping by the table's reading would not find it


def brute_nearest(words, token, budget):
    """Least cost over all readings of the token and ordinary edit distance to every word."""
    import itertools

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    apart = unicodedata.normalize("NFD", token)
    best = None
    for reads in itertools.product(*map(lookalike.readings, apart)):
        text, cost = "".join(r for r, _ in reads), sum(c for _, c in reads)
        for w, n in words:
            found = (cost + distance(text, unicodedata.normalize("NFD", w)), -n, w)
            if found[0] <= budget and (best is None or found < best):
                best = found
    return best and best[2]


def test_automaton_equals_brute_force():
    import random

    rng = random.Random(4)
    words = [("".join(rng.choice("lIaoé") for _ in range(rng.randint(1, 4))), n) for n in range(40)]
    words = list({w: (w, n) for w, n in words}.values())
    t = Trie()
    for w, n in words:
        t.add(w, (-n, w))
    for _ in range(300):
        token = "".join(rng.choice("lIӀӏaаο\u200bo") for _ in range(rng.randint(1, 4)))
        for budget in (0.0, 0.25, 0.5, 1.5):
            assert t.nearest(token, budget) == brute_nearest(words, token, budget)


def forms(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, t string, form int")
    return {r.id: r.form for r in lookalike.canonical_forms(df, ["id"], "t").collect()}


def test_forms(spark):
    same = ["Which role does it play?", "Which role does it plаy?", "﻿Which role does it play？", " Which  role does it play? ", "Which role does it play?"]
    other = ["which role does it play?", "Which role does it play²?", "Which rôle does it play?", None, "", "​", "x" * 50_000 + " а" * 2000]
    got = forms(spark, same + other + same[:2])
    assert {got[i] for i in range(5)} == {"Which role does it play?"} == {got[12], got[13]}
    assert len({got[i] for i in (4, 5, 6, 7)}) == 4
    assert got[8] is None and got[9] == "" and got[10] == ""
    assert got[11] == "x" * 50_000 + " a" * 2000  # the table spells what the vocabulary lacks


def test_pairs_equal_brute_force(spark):
    texts = ["ab c", "ab​ c", "аb c", "ab c", "AB c", None, "", "ab c", " "]
    df = spark.createDataFrame([("k", str(i), t) for i, t in enumerate(texts)], "kind string, key string, text string")
    got = {tuple(r) for r in lookalike.alike_pairs(lookalike.canonical_forms(df, ["kind", "key"], "text")).collect()}
    shape = {str(i): " ".join(by_table(t or "").split()) for i, t in enumerate(texts)}
    want = {
        ("k", a, b) for a in shape for b in shape
        if a < b and shape[a] and shape[a] == shape[b] and texts[int(a)] != texts[int(b)]
    }
    assert got == want and want


def test_classes_count_their_links(spark):
    texts = ["ab c", "ab c", "аb c", "ab\u200b c", "other", "other", None, "", "\u200b"]
    df = spark.createDataFrame([("k", str(i), t) for i, t in enumerate(texts)], "kind string, key string, text string")
    got = {r.key: (r.texts, r.rows, r.links) for r in lookalike.alike_classes(lookalike.canonical_forms(df, ["kind", "key"], "text")).collect()}
    assert got == {"0": (3, 4, 2), "1": (3, 4, 2), "2": (3, 4, 3), "3": (3, 4, 3)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "kind string, key string, text string")
    f = lookalike.canonical_forms(df, ["kind", "key"], "text")
    assert f.count() == 0 and lookalike.alike_pairs(f).count() == 0
