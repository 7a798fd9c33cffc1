import random

from marginalia.llm import overlap


def slow_lcs(a, b):
    m = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b, 1):
            q = m[j]
            m[j] = p + 1 if x == y else max(m[j], m[j - 1])
            p = q
    return m[-1]


def test_common_words():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert overlap.common_words(a, b) == slow_lcs(a, b)


def test_chunks_are_local():
    rng = random.Random(2)
    words = [str(rng.randint(0, 500)) for _ in range(300)]
    changed = words[:150] + ["new"] + words[151:]
    a, b = dict(overlap.chunks(words)), dict(overlap.chunks(changed))
    assert sum(n for _, n in overlap.chunks(words)) == 300
    assert sum(a[x] for x in a.keys() & b.keys()) > 250
    assert overlap.chunks([]) == []


def rows(spark, data):
    return spark.createDataFrame(data, "result_id long, split string, question string, caption string, row int, text_id string")


def brute(data, least=0.8):
    w = {i: (overlap.words(q), overlap.words(c)) for i, _, q, c, *_ in data}
    out = set()
    for x in data:
        for y in data:
            if x[1] == "train" and y[1] in overlap.HELD_OUT and overlap.alike(w[x[0]][0], w[y[0]][0], least) and overlap.alike(w[x[0]][1], w[y[0]][1], least):
                out.add((min(x[0], y[0]), max(x[0], y[0])))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    data = []
    for g in range(40):
        q, c = [rng.choice(vocab) for _ in range(18)], [rng.choice(vocab) for _ in range(60)]
        for k in range(3):
            qq, cc = list(q), list(c)
            for _ in range(rng.choice([0, 1, 2, 6])):
                cc[rng.randrange(60)] = rng.choice(vocab)
            if rng.random() < 0.3:
                qq = [rng.choice(vocab) for _ in range(18)]
            data.append((len(data), rng.choice(["train", "validation", "test"]), " ".join(qq), " ".join(cc).upper() if k else " ".join(cc) + ".", 1, "x"))
    data += [(900, "train", None, "c", 1, "x"), (901, "test", "", "", 1, "x"), (902, None, data[0][2], data[0][3], 1, "x"), (903, "other", data[0][2], data[0][3], 1, "x")]
    got = {(r.id_a, r.id_b) for r in overlap.cross_split_pairs(rows(spark, data)).collect()}
    assert got == brute(data) and len(got) > 10


def test_edits_all_over_the_caption(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    data = []
    for g in range(30):
        q, c = [rng.choice(vocab) for _ in range(10)], [rng.choice(vocab) for _ in range(60)]
        edited = [f"new{i}" if i % 5 == 2 else w for i, w in enumerate(c)]
        asked = [f"new{i}" if i in (3, 7) else w for i, w in enumerate(q)]
        data += [(2 * g, "train", " ".join(q), " ".join(c), 1, "x"), (2 * g + 1, "test", " ".join(asked), " ".join(edited), 1, "x")]
    got = {(r.id_a, r.id_b) for r in overlap.cross_split_pairs(rows(spark, data)).collect()}
    assert got == brute(data) == {(2 * g, 2 * g + 1) for g in range(30)}


def test_hot_copies_and_look_alikes(spark):
    text = ("Which is it now in the left panel?", "Figure 1: one two three four five six seven eight nine ten")
    data = [(i, "train" if i % 2 else "test", *text, 1, "x") for i in range(60)]
    data.append((60, "validation", text[0].replace("a", "а"), text[1].replace(" ", " "), 1, "x"))
    got = [(r.id_a, r.id_b) for r in overlap.cross_split_pairs(rows(spark, data)).collect()]
    assert len(got) == len(set(got)) == 30 * 30 + 30


def test_empty_and_report(spark):
    none = rows(spark, [])
    assert overlap.cross_split_pairs(none).count() == 0
    df = spark.createDataFrame(
        [(1, "train", "a", "P1.pdf", "one two three four", "c d e f g"), (2, "test", "b", "p1v2", "one two three four", "c d e f g"), (3, "test", None, None, "x", "y")],
        "result_id long, split string, source string, paper_id string, question string, caption string",
    )
    claims = spark.createDataFrame([("b", "test", (5,)), ("b", "test", (7,))], "dataset string, split string, contract struct<spiqa_paper_overlap:long>")
    got = {r.source: r for r in overlap.split_report(df, overlap.cross_split_pairs(df), claims).collect()}
    assert (got["b"].pairs, got["b"].papers_shared, got["b"].claimed_least, got["b"].claimed_most) == (1, 1, 5, 7)
    assert (got[None].records, got[None].pairs, got[None].claimed_least) == (1, 0, None)


def test_hot_words_at_every_level(spark):
    """Few words for many texts, random edits up to a fifth: keys of one, two and three words lose nothing."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    q = [rng.choice(vocab) for _ in range(9)]
    base = [[rng.choice(vocab) for _ in range(n)] for n in (2, 3, 20, 35)]
    data = []
    for k in range(90):
        c, asked = list(base[k % 4]), list(q)
        for _ in range(rng.randint(0, max(1, len(c) // 5 + 1))):
            at = rng.randrange(len(c))
            c[at : at + 1] = rng.choice([[], [rng.choice(vocab)], [rng.choice(vocab), c[at]]])
            c = c or ["w0"]
        if rng.random() < 0.5:
            asked[rng.randrange(9)] = rng.choice(vocab)
        data.append((k, rng.choice(["train", "test"]), " ".join(asked), " ".join(c), 1, "x"))
    got = {(r.id_a, r.id_b): r.fraction for r in overlap.cross_split_pairs(rows(spark, data), hot=3).collect()}
    assert got.keys() == brute(data) and len(got) > 100
    w = {i: (overlap.words(q), overlap.words(c)) for i, _, q, c, *_ in data}
    side = {r[0]: r[1] for r in data}
    for (a, b), fraction in got.items():
        a, b = (a, b) if side[a] == "train" else (b, a)
        shared = sum(overlap.shared_length(x, y) for x, y in zip(w[a], w[b]))
        assert fraction == shared / max(sum(map(len, w[a])), sum(map(len, w[b])))


def test_parity_never_exceeds_the_difference():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 30))] for _ in range(2))
        x, y = overlap.word_digests(a), overlap.word_digests(b)
        apart = sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(overlap.parity(x), overlap.parity(y)))
        assert apart <= len(set(x) ^ set(y))
