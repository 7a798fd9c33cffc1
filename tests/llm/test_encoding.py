import random

import pytest

from marginalia.llm import encoding

pytestmark = pytest.mark.skipif(not encoding.available(), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


PARTS = ["a", " ", "\n", "  ", "'", "'s", "'ll", "l", "e", "r", "v", "é", "é", "。", "１", "2", "!", "?", "\t", "😀", "<|endoftext|>", " ", "​", "\r\n"]


def test_tree_equals_whole(whole):
    e = encoding.encoder()
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 70)))
        assert e.encode(text, leaf=rng.choice([1, 2, 3, 7, 20])) == whole(text), repr(text)


def test_long_texts(whole):
    e = encoding.encoder()
    rng = random.Random(2)
    text = "".join(rng.choice(PARTS + ["word ", "longer words. "]) for _ in range(20_000))
    for t in (text, " " * 9000, "a" * 9000 + " b", "\n" * 5000 + "x", "ab" * 3000 + "1" * 3000):
        ids = e.encode(t)
        assert ids == whole(t) and e.decode(ids) == t


def test_join_is_associative():
    e = encoding.encoder()
    rng = random.Random(3)
    for _ in range(300):
        a, b, c = ("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(3))
        of = encoding.Encoded.of
        left = of(e, a).join(e, of(e, b)).join(e, of(e, c)).ids()
        assert left == of(e, a).join(e, of(e, b).join(e, of(e, c))).ids() == e.encode(a + b + c)


def test_columns(spark, whole):
    texts = [None, "", "plain text", "Ünï 中文 <|endoftext|>", "same", "same", "x " * 20_000]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id int, text string, ids array<int>")
    rows = df.select("doc_id", encoding.token_ids("text").alias("ids"), encoding.token_count("text").alias("n")).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [whole(t) if t else [] for t in texts]
    assert [r.n for r in rows] == [len(r.ids) for r in rows]
    back = df.select(encoding.decoded(encoding.token_ids("text")).alias("t"), "doc_id").orderBy("doc_id").collect()
    assert [r.t for r in back] == [t or "" for t in texts]
    assert df.limit(0).select(encoding.token_ids("text").alias("ids")).collect() == []
