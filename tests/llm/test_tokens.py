import random

import pytest

from loomgraph.llm import tokens as T


@pytest.fixture(scope="module")
def enc():
    with open(f"{T.VOCABULARY_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        return T.Encoder(f.read())


def test_concatenation_is_exact(enc):
    rng = random.Random(2)
    units = ["aaaa", "the quick fox ", "漢字仮名", "    ", "\n\n ", "'ll don't", "12345", "!!!", "é", "Привет ", "zq", "-" * 9, "\t", "😀", " ", "\x00", "　"]
    for _ in range(400):
        pool = [rng.choice(units) for _ in range(rng.randint(1, 4))]
        t = "".join(rng.choice(pool) for _ in range(rng.randint(2, 300)))
        m = rng.choice([2, 4, 8])
        at = [len(t) * i // m for i in range(m + 1)]
        parts = [(t[a:b], enc.encode(t[a:b])) for a, b in zip(at, at[1:])]
        assert enc.concatenate(parts).tolist() == enc.encode(t).tolist()


def test_one_long_run(enc):
    rng = random.Random(4)
    t = "abc" * 9000 + "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))
    parts = [(t[a : a + 5000], enc.encode(t[a : a + 5000])) for a in range(0, len(t), 5000)]
    assert enc.concatenate(parts).tolist() == enc.encode(t).tolist()


def test_documents(spark, enc):
    texts = [None, "", "   ", "<|endoftext|>", "word " * 900, "é" * 3000, "x" * 5000, "same", "same"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(7, "same", "clash")], "doc_id long, text string, ids string")
    got = T.encode_documents(df, leaf_chars=512).collect()
    assert len(got) == 10
    for r in got:
        assert list(r["ids"]) == enc.encode(texts[r["doc_id"]]).tolist()
    n = {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(df, leaf_chars=512).collect()}
    assert n == {i: len(enc.encode(t)) for i, t in enumerate(texts)}
    assert T.encode_documents(df.where("false")).collect() == []
