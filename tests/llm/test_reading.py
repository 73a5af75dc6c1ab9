import random

import pytest

from loomgraph.llm import reading as R

DOCS = "doc_id long, text string, lang string, doc_kind string, level int"


def corpus(spark, n=240):
    rng = random.Random(6)
    words = {k: [f"{'abcd'[k - 1]}{x}" for x in "qwertyuiopasdfghjklz"] for k in (1, 2, 3, 4)}
    rows = []
    for i in range(n):
        k = i % 4 + 1
        per = 5 + 4 * k
        s = [" ".join(rng.choice(words[k if rng.random() < 0.8 else rng.randint(1, 4)]) for _ in range(per)) + "." for _ in range(80 // per + 1)]
        rows.append((i, " ".join(s), rng.choice(["en", " EN-us", "en_GB"]), "guide", 0))
    rows += [(n, None, "en", "guide", 0), (n + 1, "", "en", "guide", 0), (n + 2, "too short", "en", None, 0), (n + 3, "word " * 99, "de", "guide", 0), (n + 4, "word " * 99, "en", "code", 0), (n + 5, "12 34 " * 99, "en", "guide", 0), (n + 6, "a b. " * 60, None, "guide", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_levels(spark):
    docs = corpus(spark)
    labels = spark.createDataFrame([(i, "r", i % 4 + 1) for i in range(120)] + [(0, "q", 1), (None, "q", 1), (3, "q", 9), (5, "q", None), (9999, "q", 2)], "doc_id long, rater string, level int")
    got = {r["doc_id"]: r["level"] for r in R.reading_levels(docs, labels).collect()}
    assert set(got) == {*range(240), 245}  # 245 has no letters
    assert sum(got[i] == i % 4 + 1 for i in range(120, 240)) / 120 > 0.9


def test_no_judgement(spark):
    docs = corpus(spark, 4)
    labels = spark.createDataFrame([], "doc_id long, rater string, level int")
    with pytest.raises(ValueError):
        R.reading_levels(docs, labels)
    assert R.reading_levels(docs.where("false"), labels).collect() == []


def test_frequencies(spark):
    df = spark.createDataFrame([(1, "A a b"), (2, "a don't"), (3, None)], "doc_id long, text string")
    assert {tuple(r) for r in R.document_frequencies(df).collect()} == {("a", 2), ("b", 1), ("don't", 1)}
