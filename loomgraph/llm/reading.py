"""Reading level of each document (problem 8).

The familiar-word formula. Words are ranked by the number of documents that
hold them, over all documents; a text is the more demanding the larger the
share of its words outside the list of the first words and the longer its
sentences. As no single length of the list separates all levels, the shares
outside several lists (nested, so one rank per word gives them all) and the mean
sentence length enter a multinomial logistic scale fitted to judged documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of the nested lists of familiar words; no list holds more words than the last.
LISTS = tuple(range(25, 1001, 25))
#: Judged documents that the scale is fitted to at most (those of the least hash).
MAX_JUDGED = 20_000
MIN_WORDS = 60
LEVELS = 4

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")
_FLUSH = 500_000


def _words_in(batches):
    """Words with the number of documents of the task that hold them."""
    seen: Counter = Counter()

    def out():
        ws = list(seen.keys())
        return pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([seen[w] for w in ws], pa.int64())], names=["word", "n"])

    for b in batches:
        for t in b.column("text").to_pylist():
            if t:
                seen.update(set(_WORD.findall(t.lower())))
        if len(seen) > _FLUSH:
            yield out()
            seen.clear()
    if seen:
        yield out()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``word, n``: in how many documents each word (letters, in lower case) occurs."""
    counted = docs.where("text is not null").select("text").mapInArrow(_words_in, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _features(ranks):
    size = len(LISTS)
    edges = np.array(LISTS)

    def run(batches):
        rank = ranks.value
        last = LISTS[-1]
        for b in batches:
            ids, feats = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                n = len(t.split()) if t else 0
                if n < MIN_WORDS:
                    continue
                words = _WORD.findall(t.lower())
                at = np.fromiter((rank.get(w, last) for w in words), np.int64, len(words))
                # How many words lie in front of each end of list; without any letters all are outside.
                hist = np.bincount(np.searchsorted(edges, at, side="right"), minlength=size + 1)
                outside = 1 - np.cumsum(hist[:size]) / max(1, len(words))
                sentences = sum(1 for s in _SENTENCE.split(t) if s and not s.isspace()) or 1
                ids.append(d)
                feats.append(np.concatenate([outside, [n / sentences, np.log(n / sentences)]]))
            flat = np.concatenate(feats) if feats else np.zeros(0)
            ends = np.arange(len(ids) + 1, dtype=np.int32) * (size + 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "f"])

    return run


class Scale:
    """A multinomial logistic scale over standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 600) -> None:
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        z = self._z(x)
        target = np.eye(LEVELS)[y - 1]
        w = np.zeros((z.shape[1], LEVELS))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            s = z @ w
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = z.T @ (p - target) / len(z) + l2 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w = w

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.std, np.ones(len(x))]

    def level(self, x: np.ndarray) -> np.ndarray:
        return (self._z(x) @ self.w).argmax(1) + 1


def english_prose(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of documents in English that are neither code nor log."""
    lang = F.regexp_extract(F.lower(F.regexp_replace("lang", r"^\s+|\s+$", "")), r"^[^-_]*", 0)
    kind = F.coalesce(F.col("doc_kind").isin("code", "log"), F.lit(False))
    return docs.where((lang == "en") & ~kind & F.col("text").isNotNull()).select("doc_id", "text")


def familiar_words(docs: DataFrame, size: int = LISTS[-1]) -> dict[str, int]:
    """The ``size`` words held by the most documents, with their ranks; ties by the word."""
    top = document_frequencies(docs).orderBy(F.desc("n"), "word").limit(size).collect()
    return {r["word"]: i for i, r in enumerate(top)}


def reading_levels(docs: DataFrame, labels: DataFrame, max_judged: int = MAX_JUDGED) -> DataFrame:
    """``doc_id, level`` of each English prose document with at least 60 words.

    Words for the 60 are what stands between white space; a document without a
    letter has no familiar word and is judged by its sentences alone. Document
    frequencies cover all documents, whatever their language. The
    scale is fitted to at most ``max_judged`` documents with judgements; of
    several judgements of one document the median counts, rounded down, and
    judgements out of range or null do not count. Without any judgement no
    scale can be fitted and a ValueError tells so, unless there is nothing to
    judge: then the result is empty. Repeated rows are judged each.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(familiar_words(docs))
    prose = english_prose(docs)
    judged = labels.where(f"doc_id is not null and level between 1 and {LEVELS}").groupBy("doc_id").agg(F.expr("cast(floor(percentile(level, 0.5)) as int)").alias("level"))
    judged = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_judged)
    marked = prose.join(F.broadcast(judged), "doc_id")  # at most max_judged rows
    width = "doc_id long, f array<double>"
    with_level = marked.select("doc_id", "text").mapInArrow(_features(ranks), width).join(judged, "doc_id").orderBy("doc_id").toPandas()
    if not len(with_level):
        if prose.select("doc_id").isEmpty():
            return prose.selectExpr("doc_id", "cast(null as int) as level").where("false")
        raise ValueError("no judged document to fit the scale to")
    scale = spark.sparkContext.broadcast(Scale(np.stack(with_level["f"].to_numpy()), with_level["level"].to_numpy()))

    def grade(batches):
        for b in _features(ranks)(batches):
            if b.num_rows:
                x = np.stack(b.column("f").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scale.value.level(x), pa.int32())], names=["doc_id", "level"])

    return prose.mapInArrow(grade, "doc_id long, level int")


def level_profile(levels: DataFrame, docs: DataFrame) -> DataFrame:
    """``source, doc_kind, level, n`` of the graded documents."""
    return levels.join(docs.select("doc_id", "source", "doc_kind"), "doc_id").groupBy("source", "doc_kind", "level").agg(F.count(F.lit(1)).alias("n"))
