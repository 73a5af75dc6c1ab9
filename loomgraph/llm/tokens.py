"""Encoding of the whole corpus with a public tokenizer (problem 6).

Texts of ordinary length are encoded where they are read. Longer texts are cut
in halves, and the halves again, until each piece is short; the pieces are
encoded in parallel and concatenated as a tree. Around each join a growing
window is encoded again until it agrees with both sides:

* where both sides have a place at which the vocabulary's splitting pattern
  must cut, whatever the surroundings, the window runs between these places and
  its ids replace those of both sides;
* within one long run without such a place the window is a part of a single
  word of the byte-pair encoding. It agrees when its first id is the one that
  the left side has there and its last id the one of the right side: a sequence
  of ids is the encoding of its word if each two neighbours are the encoding of
  theirs, and these pairs then hold all along.

Both are exact, so the result does not depend on where a text was cut.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the vocabulary files (a parameter of every operator here).
VOCABULARY_DIR = "/opt/tokenizers"
#: Characters above which a text is encoded in pieces.
LEAF_CHARS = 32_768
#: Fixed value: the published splitting pattern of the vocabulary byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Places at which PATTERN always cuts: after a letter or a digit what is none,
# after another mark a digit or white space. ASCII and blocks of letters only,
# so that no version of Unicode decides otherwise.
_LETTERS = r"一-鿿ぁ-ゖァ-ヺ가-힣Ѐ-ҁ"
_CUT = rf"(?<=[A-Za-z{_LETTERS}])(?=[\t-\r -@\[-`{{-~、。])|(?<=[0-9])(?=[\t-\r -/:-~])|(?<=[!-/:-@\[-`{{-~])(?=[0-9\t-\r ])"

_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """One vocabulary: encode texts, and join encodings of adjacent texts exactly."""

    def __init__(self, raw: bytes) -> None:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        self.bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.cut = regex.compile(_CUT)
        self.run = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")

    def encode(self, text: str | None) -> np.ndarray:
        """Ids without special tokens; a null or empty text has none."""
        if not text:
            return np.zeros(0, np.int32)
        return self.bpe.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def count(self, text: str | None) -> int:
        return len(self.bpe.encode_to_numpy(text, disallowed_special=())) if text else 0

    def _head(self, ids: np.ndarray, n: int) -> int:
        """How many of the first ids make up n bytes."""
        size, k = 0, 0
        while size < n:
            size += len(self.bytes_of[int(ids[k])])
            k += 1
        if size != n:
            raise ValueError("a place to cut lies within a token")
        return k

    def join(self, left: str, lids: np.ndarray, right: str, rids: np.ndarray) -> np.ndarray:
        """The ids of ``left + right`` from those of both."""
        if not left or not right:
            return np.concatenate([lids, rids])
        w = 64
        while True:
            tail, head = left[-w:], right[:w]
            whole = len(tail) == len(left) and len(head) == len(right)
            p = next((m.start() for m in self.cut.finditer(tail)), 0 if len(tail) == len(left) else None)
            q = None
            for m in self.cut.finditer(head):
                q = m.start()
                break
            if q is None and len(head) == len(right):
                q = len(head)
            if p is not None and q is not None:
                a = self._head(lids[::-1], len(tail[p:].encode()))
                b = self._head(rids, len(head[:q].encode()))
                return np.concatenate([lids[: len(lids) - a], self.encode(tail[p:] + head[:q]), rids[b:]])
            if whole:
                return self.encode(left + right)
            if w >= 256 and (m := self.run.fullmatch(tail + head)) is not None:
                # At most w / 4 ids: they lie well within the run, with their neighbours.
                n = w // 16
                a, b = lids[-n:], rids[:n]
                size = sum(len(self.bytes_of[int(i)]) for i in np.concatenate([a, b]))
                if len(lids) > n and len(rids) > n and size < w // 2:
                    word = b"".join(self.bytes_of[int(i)] for i in np.concatenate([a, b]))
                    ids = np.array(self.bpe._encode_single_piece(word), np.int32)
                    if ids[0] == a[0] and ids[-1] == b[-1] and len(ids) > 1:
                        return np.concatenate([lids[:-n], ids, rids[n:]])
            w *= 2

    def concatenate(self, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """Join the encodings of consecutive pieces, neighbours first."""
        while len(parts) > 1:
            parts = [(parts[i][0] + parts[i + 1][0], self.join(*parts[i], *parts[i + 1])) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][1] if parts else np.zeros(0, np.int32)


def encoder(raw: bytes) -> Encoder:
    """The encoder of a vocabulary file, one per worker process."""
    key = hashlib.md5(raw).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(raw)
    return _ENCODERS[key]


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = VOCABULARY_DIR):
    """The vocabulary file as a broadcast (its size is that of the vocabulary, about 1 MB)."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _short(vocab, keep_ids: bool):
    def run(batches):
        enc = encoder(vocab.value)
        for b in batches:
            texts = b.column("text")
            step = 512
            for at in range(0, b.num_rows, step):
                doc = b.column("doc_id").slice(at, step)
                part = texts.slice(at, step).to_pylist()
                if not keep_ids:
                    yield pa.RecordBatch.from_arrays([doc, pa.array([enc.count(t) for t in part], pa.int64())], names=["doc_id", "n_tokens"])
                    continue
                ids = [enc.encode(t) for t in part]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    return run


def _pieces(vocab):
    def run(frames):
        enc = encoder(vocab.value)
        for f in frames:
            f["ids"] = [enc.encode(t) for t in f["text"]]
            yield f

    return run


def _whole(vocab, keep_ids: bool):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("piece")
        ids = encoder(vocab.value).concatenate([(t, np.asarray(i, np.int32)) for t, i in zip(f["text"], f["ids"])])
        return pd.DataFrame({"doc_id": f["doc_id"].iloc[:1], **({"ids": [ids]} if keep_ids else {"n_tokens": [len(ids)]})})

    return run


def _encoded(docs: DataFrame, keep_ids: bool, name: str, folder: str, leaf_chars: int) -> DataFrame:
    spark = docs.sparkSession
    vocab = vocabulary(spark, name, folder)
    rows = docs.select("doc_id", "text")
    long = F.coalesce(F.length("text") > leaf_chars, F.lit(False))
    out = "doc_id long, ids array<int>" if keep_ids else "doc_id long, n_tokens long"
    short = rows.where(~long).mapInArrow(_short(vocab, keep_ids), out)
    # Halving until a piece fits gives a power of two of pieces of equal length.
    halves = F.pow(F.lit(2.0), F.ceil(F.log2(F.length("text") / F.lit(leaf_chars)))).cast("int")
    cut = rows.where(long).select("doc_id", F.monotonically_increasing_id().alias("row"), "text", F.length("text").alias("n"), halves.alias("k"))
    cut = cut.select("doc_id", "row", "text", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("piece"))
    begin = F.floor(F.col("piece").cast("long") * F.col("n") / F.col("k")).cast("int")
    end = F.floor((F.col("piece").cast("long") + 1) * F.col("n") / F.col("k")).cast("int")
    cut = cut.select("doc_id", "row", "piece", F.substring("text", begin + 1, end - begin).alias("text")).repartition("row", "piece")
    encoded = cut.mapInPandas(_pieces(vocab), "doc_id long, row long, piece int, text string, ids array<int>")
    whole = encoded.groupBy("row").applyInPandas(_whole(vocab, keep_ids), out)
    return short.unionByName(whole)


def encode_documents(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARY_DIR, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``doc_id, ids`` of each row; text that looks like a special token is ordinary text.

    A null or empty text has an empty list. Rows that repeat are encoded each;
    other columns are not read. Texts longer than ``leaf_chars`` take the tree.
    """
    return _encoded(docs, True, name, folder, leaf_chars)


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARY_DIR, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``doc_id, n_tokens`` of each row, as ``encode_documents`` would give them."""
    return _encoded(docs, False, name, folder, leaf_chars)
