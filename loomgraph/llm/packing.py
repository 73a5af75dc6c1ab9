"""Filling fixed-capacity containers with items (problem 7).

Harmonic packing. An item of length L in a container of capacity C belongs to
class k when it lies in (C / (k + 1), C / k]: k items of class k fit into one
container whatever their exact lengths, so every worker fills the containers of
each class by count, on its own. Room that is left is again a reciprocal of the
capacity: a container with at least C / j free takes items of class j before
new containers of that class are opened, from the largest items to the
smallest. The smallest items, which fit almost anywhere, go last and are placed
by their true lengths.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.tokens import LEAF_CHARS, VOCABULARY_DIR, count_tokens

#: Classes by count; items no longer than capacity / CLASSES are placed by length.
CLASSES = 24
#: Capacities are a configuration; more than this many are refused.
MAX_PACKS = 1000
#: Container numbers of one worker.
_LOCAL_BITS = 33

SCHEMA = "pack_name string, doc_id long, piece int, start long, n_tokens long, container long"


def pack(lengths: np.ndarray, capacity: int, classes: int = CLASSES) -> np.ndarray:
    """A container number for each length (none above ``capacity``), filled as told above."""
    n = len(lengths)
    out = np.full(n, -1, np.int64)
    if not n:
        return out
    kind = np.where(lengths > 0, capacity // np.maximum(lengths, 1), classes)
    kind = np.minimum(kind, classes)
    order = np.lexsort((np.arange(n), -lengths))
    room: list[int] = []
    open_by: list[list[int]] = [[] for _ in range(classes + 1)]

    def file(b: int) -> None:
        if room[b] > 0:
            open_by[min(classes, -(-capacity // room[b]))].append(b)

    sizes = lengths.tolist()
    sorted_kind = kind[order]
    for j in range(1, classes):
        todo = deque(order[sorted_kind == j].tolist())
        # The tightest room first.
        for i in range(j, 0, -1):
            while todo and open_by[i]:
                b = open_by[i].pop()
                for _ in range(min(len(todo), room[b] * j // capacity)):
                    x = todo.popleft()
                    out[x] = b
                    room[b] -= sizes[x]
                file(b)
        while todo:
            b = len(room)
            room.append(capacity)
            for _ in range(min(len(todo), j)):
                x = todo.popleft()
                out[x] = b
                room[b] -= sizes[x]
            file(b)
    # Small items by length: the containers with the most room take them in turn.
    spare = sorted((b for bs in open_by for b in bs), key=lambda b: (room[b], -b))
    here = spare.pop() if spare else -1
    for x in order[sorted_kind == classes].tolist():
        size = sizes[x]
        if here < 0 or room[here] < size:
            while spare and room[spare[-1]] < size:
                spare.pop()
            if spare:
                here = spare.pop()
            else:
                here = len(room)
                room.append(capacity)
        out[x] = here
        room[here] -= size
    return out


def _fill(packs: list[tuple[str, int]], classes: int):
    def run(frames):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << _LOCAL_BITS
        parts = [f for f in frames if len(f)]
        if not parts:
            return
        all_rows = pd.concat(parts, ignore_index=True)
        # Both branches of the sizes may meet in any order; the packing must not depend on it.
        all_rows = all_rows.sort_values(["doc_id", "n_tokens"], kind="stable")
        doc, size = all_rows["doc_id"], all_rows["n_tokens"].to_numpy(np.int64)
        for name, capacity in packs:
            full = np.maximum(0, -(-size // capacity) - 1)
            pieces = full + 1
            at = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(size[at] - start, capacity)
            out = pd.DataFrame({"pack_name": name, "doc_id": doc.to_numpy()[at], "piece": piece.astype(np.int32), "start": start, "n_tokens": length, "container": base + pack(length, capacity, classes)})
            for k in range(0, len(out), 50_000):
                yield out.iloc[k : k + 50_000]

    return run


def capacities(packs: DataFrame) -> list[tuple[str, int]]:
    """The distinct named capacities above 0; rows with a null are left out."""
    rows = packs.where("pack_name is not null and capacity > 0").select("pack_name", "capacity").distinct().limit(MAX_PACKS + 1).collect()
    if len(rows) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} capacities")
    return sorted((r["pack_name"], int(r["capacity"])) for r in rows)


def pack_sizes(sizes: DataFrame, packs: DataFrame, classes: int = CLASSES) -> DataFrame:
    """Containers for rows of ``doc_id, n_tokens``, for each capacity of ``packs``.

    Columns: pack_name, doc_id, piece (0 unless the document is longer than the
    capacity), start (the first token of the piece), n_tokens and container
    (unique within a capacity). Nothing is shuffled: each worker packs the rows
    it holds. A document without tokens is placed with 0 tokens.
    """
    return sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).mapInPandas(_fill(capacities(packs), classes), SCHEMA)


def pack_documents(docs: DataFrame, packs: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARY_DIR, classes: int = CLASSES, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``pack_sizes`` of the documents measured in tokens of the vocabulary ``name``."""
    return pack_sizes(count_tokens(docs, name, folder, leaf_chars), packs, classes)


def fill_report(packed: DataFrame, sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """``pack_name, documents, containers, fill, over_capacity, needless_splits, lost_tokens`` of a packing.

    over_capacity counts containers above their capacity, needless_splits
    documents in several pieces that fit into one container, lost_tokens the
    tokens of ``sizes`` (``doc_id, n_tokens``) that are in no container. A
    capacity without rows, as with empty tables, has zero counts and a null fill.
    """
    zero = F.lit(0).cast("long")
    known = packs.where("pack_name is not null and capacity > 0").groupBy("pack_name").agg(F.min("capacity").alias("capacity"))
    boxes = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("held")).join(F.broadcast(known), "pack_name")  # at most MAX_PACKS rows
    per = boxes.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("held").alias("held"), F.sum((F.col("held") > F.col("capacity")).cast("long")).alias("over_capacity"))
    docs = packed.groupBy("pack_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.sum((F.col("piece") == 0).cast("long")).alias("firsts")).join(F.broadcast(known), "pack_name")
    split = docs.groupBy("pack_name").agg(F.sum("firsts").alias("documents"), F.sum(((F.col("pieces") > F.col("firsts")) & (F.col("n") <= F.col("capacity"))).cast("long")).alias("needless_splits"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), zero).alias("total"))
    out = known.join(per, "pack_name", "left").join(split, "pack_name", "left").crossJoin(total)  # one row
    return out.select(
        "pack_name", F.coalesce("documents", zero).alias("documents"), F.coalesce("containers", zero).alias("containers"), (F.col("held") / (F.col("containers") * F.col("capacity"))).alias("fill"),
        F.coalesce("over_capacity", zero).alias("over_capacity"), F.coalesce("needless_splits", zero).alias("needless_splits"), (F.col("total") - F.coalesce("held", zero)).alias("lost_tokens"),
    )
