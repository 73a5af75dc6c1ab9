"""Search over nodes, names in questions, and text search over source files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WORD = r"[^\p{L}\p{N}]+"


def substring(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose name or id holds the text, in any letter case."""
    t = text.lower()
    return nodes.where(F.lower("name").contains(t) | F.lower("id").contains(t))


def _words(c: Column | str) -> Column:
    """The words of a text in lower case, each between spaces."""
    return F.concat(F.lit(" "), F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), _WORD, " ")), " +", "  "), F.lit(" "))


def phrase(nodes: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """``id, hits`` of nodes that hold the words of ``text`` in a row in name, id or location; the most hits first.

    A text without words finds nothing.
    """
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    if not words:
        return nodes.where("false").select("id", F.lit(0).alias("hits"))
    needle = "  ".join(words)
    every = F.concat_ws("  ", _words("name"), _words("id"), _words("location"))
    n = ((F.length(every) - F.length(F.replace(every, F.lit(f" {needle} "), F.lit("")))) / (len(needle) + 2)).cast("int")
    found = nodes.select("id", n.alias("hits")).where("hits > 0")
    return found if limit is None else found.orderBy(F.desc("hits"), "id").limit(limit)


def inverted_index(nodes: DataFrame) -> DataFrame:
    """``term, id, tf``: the words of names, ids and locations with their counts per node."""
    every = F.split(F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", "name", "id", "location")), _WORD, " ")), " ")
    return nodes.select("id", F.explode(every).alias("term")).where("term <> ''").groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def ranked(index: DataFrame, total: int, text: str, limit: int = 20) -> DataFrame:
    """``id, score``: tf-idf over an inverted index of ``total`` nodes, the best ``limit``."""
    words = sorted({w for w in re.split(r"[\W_]+", text.lower()) if w})
    hit = index.where(F.col("term").isin(words))
    idf = hit.groupBy("term").agg(F.log(F.lit(total + 1.0) / F.count(F.lit(1))).alias("idf"))
    return hit.join(idf, "term").groupBy("id").agg(F.sum(F.col("tf") * F.col("idf")).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def question_names(text: str) -> list[tuple[str, str]]:
    """(name, form) of identifiers in a question: qualified, pascal or simple; at most 16."""
    out: list[tuple[str, str]] = []
    for w in re.split(r"[\s,()\[\]]+", text):
        if len(w) < 2 or not re.fullmatch(r"[A-Za-z_][\w.:]*", w) or re.search(r"\.(py|js|ts|java|go|rs|md|json)$", w):
            continue
        form = "qualified" if "." in w or "::" in w else "pascal" if re.fullmatch(r"[A-Z][A-Za-z0-9]{3,}", w) else "simple"
        if (w, form) not in out:
            out.append((w, form))
    return out[:16]


def resolve_names(nodes: DataFrame, names: list[str], degrees: DataFrame) -> DataFrame:
    """``asked, id``: up to three nodes of each exact name or id; of more, the one with the most edges."""
    spark = nodes.sparkSession
    asked = spark.createDataFrame([(n,) for n in names], "asked string")
    hit = nodes.join(F.broadcast(asked), (F.col("id") == F.col("asked")) | (F.col("name") == F.col("asked")))  # names are a question's, at most 16
    hit = hit.join(degrees.select("id", (F.col("in_degree") + F.col("out_degree")).alias("d")), "id")
    w = Window.partitionBy("asked")
    hit = hit.withColumns({"n": F.count(F.lit(1)).over(w), "r": F.row_number().over(w.orderBy(F.desc("d"), "id"))})
    return hit.where("n <= 3 or r = 1").select("asked", "id")


def grep(sources: DataFrame, pattern: str, regex: bool = False, context: int = 0) -> DataFrame:
    """``path, line, text`` of lines that match, with ``context`` lines around them.

    A pattern that is no regular expression is a list of texts between ``|``,
    in any letter case. Rows without a text have no lines.
    """
    if not regex:
        pattern = "(?i)" + "|".join(re.escape(p) for p in pattern.split("|") if p)
    lines = sources.where("path is not null and source is not null").select("path", F.split("source", r"\r?\n").alias("lines"))
    lines = lines.where(F.exists("lines", lambda x: x.rlike(pattern)))
    at = lines.select("path", F.posexplode("lines").alias("at", "text")).withColumn("hit", F.col("text").rlike(pattern).cast("int"))
    if context:
        w = Window.partitionBy("path").orderBy("at").rowsBetween(-context, context)
        at = at.withColumn("hit", F.max("hit").over(w))
    return at.where("hit = 1").select("path", (F.col("at") + 1).alias("line"), "text")


def grep_counts(sources: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    """``path, n``: how many lines of each file match."""
    return grep(sources, pattern, regex).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def source_windows(nodes: DataFrame, sources: DataFrame, before: int = 20, after: int = 40) -> DataFrame:
    """``id, first_line, text``: numbered lines around each node that has a line, from its file."""
    from loomgraph.functions.columns import location_line

    at = nodes.select("id", "file", location_line("location").alias("line")).where("line is not null")
    s = sources.where("source is not null").groupBy("path").agg(F.max_by("source", F.struct("mtime", "source")).alias("source")).select(F.col("path").alias("file"), F.split("source", r"\r?\n").alias("lines"))
    j = at.join(s, "file").withColumn("first_line", F.greatest(F.lit(1), F.col("line") - before))
    cut = F.slice("lines", F.col("first_line"), F.greatest(F.lit(0), F.least(F.size("lines"), F.col("line") + after) - F.col("first_line") + 1))
    numbered = F.transform(cut, lambda x, i: F.concat_ws("\t", (i + F.col("first_line")).cast("string"), x))
    return j.where(F.col("first_line") <= F.size("lines")).select("id", "first_line", F.array_join(numbered, "\n").alias("text"))
