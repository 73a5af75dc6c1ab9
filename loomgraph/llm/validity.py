"""Source files that do not parse (problem 3).

Every file is parsed in the language its path claims, by recursive descent for
statements, precedence climbing for expressions and panic mode after an error.
Files are parsed where they are read; only verdicts are shuffled, to find the
current row of each path and to count.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import syntax

_RESULT = "path string, repo string, language string, mtime timestamp, checked boolean, errors array<struct<line:int,why:string>>, cause string"


def language_of(path: Column) -> Column:
    """The language that the extension of a path stands for; null for another extension."""
    names = F.create_map(*[F.lit(x) for pair in syntax.EXTENSIONS.items() for x in pair])
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def _verdicts(causes: bool):
    def run(frames):
        for f in frames:
            errors, why = [], []
            for language, source in zip(f["language"], f["source"]):
                found = syntax.errors(language, source) if language and source is not None else []
                errors.append([{"line": line, "why": text} for line, text in found])
                why.append(syntax.first_cause(language, source, found) if causes and found else None)
            yield pd.DataFrame({"path": f["path"], "repo": f["repo"], "language": f["language"], "mtime": f["mtime"], "checked": f["source"].notna() & f["language"].notna(), "errors": errors, "cause": why})

    return run


def parse_sources(sources: DataFrame, causes: bool = True) -> DataFrame:
    """``path, repo, language, checked, errors, cause`` of the current row of each path.

    errors holds line and reason of every error, the first first; cause is that
    of the first (conflict, other_language, truncated or damaged; null without
    an error, or without ``causes``). A null source, or a path of no known
    language, is not checked and has no error; an empty text is checked. The
    row with the latest mtime counts (null is the earliest; of equal ones the
    one with more errors). Rows without a path are left out.
    """
    rows = sources.where("path is not null").select("path", F.substring_index("path", "/", 1).alias("repo"), language_of(F.col("path")).alias("language"), "mtime", "source")
    parsed = rows.mapInPandas(_verdicts(causes), _RESULT)
    return parsed.groupBy("path").agg(F.max(F.struct("mtime", F.size("errors").alias("n"), "checked", "errors", "cause", "repo", "language")).alias("r")).select("path", "r.repo", "r.language", "r.checked", "r.errors", "r.cause")


def unparsable(sources: DataFrame) -> DataFrame:
    """``path`` of each file whose current source is not in its language."""
    return parse_sources(sources, causes=False).where(F.size("errors") > 0).select("path")


def acceptance(sources: DataFrame) -> DataFrame:
    """``repo, language, files, rejected, share`` of the checked files, per repository and language."""
    checked = parse_sources(sources, causes=False).where("checked")
    bad = F.sum(F.when(F.size("errors") > 0, 1).otherwise(0))
    return checked.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), bad.alias("rejected")).withColumn("share", F.col("rejected") / F.col("files"))


def causes(sources: DataFrame) -> DataFrame:
    """``path, language, n_errors, line, why, cause``: the first error of each rejected file."""
    bad = parse_sources(sources).where(F.size("errors") > 0)
    return bad.select("path", "language", F.size("errors").alias("n_errors"), F.col("errors")[0]["line"].alias("line"), F.col("errors")[0]["why"].alias("why"), "cause")
