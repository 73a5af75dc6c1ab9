"""Queries of the text operators; none of these has a form in SQL unless given."""

from __future__ import annotations

from loomgraph.llm import packing, provenance, reading, tokens, validity
from loomgraph.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def p3_found(spark, d):
    return validity.unparsable(table(spark, d, "sources"))


@query()
def p3_rates(spark, d):
    return validity.acceptance(table(spark, d, "sources"))


@query()
def p3_causes(spark, d):
    return validity.causes(table(spark, d, "sources"))


@query()
def p4_found(spark, d):
    return provenance.not_hand_written(table(spark, d, "sources"), table(spark, d, "nodes"), table(spark, d, "library_files"))


@query()
def p4_origins(spark, d):
    return provenance.file_origins(table(spark, d, "sources"), table(spark, d, "nodes"), table(spark, d, "library_files"))


@query()
def p4_evidence(spark, d):
    return provenance.evidence_counts(provenance.file_evidence(table(spark, d, "sources"), table(spark, d, "nodes"), table(spark, d, "library_files")))


@query()
def p6_ids(spark, d):
    return tokens.encode_documents(table(spark, d, "documents"))


@query()
def p7_packs(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


@query("""select pack_name, (select count(*) from documents) as documents, cast(0 as bigint) as over_capacity, cast(0 as bigint) as needless_splits, cast(0 as bigint) as lost_tokens, true as filled from pack_sizes""")
def p7_packs_fill(spark, d):
    """What every packing must keep: no container too full, no needless split, no token lost, and nine tenths filled."""
    docs, packs = table(spark, d, "documents"), table(spark, d, "pack_sizes")
    report = packing.fill_report(packing.pack_documents(docs, packs), tokens.count_tokens(docs), packs)
    return report.selectExpr("pack_name", "documents", "over_capacity", "needless_splits", "lost_tokens", "fill >= 0.9 as filled")


@query()
def p8_found(spark, d):
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))
