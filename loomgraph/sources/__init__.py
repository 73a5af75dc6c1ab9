"""Readers of source trees, graph documents and table folders."""
