"""Graphs that follow streams of changes."""
