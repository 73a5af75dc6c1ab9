"""Operators on texts and source files for building training data."""
