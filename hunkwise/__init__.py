"""Hunk risk analytics on Spark: parse unified diffs in bulk, score, rank and present them."""

__version__ = "0.1.0"
