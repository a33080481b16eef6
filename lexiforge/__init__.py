"""Lexical analytics on Spark: words are rows, morphemes are dimension tables."""

__version__ = "0.1.0"
