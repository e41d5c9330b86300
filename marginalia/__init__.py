"""Spark-native retrieval, maintenance and curation of a corpus of Markdown notes."""

__version__ = "0.1.0"
