"""Corpusloom: a Spark-first engine for curating topic corpora and retrieval datasets."""

__version__ = "0.1.0"
