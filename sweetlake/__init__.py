"""Spark jobs for glycan and glycopeptide data, and for training-data corpora (``llm``)."""
