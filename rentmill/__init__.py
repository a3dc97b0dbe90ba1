"""Spark jobs for rental listings and, in the optional ``llm`` subpackage, for training corpora."""
