"""Corpus and run-log analytics as plain PySpark DataFrame operators."""
