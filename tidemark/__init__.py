"""Tidemark: text-dataset and evaluation analytics as Spark DataFrame operators."""
