"""Operators for preparing large text corpora, as Spark jobs."""
