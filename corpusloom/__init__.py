"""Corpusloom: curation and evaluation of text corpora as Spark DataFrame operations."""
