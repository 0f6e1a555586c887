"""Corpus curation and judged-evaluation analytics on PySpark DataFrames."""
