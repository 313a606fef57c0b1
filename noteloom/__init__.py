"""Corpus analytics over encoded music scores, written as Spark DataFrame jobs."""
