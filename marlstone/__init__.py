"""Spark-first engine for document ingestion, retrieval analytics and text corpora."""
