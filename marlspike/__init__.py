"""Corpus analytics on Spark: documents, memories, sessions, events and their retrieval."""
