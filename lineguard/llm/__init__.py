"""Operators of a training-data pipeline on documents, embeddings and pages."""
