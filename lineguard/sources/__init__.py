"""Readers and writers for corpora, manifests, references, logs and reports."""
