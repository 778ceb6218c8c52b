"""Readers of histories: line records, documents, databases, and repositories."""
