"""Readers of documents and writers of results."""
