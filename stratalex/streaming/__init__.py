"""Streaming facade over the batch plan."""
