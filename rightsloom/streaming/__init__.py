"""Streaming versions of operators."""
