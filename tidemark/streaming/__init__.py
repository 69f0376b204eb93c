"""Structured Streaming forms of the changelog operators."""
