"""Streaming variants of the online operators."""
