"""Streams that reuse the batch operators."""
