"""Streaming forms: merging late results and retention over unbounded tables."""
