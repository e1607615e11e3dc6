"""Operators for cleaning, deduplicating and encoding text corpora of any size."""
