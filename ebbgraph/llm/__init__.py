"""Operators for large text corpora: cleaning, deduplication, filtering, formatting and tokenising."""
