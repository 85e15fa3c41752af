"""Operators for large text corpora: cleaning, deduplication, scoring, tokens, packing, archives."""
