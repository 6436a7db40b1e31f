"""Operators for preparing text corpora: deduplication, filtering, scoring, mixing and encoding."""
