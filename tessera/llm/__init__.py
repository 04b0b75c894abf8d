"""Operators for large training-data corpora: resolution, search, scoring, encoding and de-duplication."""
